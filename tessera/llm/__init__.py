"""Operators for preparing language-model training data.

One module per operator, each a plain function on DataFrames; ``queries``
holds the registered queries and their SQL. Nothing outside this package
imports it.
"""
