"""Golden SQL: every registered query equals its brute-force DuckDB oracle
(row count, column names, order-insensitive values) at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans import catalog

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return None if v is None else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if x is None else x for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLE) == set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    d_cols, d_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)


#: Reports whose rows come in a fixed order.
ORDERED = ["road_daily_counts", "poi_daily_counts", "poi_daily_counts_by_date", "exposure_counts", "labeled_area_counts", "counts_per_second", "monthly_sum", "monthly_sum_orders",
           "density_rank", "top_density", "top_count", "line_density_rank", "line_top_density", "line_top_count", "polygon_density_rank", "polygon_top_density", "polygon_top_count"]
ORDER_OF = {"exposure_counts": "date, objectid", "labeled_area_counts": "date", "counts_per_second": "date", "monthly_sum": "year, month", "monthly_sum_orders": "year, month",
            "poi_daily_counts": "date, objectid", "poi_daily_counts_by_date": "date", "road_daily_counts": "date, id",
            "line_density_rank": "n / area DESC, id, wkt", "polygon_density_rank": "n / area DESC, id, wkt", "line_top_density": "rank", "polygon_top_density": "rank"}


@pytest.mark.parametrize("name", ORDERED)
def test_order_of_report_rows(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    sql = E.oracle_sql()[name]
    if name in ORDER_OF:
        sql = f"SELECT * FROM ({sql}) ORDER BY {ORDER_OF[name]}"
    else:
        assert "ORDER BY" in sql[sql.rindex("FROM"):]
    res = duck.execute(sql)
    columns = [d[0] for d in res.description]
    assert [tuple(_norm(r[c]) for c in columns) for r in df.collect()] == [tuple(map(_norm, r)) for r in res.fetchall()]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["objectid", "date", "join_count"]
    assert df.count() >= 0
