"""tessera: spatial co-location analytics as PySpark DataFrame operators.

Points are two double columns, lines and polygons are nested-array structs,
and spatial joins are equi-joins on grid cells with an exact residual test.
"""

from .session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
