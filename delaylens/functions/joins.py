"""Join helpers for dimension-style tables: broadcasts are size-checked, never unconditional."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

DEFAULT_BROADCAST_ROWS = 200_000
DIMENSION_BYTES = 8 << 20


def row_bytes(schema: StructType) -> int:
    """A generous size of one row: 16 bytes a number or date, 256 a text, 1,024 anything nested."""
    fixed = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)
    return 16 + sum(16 if isinstance(f.dataType, fixed) else 1_024 if isinstance(f.dataType, (ArrayType, StructType)) else 256
                    for f in schema.fields)


def dimension(df: DataFrame, max_bytes: int = DIMENSION_BYTES) -> DataFrame:
    """``broadcast(df)`` if its rows fit ``max_bytes``, else ``df``.

    For small, cheap tables such as a match calendar, whose size the planner
    cannot see: one bounded count of that table proves the bound.
    """
    return broadcast_if_small(df, max_bytes // row_bytes(df.schema))


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
