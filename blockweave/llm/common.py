"""Helpers that the operators of this subpackage share: tables, scratch tables, size-checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dropped, new_path, shared_dir, written

__all__ = ["BROADCAST_BYTES", "dropped", "hinted", "new_path", "shared_dir", "small", "table", "written"]

#: A side is broadcast only when its counted rows times its row width stay under this many bytes.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> bool:
    """Whether ``df`` (cheap to count) fits ``BROADCAST_BYTES``."""
    return (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES


def hinted(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, row_bytes, rows) else df
