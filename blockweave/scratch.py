"""Tables written to the shared folder and read again: they cut the lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


#: Paths made within each open call of ``settled``.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a fresh local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="blockweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under a new path, read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes what lies under ``paths``, if anything does."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``tables``: only once everything made from them has itself been written."""
    for df in tables:
        deleted(df.sparkSession, df.scratch_path)


class Pile:
    """Tables of one schema made by ``written``, added one by one. Eight of a level become one of the next: a plan over
    all of them stays short, and a row is written again only as often as the logarithm of their number."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.levels: list[list[DataFrame]] = []

    def add(self, table: DataFrame, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) == 8:
            full, self.levels[level] = self.levels[level], []
            merged = written(reduce(DataFrame.union, full), self.name)
            dropped(*full)
            self.add(merged, level + 1)

    def union(self) -> DataFrame | None:
        """All rows; None before the first table."""
        tables = [t for level in self.levels for t in level]
        return reduce(DataFrame.union, tables) if tables else None


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns; if it made scratch tables, its rows are written and those tables deleted."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        out = make()
        if made:
            used = list(made)
            out = written(out, name)
            deleted(out.sparkSession, *used)
        return out
    finally:
        _OPEN.pop()
