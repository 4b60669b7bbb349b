"""Ranks and running sums over a whole table without a single task: ranges first, then within ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with its rows' places (from 0) in the order of the columns ``order`` (which should tell rows apart)."""
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = counts.select("__part", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__own", own).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__part", "__own", "__before")


def running_sums(df: DataFrame, rank: str, columns: list[str], width: int = 4096) -> DataFrame:
    """``df`` with each of ``columns`` as its running sum in the order of ``rank`` (distinct longs from 0).

    Ranks are cut into groups of ``width`` and these into groups again, so the widest window holds a row for
    each ``width`` squared rows.
    """
    own = df.withColumn("__g", F.expr(f"{rank} div {width}")).withColumn("__s", F.expr(f"{rank} div {width * width}"))
    sums = own.groupBy("__s", "__g").agg(*[F.sum(c).alias(c) for c in columns])
    tops = sums.groupBy("__s").agg(*[F.sum(c).alias(c) for c in columns])
    past = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("__s", *[past(Window.orderBy("__s"), c).alias(f"__t_{c}") for c in columns])
    sums = sums.select("__s", "__g", *[past(Window.partitionBy("__s").orderBy("__g"), c).alias(f"__b_{c}") for c in columns]).join(tops, "__s").drop("__s")
    inside = Window.partitionBy("__g").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    own = own.drop("__s").withColumns({f"__o_{c}": F.sum(c).over(inside) for c in columns}).join(sums, "__g")
    kept = [c for c in df.columns if c not in columns]
    return own.select(*kept, *[(F.col(f"__o_{c}") + F.col(f"__b_{c}") + F.col(f"__t_{c}")).alias(c) for c in columns])
