"""Luma grids as text: a line ``width height``, then 64 numbers a block, blocks in row-major order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def luma_text(cells: DataFrame) -> DataFrame:
    """(image_id, text) of grids (image_id, row, col, coeff)."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "coeff"))), lambda b: F.concat_ws(" ", b["coeff"].cast("array<string>")))
    per = cells.groupBy("image_id").agg(F.concat_ws(" ", F.max("col") + 1, F.max("row") + 1).alias("head"), blocks.alias("blocks"))
    return per.select("image_id", F.concat(F.concat_ws("\n", F.array("head"), "blocks"), F.lit("\n")).alias("text"))


def parse_luma_text(texts: DataFrame) -> DataFrame:
    """(image_id, row, col, coeff, error) of texts (image_id, text). Sizes below 1, missing or unfit numbers give one row with an error; numbers beyond the grid are ignored."""
    own = texts.select("image_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("t"))
    own = own.select("image_id", "t", F.get("t", F.lit(0)).try_cast("int").alias("w"), F.get("t", F.lit(1)).try_cast("int").alias("h"))
    n = F.col("w").cast("long") * F.col("h") * 64
    own = own.withColumn("n", n).withColumn("v", F.when((F.col("w") > 0) & (F.col("h") > 0), F.transform(F.expr("slice(t, 3, cast(least(n, size(t)) as int))"), lambda x: x.try_cast("smallint"))))
    error = F.when(~F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False)), "sizes are missing or not positive").when(F.size("v") < F.col("n"), "numbers are missing").when(F.exists("v", lambda x: x.isNull()), "a number is no 16-bit integer")
    own = own.withColumn("error", error)
    bad = own.filter("error is not null").select("image_id", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("array<smallint>").alias("coeff"), "error")
    good = own.filter("error is null").select("image_id", "w", "v", F.explode(F.sequence(F.lit(0), F.expr("w * h - 1"))).alias("i"))
    good = good.select("image_id", F.expr("cast(i div w as int)").alias("row"), F.expr("cast(i % w as int)").alias("col"), F.expr("slice(v, i * 64 + 1, 64)").alias("coeff"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad)


def replace_luma(blocks: DataFrame, luma: DataFrame) -> DataFrame:
    """``blocks`` (image_id, comp, is_luma, row, col, coeff) with the luma coefficients of ``luma`` (image_id, row, col, coeff), where the geometry is the same."""
    new = luma.select("image_id", "row", "col", F.col("coeff").alias("__new"))
    size = lambda df: df.groupBy("image_id").agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count("*").alias("n"))
    fit = size(blocks.filter("is_luma")).join(size(luma), ["image_id", "r", "c", "n"]).select("image_id", F.lit(True).alias("__fit"))
    both = blocks.join(new, ["image_id", "row", "col"], "left").join(fit, "image_id", "left")
    return both.withColumn("coeff", F.when(F.col("is_luma") & F.col("__fit"), F.col("__new")).otherwise(F.col("coeff"))).select(*blocks.columns)
