"""Benchmark pairs and rollups: which files make pairs, and what each way of storing them costs by data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MB = 1048576.0


def _names(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def prefix_pairs(files: DataFrame) -> DataFrame:
    """(target, base) paths: ``<p>_target.jpg`` or ``<p>_target_shifted.jpg`` (in any case) with the first base, in path order, whose name begins ``<p>_base`` and ends as a JPEG."""
    own = _names(files)
    low = F.lower("name")
    targets = own.filter(low.endswith("_target.jpg") | low.endswith("_target_shifted.jpg")).select(F.col("path").alias("target"), F.element_at(F.split("name", "_target"), 1).alias("p"))
    bases = own.filter(F.col("name").contains("_base") & low.rlike(r"\.jpe?g$"))
    # a name may hold _base more than once; each place gives a prefix
    cut = F.expr("transform(filter(sequence(1, length(name)), i -> substring(name, i, 5) = '_base'), i -> substring(name, 1, i - 1))")
    bases = bases.select("path", F.explode(cut).alias("p")).groupBy("p").agg(F.min("path").alias("base"))
    return targets.join(bases, "p").select("target", "base")


def exact_pairs(files: DataFrame) -> DataFrame:
    """(target, base) paths within a folder: a target named ``_target``, ``_target_shifted`` or ``_target_stress`` (.jpg) with exactly ``<p>_base.jpg``."""
    own = _names(files).withColumn("folder", F.regexp_replace("path", "[^/]*$", ""))
    targets = own.filter(F.col("name").rlike(r"_target(_shifted|_stress)?\.jpg$")).select("folder", F.col("path").alias("target"), F.concat(F.element_at(F.split("name", "_target"), 1), F.lit("_base.jpg")).alias("name"))
    return targets.join(own.select("folder", "name", F.col("path").alias("base")), ["folder", "name"]).select("target", "base")


def rollup(pairs: DataFrame) -> DataFrame:
    """A row for each data set of pairs (dataset, base_id, target_size, base_size, delta_size, md5_size, zlib_size, seconds).

    delta_size is null for a failed pair, which counts its whole size. Each base is stored once. Ratios of
    nothing are 1. Values are not rounded.
    """
    delta = F.coalesce("delta_size", "target_size")
    per_base = pairs.select("dataset", "base_id", "base_size").groupBy("dataset", "base_id").agg(F.max("base_size").alias("size"))
    bases = per_base.groupBy("dataset").agg(F.sum("size").alias("base_pack_size"), F.count("*").alias("bases"))
    sums = pairs.groupBy("dataset").agg(F.count("*").alias("pairs"), F.sum("target_size").alias("original_size"), F.sum(F.col("target_size") + F.col("base_size")).alias("full_original_size"), F.sum(delta).alias("delta_size"), F.sum("md5_size").alias("md5_size"), F.sum("zlib_size").alias("zlib_size"), F.sum("seconds").alias("seconds"))
    out = sums.join(bases, "dataset").withColumn("archive_size", F.col("base_pack_size") + F.col("delta_size"))
    d = lambda c: F.col(c).cast("double")
    ratio = lambda a, b: F.when(d(b) > 0, d(a) / d(b)).otherwise(1.0)
    saved = lambda a, b: F.when(d(a) > 0, F.greatest(d(a) - d(b), F.lit(0.0)) / d(a) * 100.0).otherwise(0.0)
    return out.withColumns({
        "delta_ratio": ratio("original_size", "delta_size"),
        "md5_ratio": ratio("original_size", "md5_size"),
        "zlib_ratio": ratio("original_size", "zlib_size"),
        "full_flow_ratio": ratio("full_original_size", "archive_size"),
        "delta_saving_pct": saved("original_size", "delta_size"),
        "system_wide_saving_pct": saved("full_original_size", "archive_size"),
        "throughput_mb_s": F.when(F.col("seconds") > 0, d("original_size") / MB / F.col("seconds")).otherwise(0.0),
        "avg_ms": F.when(F.col("pairs") > 0, F.col("seconds") / F.col("pairs") * 1000.0).otherwise(0.0),
    })
