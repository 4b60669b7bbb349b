"""Greedy base selection: each item in scan order against the earlier items that were registered as bases.

The order matters only among items that are candidates of each other, so votes are computed for all pairs at
once. Then waves decide items: one is decided as soon as its most preferred candidate that may still be a base
is known to be one, or none is left. Only that pair's result is asked for: one an item, whatever its candidates. Every wave is a join and an aggregation over the pairs
of undecided items; it decides the first of them at least, and of a large group of alike items nearly all, as
these prefer the same first base. What an item without a match reports (its best sub-threshold vote) is
filled in afterwards, when it is known which items are bases.

Items: (image_id, rank, size, failed). Votes: (target_id, base_id, votes, first_pos), base before target.
Results: (target_id, base_id, success, compressed_size), as a table or as a function of the pairs (target_id,
base_id) of a wave; a missing row counts as a call that raised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranked, running_sums
from ..scratch import Pile, dropped, written

THRESHOLD, MIN_RATIO = 2, 1.05


def ordered_votes(features: DataFrame, items: DataFrame) -> DataFrame:
    """(target_id, base_id, votes, first_pos) of an item and each earlier one that shares a feature.

    ``features``: image_id, transform_index, hash.
    """
    first = features.groupBy("image_id", "hash").agg(F.min("transform_index").alias("first"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("first"))
    own = first.select("image_id", "hash", place.alias("pos")).join(items.filter("not failed").select("image_id", "rank"), "image_id")
    t = own.select(F.col("image_id").alias("target_id"), "hash", "pos", F.col("rank").alias("t_rank"))
    b = own.select(F.col("image_id").alias("base_id"), "hash", F.col("rank").alias("b_rank"))
    return t.join(b, "hash").filter("b_rank < t_rank").groupBy("target_id", "base_id").agg(F.count("*").alias("votes"), F.min("pos").alias("first_pos"))


def outcome(original: Column, success: Column, size: Column, min_ratio: float, force: bool) -> dict[str, Column]:
    """status, reason, ratio and stored size of a target compressed against its best base; a null success is a call that raised."""
    good = F.coalesce(success & (size > 0), F.lit(False))
    ratio = F.when(good, original.cast("double") / size.cast("double")).otherwise(0.0)
    better = ratio > min_ratio
    deduped = good & (F.lit(force) | better)
    kept = F.lit(not force) & (ratio < 1.0)
    status = F.when(success.isNull(), "new_base").when(deduped, "deduped").when(kept, "kept_original").otherwise("new_base")
    reason = (
        F.when(success.isNull(), "compress_image failed")
        .when(deduped, F.when(better, "dedup_success").otherwise("forced_dedup"))
        .when(kept, "redundancy_low_keep_original")
        .otherwise("low_ratio_or_failed")
    )
    return {"status": status, "reason": reason, "ratio": ratio, "compressed_size": F.when(deduped, size).otherwise(original)}


def scan(items: DataFrame, votes: DataFrame, results: DataFrame | Callable[[DataFrame], DataFrame], threshold: int = THRESHOLD, min_ratio: float = MIN_RATIO, force: bool = False) -> DataFrame:
    """(image_id, rank, status, reason, base, votes, ratio, original_size, compressed_size) of every item."""
    threshold = max(1, threshold)
    items = written(items.select(F.col("image_id").cast("string"), F.col("rank").cast("long"), F.col("size").cast("long"), F.col("failed").cast("boolean")), "items")
    votes = written(votes, "votes")
    ids = items.select("image_id", "rank", "size")
    pairs = votes.filter(F.col("votes") >= threshold).join(ids.select(F.col("image_id").alias("target_id"), F.col("rank").alias("t_rank"), F.col("size").alias("t_size")), "target_id").join(ids.select(F.col("image_id").alias("base_id"), F.col("rank").alias("b_rank")), "base_id")
    undecided = written(pairs, "pairs")
    first = items.filter("not failed").select("image_id").join(undecided.select(F.col("target_id").alias("image_id")).distinct(), "image_id", "left_anti")
    first = written(first.select(F.col("image_id").alias("base_id"), F.lit(True).alias("is_base")), "bases")
    waves, x = Pile("waves"), F.col("x")
    while not undecided.isEmpty():
        known = waves.union()
        bases = first if known is None else first.union(known.select("image_id", F.col("status") != "deduped"))
        order = F.struct((-F.col("votes")).alias("v"), "first_pos", "b_rank", "is_base", "base_id")
        best = undecided.join(bases, "base_id", "left").groupBy("target_id", "t_size").agg(F.min(F.when(F.coalesce("is_base", F.lit(True)), order)).alias("x"))
        ready = written(best.filter(x.isNull() | F.coalesce(x["is_base"], F.lit(False))).select("target_id", "t_size", x["base_id"].alias("base_id"), (-x["v"]).alias("votes")), "ready")
        asked = ready.filter("base_id is not null").select("target_id", "base_id")
        found = (results(asked) if callable(results) else results).select("target_id", "base_id", "success", "compressed_size")
        none = F.col("base_id").isNull()
        result = outcome(F.col("t_size"), F.col("success"), F.col("compressed_size"), min_ratio, force)
        alone = {"status": F.lit("new_base"), "reason": F.lit("no_match"), "ratio": F.lit(0.0), "compressed_size": F.col("t_size")}
        out = [F.when(none, alone[k]).otherwise(c).alias(k) for k, c in result.items()]
        waves.add(written(ready.join(found, ["target_id", "base_id"], "left").select(F.col("target_id").alias("image_id"), *out, F.col("base_id").alias("base"), "votes"), "wave"))
        rest = written(undecided.join(ready.select("target_id"), "target_id", "left_anti"), "undecided")
        dropped(undecided, ready)
        undecided = rest
    nothing = "image_id string, status string, reason string, ratio double, compressed_size long, base string, votes long"
    matched = waves.union()
    matched = items.sparkSession.createDataFrame([], nothing) if matched is None else matched
    known = items.join(matched, "image_id", "left")

    def seen(known: DataFrame) -> DataFrame:
        registered = known.filter("status in ('new_base', 'kept_original')").select(F.col("image_id").alias("base_id"))
        return votes.join(registered, "base_id", "left_semi").groupBy(F.col("target_id").alias("image_id")).agg(F.max("votes").alias("seen"))

    return reported(known, seen)


def reported(known: DataFrame, seen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A scan's rows from its items with their matches; ``seen`` gives (image_id, seen), the best vote among registered earlier items, for items without a match."""
    known = known.withColumn("status", F.when(F.col("failed"), "failed").otherwise(F.coalesce("status", F.lit("new_base")))).withColumn("reason", F.when(F.col("failed"), "feature extraction failed").otherwise(F.coalesce("reason", F.lit("no_match"))))
    known = written(known, "statuses")
    out = known.join(seen(known), "image_id", "left")
    seen_votes = F.when(F.col("reason") == "no_match", F.coalesce("seen", F.lit(0))).otherwise(F.coalesce("votes", F.lit(0)))
    return out.select("image_id", "rank", "status", "reason", F.coalesce("base", F.lit("")).alias("base"), seen_votes.cast("long").alias("votes"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.col("size").alias("original_size"), F.coalesce("compressed_size", "size").alias("compressed_size"))


def output_names(scanned: DataFrame) -> DataFrame:
    """(image_id, output): each attempt's delta name: the path without its suffix, ``/`` as ``__``, and the attempt's number from 1."""
    attempts = ranked(scanned.filter("reason not in ('no_match', 'feature extraction failed')").select("image_id", "rank"), "rank", name="attempt")
    bare = F.regexp_replace("image_id", r"(?<=[^/])\.[^./]*$", "")
    name = F.concat(F.replace(bare, F.lit("/"), F.lit("__")), F.format_string(".%06d.ddct", F.col("attempt") + 1))
    return attempts.select("image_id", name.alias("output"))


def manifest(scanned: DataFrame, hashes: DataFrame, strict: bool = True) -> DataFrame:
    """(target, ddct_file, base_file, original_sha256, strict_lossless) of deduped items. ``hashes``: image_id, sha256."""
    names = output_names(scanned)
    kept = scanned.filter("status = 'deduped'").join(names, "image_id").join(hashes, "image_id", "left")
    return kept.select(F.col("image_id").alias("target"), F.concat(F.lit("deltas/"), "output").alias("ddct_file"), F.concat(F.lit("bases/"), "base").alias("base_file"), F.coalesce("sha256", F.lit("")).alias("original_sha256"), F.lit(strict).alias("strict_lossless"))


def running_stats(scanned: DataFrame) -> DataFrame:
    """A row for each item in scan order: the counters so far and what derives from them.

    A deduped item's stored size is its delta's; every other item, failed ones too, counts its own size.
    """
    one = F.lit(1).cast("long")
    flag = lambda c: c.cast("long")
    status = F.col("status")
    counted = scanned.select("image_id", "rank", one.alias("processed_images"), flag(status.isin("new_base", "kept_original")).alias("base_images"), flag(status == "deduped").alias("deduped_images"), flag(status == "failed").alias("failed_images"), F.col("original_size").alias("processed_original_size"), F.col("compressed_size").alias("dedup_total_size"))
    return derived(running_sums(counted, "rank", ["processed_images", "base_images", "deduped_images", "failed_images", "processed_original_size", "dedup_total_size"]))


def derived(stats: DataFrame, elapsed: str | None = None) -> DataFrame:
    """``stats`` with compression_ratio, savings_percent and saved_mb, and avg_throughput_mb_s where a column of seconds is named."""
    original, stored = F.col("processed_original_size").cast("double"), F.col("dedup_total_size").cast("double")
    out = stats.withColumns({
        "compression_ratio": F.when(stored > 0, original / stored).otherwise(0.0),
        "savings_percent": F.when(original > 0, (1.0 - stored / original) * 100.0).otherwise(0.0),
        "saved_mb": F.greatest(F.lit(0.0), original - stored) / 1048576.0,
    })
    return out.withColumn("avg_throughput_mb_s", F.when(F.col(elapsed) > 0, original / 1048576.0 / F.col(elapsed)).otherwise(0.0)) if elapsed else out


def similarity_text(exact, similar, different, total):
    """``Exact x% | Similar y% | Different z%`` with one decimal; empty without blocks."""
    share = lambda c: F.lit(100.0) * F.col(c) / F.col(total)
    return F.when(F.col(total) > 0, F.format_string("Exact %.1f%% | Similar %.1f%% | Different %.1f%%", share(exact), share(similar), share(different))).otherwise("")
