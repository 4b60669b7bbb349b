"""Candidate bases by an inverted index: postings, vote counts, arg-max with either tie rule, threshold.

Postings join on the feature hash; counting has map-side combine, and hot hashes are left to adaptive skew
handling. Features carry (image_id, hash); the first-seen rule also needs transform_index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inverted_index(features: DataFrame) -> DataFrame:
    """(hash, image_id), each once."""
    return features.select("hash", "image_id").distinct()


def vote_scores(targets: DataFrame, bases: DataFrame, exclude_same: bool = True, distinct: bool = False) -> DataFrame:
    """(target_id, base_id, votes): distinct hashes that a target shares with a base; any transform matches any.

    ``exclude_same``: an image is no base of itself. The empty id excludes nothing. ``distinct``: the targets'
    (hash, image_id) are known to be distinct, so they need no shuffle of their own.
    """
    t = (targets if distinct else inverted_index(targets)).select("hash", F.col("image_id").alias("target_id"))
    b = inverted_index(bases).select("hash", F.col("image_id").alias("base_id"))
    both = t.join(b, "hash")
    if exclude_same:
        both = both.filter((F.col("target_id") != F.col("base_id")) | (F.col("target_id").cast("string") == ""))
    return both.groupBy("target_id", "base_id").agg(F.count("*").alias("votes"))


def best_base(votes: DataFrame) -> DataFrame:
    """(target_id, base_id, votes): most votes, then the smallest base id in string order."""
    order = F.struct((-F.col("votes")).alias("v"), F.col("base_id").cast("string").alias("s"), F.col("base_id"))
    return votes.groupBy("target_id").agg(F.min(order).alias("x")).select("target_id", "x.base_id", (-F.col("x.v")).alias("votes"))


def first_seen_votes(targets: DataFrame, bases: DataFrame) -> DataFrame:
    """(target_id, base_id, votes, first_pos): votes, and the place among the target's distinct hashes of the first one shared."""
    place = targets.groupBy("image_id", "hash").agg(F.min("transform_index").alias("first"))
    t = place.select(F.col("image_id").alias("target_id"), "hash", F.row_number().over(Window.partitionBy("image_id").orderBy("first")).alias("pos"))
    b = inverted_index(bases).select("hash", F.col("image_id").alias("base_id"))
    return t.join(b, "hash").filter("target_id <> base_id").groupBy("target_id", "base_id").agg(F.count("*").alias("votes"), F.min("pos").alias("first_pos"))


def best_base_first_seen(votes: DataFrame, ranks: DataFrame, threshold: int = 1) -> DataFrame:
    """(target_id, base_id, votes): most votes, then first seen (first_pos, then the base's scan rank), from ``threshold`` votes on.

    ``ranks``: base_id, rank.
    """
    order = F.struct((-F.col("votes")).alias("v"), F.col("first_pos"), F.col("rank"), F.col("base_id"))
    top = votes.join(ranks, "base_id").groupBy("target_id").agg(F.min(order).alias("x"))
    return top.select("target_id", "x.base_id", (-F.col("x.v")).alias("votes")).filter(F.col("votes") >= max(1, threshold))

