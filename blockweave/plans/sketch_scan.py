"""The greedy scan where an item has few features: the same result as ``greedy.scan`` without a row for each pair of alike items.

A base shares some subset S of a target's features. Of all bases before the target that hold S the first is kept,
and the target takes the largest S that has one, so work grows with the items and not with the pairs:

1. Items of the same shared features form a class. Only features of two sketches or more count one by one.
2. A class has a row for each subset of its features that two items hold, if it is closed: held by more items than
   any larger one. A base shares a closed set with its target, so no other is needed.
3. It is supposed which items are deduped (at first: none). Every closed set's first base follows, from it each
   item's best base, its result and whether it is deduped: the next supposition. It stays the same only for the
   scan's own result, as an item depends on earlier ones alone; every round sets right at least the items whose
   candidates are right, and copies of a deduped item all at once. A result is asked for where an item's best base
   changed. Rounds are many short jobs, so a round writes no more tables than its joins need to be split by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped, written
from .greedy import MIN_RATIO, THRESHOLD, outcome, reported

#: Features an item may have: it has up to 2 to the power of this many subsets.
MOST = 16


#: Cells of a working array, in which a class of n features has 2 to the power of n.
CELLS = 1 << 20


def _pieces(cells: np.ndarray) -> Iterator[slice]:
    """Runs of rows that have CELLS ``cells`` together at most, or are one row."""
    past, i = np.cumsum(cells), 0
    while i < len(cells):
        j = max(i + 1, int(np.searchsorted(past, CELLS + (past[i - 1] if i else 0), "right")))
        yield slice(i, j)
        i = j


def _subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, n, a, b), a and b being hashes of the features in order, to (cls, n, size, mask, a, b) of each subset: sums of its hashes."""
    for batch in batches:
        sizes = np.diff(batch["a"].offsets.to_numpy())
        for size in np.unique(sizes[sizes > 0]).tolist():
            if size > MOST:
                raise ValueError(f"{size} features of an item, more than {MOST}")
            alike = np.flatnonzero(sizes == size)
            for part in _pieces(np.full(len(alike), 1 << size)):
                own = batch.take(pa.array(alike[part]))
                sums = []
                for name in ("a", "b"):
                    x = own[name].flatten().to_numpy().reshape(-1, size)
                    s = np.zeros((len(x), 1), np.int64)
                    for i in range(size):
                        s = np.hstack([s, s + x[:, i : i + 1]])  # wraps
                    sums.append(pa.array(s[:, 1:].ravel()))
                m, rows = (1 << size) - 1, own.num_rows
                which = pa.array(np.repeat(np.arange(rows), m))
                yield pa.RecordBatch.from_arrays([own["cls"].take(which), own["n"].take(which), pa.array(np.full(rows * m, size)), pa.array(np.tile(np.arange(1, m + 1), rows)), *sums], ["cls", "n", "size", "mask", "a", "b"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, size, mask, held, id), sorted by cls, to those (cls, votes, first, id) that no larger subset of the class is held as often as."""

    def of(own: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, mask, held = (own[c].to_numpy() for c in ("size", "mask", "held"))
        ends = np.append(heads[1:], own.num_rows)
        cells = 1 << size[heads]
        for part in _pieces(cells):
            i, j = heads[part][0], ends[part][-1]
            place = np.repeat(np.cumsum(cells[part]) - cells[part], ends[part] - heads[part])
            s, m, h = size[i:j], mask[i:j], held[i:j]
            often = np.zeros(int(cells[part].sum()), np.int64)
            often[place + m] = h
            keep = np.ones(len(m), bool)
            for k in range(int(s.max())):
                larger = np.where(k < s, m | (1 << k), m)
                keep &= (larger == m) | (often[place + larger] != h)
            out, m = own.slice(i, j - i).filter(pa.array(keep)).combine_chunks(), m[keep]
            bits = (m[:, None] >> np.arange(MOST)) & 1
            column = lambda c: out[c].combine_chunks()
            yield pa.RecordBatch.from_arrays([column("cls"), pa.array(bits.sum(axis=1)), pa.array(bits.argmax(axis=1)), column("id")], ["cls", "votes", "first", "id"])

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
        if not rows.num_rows:
            continue
        cls = rows["cls"].combine_chunks()
        heads = np.append(0, np.flatnonzero(pc.not_equal(cls[1:], cls[:-1]).to_numpy(zero_copy_only=False)) + 1)
        if len(heads) > 1:
            yield from of(rows.slice(0, heads[-1]), heads[:-1])
        rest = rows.slice(heads[-1])
    if rest is not None and rest.num_rows:
        yield from of(rest, np.array([0]))


def _named(value: str) -> list[Column]:
    """Two hashes that name a list of feature hashes."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def members_of(items: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank, cls) of the items that share a feature, and (cls, n, whole, a, b) of the classes: members, hashes of their shared features in order.

    Shared are features of several sketches. Several items of one sketch that holds other features, too, are a class
    of their own; ``whole`` is then the sketch's size. Classes are numbered: rounds join them often.
    """
    hashes = F.transform("sketch", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    own = sketches.filter(F.size("sketch") > 0).join(items.filter("not failed").select("image_id", "rank"), "image_id").select("rank", hashes.alias("s"))
    key = ["k", "l"]
    own = written(own.select("rank", *[c.alias(k) for c, k in zip(_named("s"), key, strict=True)], "s"), "sketches")
    equal = written(own.groupBy(*key, "s").agg(F.count("*").alias("n")), "equal")
    places = equal.select(*key, F.posexplode("s").alias("pos", "x")).select(*key, "pos", "x.a", "x.b")
    common = written(places.groupBy("a", "b").agg(F.count("*").alias("k")).filter("k > 1").select("a", "b"), "common")
    shared = places.join(common, ["a", "b"], "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("x"))
    known = equal.select(*key, "n", F.size("s").cast("long").alias("size")).join(shared, key, "left")  # a row a sketch
    known = known.select(*key, "n", "size", F.coalesce("x.a", F.array().cast("array<long>")).alias("a"), F.coalesce("x.b", F.array().cast("array<long>")).alias("b"))
    known = known.withColumn("whole", F.when((F.col("n") > 1) & (F.col("size") > F.size("a")), F.col("size"))).withColumn("x", F.struct("a", "b"))
    alike = [F.when(F.col("whole").isNotNull(), F.col(k)).otherwise(c).alias(f"{k}_cls") for c, k in zip(_named("x"), key, strict=True)]
    named = written(known.filter("whole is not null or size(a) > 0").select(*key, "n", "whole", *alike, "a", "b"), "named")
    cls = [f"{k}_cls" for k in key]
    classes = written(named.groupBy(*cls, "whole", "a", "b").agg(F.sum("n").alias("n")).select(*cls, F.monotonically_increasing_id().alias("cls"), "n", "whole", "a", "b"), "classes")
    # a class of a whole sketch and one of shared features have other names, but for chance: ``whole`` tells them apart
    which = F.coalesce("whole", F.lit(0)).alias("w")
    names = named.select(*key, *cls, which).join(classes.select(*cls, which, "cls"), [*cls, "w"]).select(*key, "cls")
    members = written(own.select("rank", *key).join(names, key).select("rank", "cls"), "members")
    dropped(own, equal, common, named)
    return members, classes


def _tasks(df: DataFrame) -> int:
    """As many tasks as run at once: a table of few bytes may make much work."""
    return df.sparkSession.sparkContext.defaultParallelism


def closed_sets(classes: DataFrame) -> DataFrame:
    """(cls, votes, first, id): the closed subsets of the classes that two items hold; votes: features; first: the place of the first one."""
    kinds = "cls long, n long, size long, mask long, a long, b long"
    alone = classes.select("cls", F.when(F.col("whole").isNull(), F.col("n")).otherwise(0).alias("n"), "a", "b")
    sets = written(alone.repartition(_tasks(classes)).mapInArrow(_subsets, kinds), "subsets")
    held = written(sets.groupBy("a", "b").agg(F.count("*").alias("held")).filter("held > 1").select("a", "b", "held", F.monotonically_increasing_id().alias("id")), "held")
    # a class's whole set is closed; it is shared if the class has two members, too. Its id is the class's, below 0
    zero, place, own = F.lit(0).cast("long").alias("first"), F.expr("shiftleft(1L, int(size)) - 1"), (-1 - F.col("cls")).alias("id")
    alone = sets.filter((F.col("mask") == place) & (F.col("n") > 1)).join(held, ["a", "b"], "left_anti").select("cls", F.col("size").alias("votes"), zero, own)
    alone = alone.unionByName(classes.filter("whole is not null").select("cls", F.col("whole").alias("votes"), zero, own))
    both = sets.join(held, ["a", "b"]).select("cls", "size", "mask", "held", "id").repartition(_tasks(classes), "cls").sortWithinPartitions("cls")
    out = written(both.mapInArrow(_closed, "cls long, votes long, first long, id long").unionByName(alone), "closed")
    dropped(sets, held)
    return out


def _firsts(sets: DataFrame, bases: DataFrame) -> DataFrame:
    """(cls, votes, first, base), dealt out by cls: the first of ``bases`` (rank, cls) that holds a set of a class, by its size and place."""
    heads = bases.groupBy("cls").agg(F.min("rank").alias("base"))  # not written: a class has at most 2 ** MOST sets
    least = written(sets.join(heads, "cls").groupBy("id").agg(F.min("base").alias("base")), "least")
    return sets.join(least, "id").select("cls", "votes", "first", "base").repartition("cls").groupBy("cls", "votes", "first").agg(F.min("base").alias("base"))


def scan(items: DataFrame, sketches: DataFrame, results: Callable[[DataFrame], DataFrame], threshold: int = THRESHOLD, min_ratio: float = MIN_RATIO, force: bool = False) -> DataFrame:
    """What ``greedy.scan`` returns for the votes of ``sketches`` (image_id, sketch: an item's distinct features in order).

    ``results`` gives (target_id, base_id, success, compressed_size) of pairs (target_id, base_id).
    """
    threshold = max(1, threshold)
    items = written(items.select(F.col("image_id").cast("string"), F.col("rank").cast("long"), F.col("size").cast("long"), F.col("failed").cast("boolean")), "items")
    members, classes = members_of(items, sketches)
    sets = closed_sets(classes)
    dropped(classes)
    large = sets.filter(F.col("votes") >= threshold)
    none = {"base_rank": "long", "votes": "long", "success": "boolean", "compressed_size": "long", "deduped": "boolean", "moved": "boolean"}
    state = members.join(large.select("cls").distinct(), "cls", "left_semi").join(items.select("rank", "size"), "rank")
    state = written(state.select("rank", "cls", "size", *[F.lit(None).cast(t).alias(k) for k, t in none.items()]).fillna(False, ["deduped"]), "state")
    names = lambda rank, name: items.select(F.col("rank").alias(rank), F.col("image_id").alias(name))
    result = outcome(F.col("size"), F.col("success"), F.col("compressed_size"), min_ratio, force)
    while True:
        firsts = _firsts(large, state.filter("not deduped"))
        choices = written(firsts.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "first", "base"))).alias("x")), "choices")
        best = F.get(F.filter("x", lambda c: c["base"] < F.col("rank")), F.lit(0))
        best = state.join(choices, "cls", "left").withColumn("x", best).withColumn("kept", F.col("base_rank").eqNullSafe(F.col("x.base")))
        best = written(best.select("rank", "cls", "size", F.col("x.base").alias("base_rank"), (-F.col("x.v")).alias("votes"), "kept", "success", "compressed_size", F.col("deduped").alias("was")), "best")
        pairs = best.filter("not kept and base_rank is not null").select("rank", "base_rank")
        pairs = written(pairs.join(names("base_rank", "base_id"), "base_rank").join(names("rank", "target_id"), "rank").drop("base_rank"), "pairs")
        found = pairs.join(results(pairs.select("target_id", "base_id")).select("target_id", "base_id", "success", "compressed_size"), ["target_id", "base_id"], "left")
        found = found.select("rank", F.col("success").alias("new_success"), F.col("compressed_size").alias("new_compressed_size"))
        after = best.join(found, "rank", "left").withColumns({c: F.when(F.col("kept"), F.col(c)).otherwise(F.col(f"new_{c}")) for c in ("success", "compressed_size")})
        after = after.withColumn("deduped", F.col("base_rank").isNotNull() & (result["status"] == "deduped")).withColumn("moved", F.col("deduped") != F.col("was"))
        after = written(after.select(*state.columns), "state")
        dropped(state, choices, best, pairs)
        state = after
        if state.filter("moved").isEmpty():
            break
    matched = state.filter("base_rank is not null").join(names("base_rank", "base"), "base_rank").select("rank", *[c.alias(k) for k, c in result.items()], "base", "votes")
    # the best vote among registered earlier items, for items without a match: they share less than the threshold
    bases = members.join(state.filter("deduped").select("rank"), "rank", "left_anti")
    firsts = written(_firsts(sets.filter(F.col("votes") < threshold), bases), "firsts")

    def seen(known: DataFrame) -> DataFrame:
        rest = members.join(known.filter("reason = 'no_match'").select("rank", "image_id"), "rank")
        return rest.join(firsts, "cls").filter(F.col("base") < F.col("rank")).groupBy("image_id").agg(F.max("votes").alias("seen"))

    return reported(items.join(matched, "rank", "left"), seen)
