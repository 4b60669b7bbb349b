"""Connected components of a table of links, by repeated contraction.

Every round points each node at the least node among itself and its neighbours, follows the pointers one step
further, relabels the links through them and drops those that became loops. "Least" goes by id in the first two
rounds (local forests are stars around their least id, which such a round finishes at once) and in every third
one after them; in the others it goes by a hash of the id and the round. Under a random order a node with
neighbours is the least of its surroundings with a probability of one half at most, so the nodes left shrink
geometrically whatever the links' shape: a chain of n nodes takes O(log n) rounds, not n.

Local union-find thins the links inside each partition to a forest, before the first round and after each.
No step gathers links on the driver or in one task: sums and minima have map-side combine, and the joins
are plain shuffled joins, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped, written


class UnionFind:
    """Union by smaller id with path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        lo, hi = (a, b) if a < b else (b, a)
        self.up[hi] = lo
        self.up.setdefault(lo, lo)
        return True


#: Links a task holds at once; beyond it the forest so far is passed on and a new one begun.
FOREST = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uf = UnionFind()

    def out():
        kids = [k for k in uf.up if uf.find(k) != k]
        return pa.RecordBatch.from_arrays([pa.array(kids, pa.int64()), pa.array([uf.find(k) for k in kids], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            uf.union(u, v)
        if len(uf.up) > FOREST:
            yield out()
            uf = UnionFind()
    yield out()


def _by_id(k: int) -> bool:
    """Whether round ``k`` (from 0) orders nodes by id, not by a hash."""
    return k < 2 or k % 3 == 1


def _pointers(edges: DataFrame, k: int) -> DataFrame:
    """(node, to): the least node among each node and its neighbours in the order of round ``k``, then that one's."""
    ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("node"))
    if _by_id(k):
        point = ends.agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("to"))
    else:
        rank = lambda x: F.xxhash64(x, F.lit(k))
        point = ends.agg(F.min_by("v", rank(F.col("v"))).alias("m"))
        point = point.select("node", F.when(rank(F.col("m")) < rank(F.col("node")), F.col("m")).otherwise(F.col("node")).alias("to"))
    once = written(point, "pointers")
    further = once.select(F.col("node").alias("to"), F.col("to").alias("next"))
    twice = written(once.join(further, "to").select("node", F.col("next").alias("to")), "pointers")
    dropped(once)
    return twice


def _followed(maps: list[DataFrame]) -> DataFrame:
    """(node, to) from the first nodes to the last: the rounds' maps joined from the last (and least) one back."""
    out, made = maps[-1], None
    for i, m in enumerate(reversed(maps[:-1]), 1):
        step = out.select(F.col("node").alias("to"), F.col("to").alias("next"))
        out = m.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        if i % 4 == 0 and i < len(maps) - 1:  # no plan grows with the rounds
            before, made = made, written(out, "followed")
            out = made
            if before is not None:
                dropped(before)
    return out


def components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v longs); component is the smallest node reachable.

    Rows with a null end and loops are ignored; empty links give an empty table. The links left after each
    round are appended to ``rounds``, where it is given (they are then counted).
    """
    thinned = lambda rows: written(rows.mapInArrow(_forest, "u long, v long"), "links")
    edges = thinned(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        point = _pointers(edges, len(maps))
        maps.append(point)
        a = point.select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = point.select(F.col("node").alias("v"), F.col("to").alias("b"))
        before, edges = edges, thinned(edges.join(a, "u").join(b, "v").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        dropped(before)
        if rounds is not None:
            rounds.append(edges.count())
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if all(map(_by_id, range(len(maps)))):
        out = written(_followed(maps).select("node", F.col("to").alias("component")), "components")
        dropped(edges, *maps)
        return out
    out = written(_followed(maps), "followed")  # the root of a round by hash need not be the smallest node
    least = written(out.groupBy("to").agg(F.min("node").alias("component")), "least")
    named = written(out.join(least, "to").select("node", "component"), "components")
    dropped(edges, out, least, *maps)
    return named


def roots_local(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a[i], b[i]) among ``n`` places: the links kept."""
    up = list(range(n))
    keep_a, keep_b = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            keep_a.append(x)
            keep_b.append(y)
    return np.array(keep_a, np.int64), np.array(keep_b, np.int64)
