"""Exact dedup with counting quotient filters.

1. One scan normalises each text and writes (doc_id, fp, sha), fp being a 64-bit fingerprint.
2. Every partition packs its fingerprints into counting quotient filters, one per slab (a range of
   quotients): quotient bits address slots, remainders are kept sorted in runs, counters hold repeats.
   Quotient and remainder together are the whole fingerprint, so the filters merge without loss.
3. The filters of a slab are merged by their sorted remainders; fingerprints with a count above one are
   routed on.
4. Only the texts of those fingerprints are compared byte by byte: equal bytes form a group.

A hot text costs one counter per partition and slab; its byte verification is an aggregation with map-side
combine, and joins on the fingerprint are plain shuffled joins that adaptive execution can split.

Edge cases: a null text counts as empty; rows with a null doc_id stay as rows of their own with a null
keep_id (all kept) unless a copy has an id; repeated doc_ids are counted as rows, and rows that share text and
doc_id are all kept or all not; other columns are ignored. ``drop_exact_copies`` leaves one row of such ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hinted, written

SPACES = r"[\x20\x09-\x0D]+"
#: Fingerprints a slab holds on average.
SLAB = 1 << 15


def normalised(text="text"):
    """The text with each run of white space as one space; null: empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def slots_for(n: int) -> int:
    """Quotient bits for ``n`` fingerprints at a load of at most 0.75."""
    return max(1, int(np.ceil(np.log2(n / 0.75 + 1))))


@dataclass
class CountingQuotientFilter:
    """Fingerprints of ``q + r`` bits: ``q`` bits choose a slot, ``r`` bits are stored, sorted within a run.

    A run begins at its quotient's slot or right after the previous run (linear probing); ``occupied`` marks
    quotients that have a run and ``runend`` marks the last slot of each run, so the remainders need no
    quotient beside them. ``count`` holds the counter of each slot.
    """

    q: int
    r: int
    occupied: np.ndarray
    runend: np.ndarray
    remainder: np.ndarray
    count: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, r: int, q: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints (of q + r bits) and their counts."""
        n = len(values)
        quotient = (values >> np.uint64(r)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if n else np.empty(0, np.int64)
        length = np.diff(np.r_[heads, n])
        # start[i] = max(quotient[i], start[i-1] + length[i-1]), as a running maximum
        before = np.cumsum(length) - length
        start = np.maximum.accumulate(quotient[heads] - before) + before if n else heads
        slots = max(1 << q, int(start[-1] + length[-1]) if n else 0)
        occupied, runend = np.zeros(1 << q, bool), np.zeros(slots, bool)
        remainder, count = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        occupied[quotient[heads]] = True
        runend[start + length - 1] = True
        at = np.repeat(start - before, length) + np.arange(n)
        remainder[at] = values & ((np.uint64(1) << np.uint64(r)) - np.uint64(1))
        count[at] = counts
        return cls(q, r, occupied, runend, remainder, count)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts, read back from the slots."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        start = np.maximum(quotient, np.r_[0, end[:-1] + 1]) if len(end) else end
        length = end - start + 1
        before = np.cumsum(length) - length
        at = np.repeat(start - before, length) + np.arange(int(length.sum()))
        return (np.repeat(quotient.astype(np.uint64), length) << np.uint64(self.r)) | self.remainder[at], self.count[at]

    def get(self, value: int) -> int:
        """The counter of one fingerprint: rank of its quotient, select of its run, binary search within it."""
        quotient, remainder = value >> self.r, np.uint64(value & ((1 << self.r) - 1))
        if not self.occupied[quotient]:
            return 0
        rank = int(self.occupied[: quotient + 1].sum())
        ends = np.flatnonzero(self.runend)
        end = int(ends[rank - 1])
        start = max(quotient, int(ends[rank - 2]) + 1 if rank > 1 else 0)
        i = start + int(np.searchsorted(self.remainder[start : end + 1], remainder))
        return int(self.count[i]) if i <= end and self.remainder[i] == remainder else 0

    def to_bytes(self) -> bytes:
        """Packed bits, then the used slots' remainders and counters (of 1 or 8 bytes)."""
        used = np.flatnonzero(self.count)
        c = self.count[used]
        wide = int(bool(len(c)) and int(c.max()) > 255)
        head = np.array([self.q, self.r, len(self.runend), len(used), wide], np.int64).tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.runend).tobytes() + self.remainder[used].tobytes() + c.astype(np.int64 if wide else np.uint8).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        q, r, slots, n, wide = np.frombuffer(blob, np.int64, 5).tolist()
        at = 40
        occupied = np.unpackbits(np.frombuffer(blob, np.uint8, size := ((1 << q) + 7) // 8, at), count=1 << q).astype(bool)
        at += size
        runend = np.unpackbits(np.frombuffer(blob, np.uint8, size := (slots + 7) // 8, at), count=slots).astype(bool)
        at += size
        rem = np.frombuffer(blob, np.uint64, n, at)
        counts = np.frombuffer(blob, np.int64 if wide else np.uint8, n, at + 8 * n)
        quotient, end = np.flatnonzero(occupied), np.flatnonzero(runend)
        start = np.maximum(quotient, np.r_[0, end[:-1] + 1]) if len(end) else end
        length = end - start + 1
        before = np.cumsum(length) - length
        used = np.repeat(start - before, length) + np.arange(n)
        remainder, count = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        remainder[used], count[used] = rem, counts
        return cls(q, r, occupied, runend, remainder, count)

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' fingerprints, by a merge of their sorted contents; the counters of equal ones add up."""
        (a, x), (b, y) = self.items(), other.items()
        every = np.concatenate([a, b])
        order = np.argsort(every, kind="stable")  # two sorted runs: the stable sort merges them
        every, counts = every[order], np.concatenate([x, y])[order]
        heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        q = max(self.q, other.q, slots_for(len(heads)))
        return CountingQuotientFilter.build(every[heads], np.add.reduceat(counts, heads) if len(heads) else counts, self.q + self.r - q, q)


def _filters(bits: int):
    """Per task: one filter for each slab, the top ``bits`` bits of the fingerprint."""
    rest = 64 - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, held = np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def packed():
            slab = (values >> np.uint64(rest)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
            cuts = [0, *(np.flatnonzero(slab[1:] != slab[:-1]) + 1).tolist(), len(slab)] if len(slab) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = values[a:b] & ((np.uint64(1) << np.uint64(rest)) - np.uint64(1)) if bits else values[a:b]
                q = slots_for(b - a)
                yield int(slab[a]), CountingQuotientFilter.build(own, counts[a:b], rest - q, q).to_bytes()

        def flush():
            rows = list(packed())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["slab", "filter"])

        for batch in batches:
            more, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            every = np.concatenate([values, more])
            order = np.argsort(every, kind="stable")
            every, c = every[order], np.concatenate([counts, n])[order]
            heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            values, counts = every[heads], np.add.reduceat(c, heads)
            held = len(values)
            if held > 2_000_000:
                yield flush()
                values, counts = values[:0], counts[:0]
        yield flush()

    return run


def _merge(bits: int):
    rest = 64 - bits

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        filters = [CountingQuotientFilter.from_bytes(x) for x in part["filter"]]
        while len(filters) > 1:  # pairwise, so each fingerprint is merged a logarithmic number of times
            filters = [a.merged(b[0]) if b else a for a, *b in (filters[i : i + 2] for i in range(0, len(filters), 2))]
        values, counts = filters[0].items()
        hot = counts > 1
        values = values[hot] | (np.uint64(key[0]) << np.uint64(rest) if bits else np.uint64(0))
        return pd.DataFrame({"fp": values.view(np.int64), "n": counts[hot]})

    return run


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints in ``fps`` (one long column) that occur more than once."""
    bits = max(0, min(40, int(np.ceil(np.log2(max(rows, 1) / SLAB)))))
    slabs = fps.mapInArrow(_filters(bits), "slab long, filter binary")
    return slabs.groupBy("slab").applyInPandas(_merge(bits), "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs`` (doc_id, text)."""
    norm = normalised()
    own = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("t")).select("doc_id", F.xxhash64("t").alias("fp"), F.unhex(F.sha2("t", 256)).alias("sha")), "fingerprints")
    repeated = written(repeated_fingerprints(own.select("fp"), own.count()), "repeated")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("t")).withColumn("fp", F.xxhash64("t"))
    texts = texts.join(hinted(repeated.select("fp"), 16), "fp", "left_semi")
    # grouping by the text itself compares the bytes; equal texts of a task are combined before they are sent
    groups = texts.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.filter("group_size > 1").select("fp", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size")
    out = own.join(groups, ["fp", "sha"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each normalised text, that of the smallest doc_id; all columns stay.

    Rows that tie (the same text and doc_id, or no doc_id in the whole group; ``exact_groups`` calls them all
    kept) are one row after it. Texts whose fingerprint is alone are passed on; the others are grouped by their
    bytes, each group with its best row so far, so equal texts of a task are combined before they are sent.
    """
    fps = written(docs.select(F.xxhash64(normalised()).alias("fp")), "fingerprints")
    repeated = written(repeated_fingerprints(fps, fps.count()).select(F.col("fp").alias("__fp")), "repeated")
    dropped(fps)
    own = docs.withColumn("__t", normalised())
    hot = hinted(repeated, 16)
    same = F.xxhash64("__t") == F.col("__fp")
    alone = own.join(hot, same, "left_anti").drop("__t")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    first = own.join(hot, same, "left_semi").groupBy("__t").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("__row"))
    return alone.unionByName(first.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
