"""MinHash near-dedup with SuperMinHash signatures, banding, exact verification and union-find grouping.

SuperMinHash: every element of a set walks its own random permutation of the signature slots; at step j it
offers j + u (u uniform) to the j-th slot of its walk and each slot keeps the least offer. The offers of one
element are correlated (no slot twice), which lowers the variance, and a set is done as soon as every slot
holds an offer of a step already taken: all later offers are larger. Here a chunk of documents takes each
step together, and finished documents leave.

Links: documents of equal shingle sets form a class. Class representatives that agree on all rows of a band
share a bucket. A bucket is resolved without all its pairs being emitted:

* up to SMALL members: its pairs;
* larger: every member against the bucket's hub (the smallest id); then, where the bucket still spans
  several components, against a hub drawn at random per bucket;
* what still spans several components goes, whole, through tiles of bounded size: the members outside the
  bucket's main component against all members. A tile emits a spanning forest of verified links only.

Every link is verified on the full shingle sets (100 * |A and B| >= 80 * |A or B|, both parameters), so
components are exact up to the chance that a linked pair shares no band: 1.9e-6 at similarity 0.8 exactly,
less above.

Edge cases: null or blank text has an empty set, is linked with nothing and is its own component; with fewer
words than a shingle has, the whole sequence is one shingle; equal sets are linked whatever the texts'
spacing; rows with a null doc_id stay, with null component and kept true; rows that repeat give a row each (a
doc_id is taken to name one text); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, roots_local
from .common import dropped, hinted, written
from .textkit import U, give_back, mix, shingle_sets

#: Members up to which a bucket's pairs are listed.
SMALL = 8
#: Members of a tile's side.
TILE = 256
#: Elements walked together; bounds the permutation table (elements x slots bytes).
WALK = 1 << 15


@dataclass(frozen=True)
class Banding:
    """``bands`` x ``rows`` slots; words of a shingle; a link needs ``percent`` % similarity."""

    bands: int = 25
    rows: int = 4
    words: int = 5
    percent: int = 80

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def superminhash(h: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m, uint64; all ones for an empty set) of sets given as hashes with offsets."""
    n_docs = len(off) - 1
    sig = np.full((n_docs, m), ~U(0), np.uint64)
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    flat = sig.reshape(-1)
    # step 0: no permutation table needed, every element offers to its first slot
    x = mix(h + U(0x632BE59BD9B4E019))
    first = (x % U(m)).astype(np.int64)
    offer = mix(x ^ U(0xA0761D6478BD642F)) >> U(16)  # 48 bits of u; the step goes above them
    np.minimum.at(flat, doc * m + first, offer)
    open_docs = np.flatnonzero((sig == ~U(0)).any(axis=1) & (np.diff(off) > 0))
    a = 0
    size = np.diff(off)
    while a < len(open_docs):
        b, n = a, 0
        while b < len(open_docs) and (b == a or n + size[open_docs[b]] <= WALK):
            n += size[open_docs[b]]
            b += 1
        rows = open_docs[a:b]
        _walk(sig, rows, np.concatenate([np.arange(off[r], off[r + 1]) for r in rows]), x, first, size[rows], m)
        a = b
    return sig


def _walk(sig: np.ndarray, rows: np.ndarray, elements: np.ndarray, x: np.ndarray, first: np.ndarray, sizes: np.ndarray, m: int) -> None:
    """Steps 1, 2, ... for the documents ``rows`` whose signatures still have empty slots."""
    own = np.repeat(np.arange(len(rows)), sizes)
    part = sig[rows]
    seed, walk = x[elements], np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), m)).copy()
    i = np.arange(len(elements))
    f = first[elements]
    walk[i, f] = 0  # the swap of step 0
    walk[i, 0] = f
    for j in range(1, m):
        seed = mix(seed + U(0x9E3779B97F4A7C15))
        k = j + (seed % U(m - j)).astype(np.int64)
        slot = walk[i, k]
        walk[i, k] = walk[i, j]
        walk[i, j] = slot
        offer = (mix(seed ^ U(0xA0761D6478BD642F)) >> U(16)) | (U(j) << U(48))
        np.minimum.at(part.reshape(-1), own * m + slot, offer)
        full = ~(part == ~U(0)).any(axis=1)
        if full.all():
            break
        if full.any() and j % 4 == 0:
            live = ~full[own]
            own, seed, walk = own[live], seed[live], walk[live]
            i = np.arange(len(own))
    sig[rows] = part


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number within."""
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """(doc_id, n, digest, bands): set size, digest of the sorted set, band keys (none for an empty set)."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, off in shingle_sets(batch.column(1), banding.words):
                n = np.diff(off)
                keys = band_keys(superminhash(s, off, banding.slots), banding.bands, banding.rows)
                digest = [hashlib.blake2b(s[i:j].tobytes(), digest_size=16).digest() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                has = n > 0
                starts = np.concatenate(([0], np.cumsum(has * banding.bands))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(starts), pa.array(keys[has].reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands.cast(kind)], ["doc_id", "n", "digest", "bands"])
        give_back()

    return _id_and_text(docs).mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>")


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct 64-bit shingle hashes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, off in shingle_sets(batch.column(1), words):
                raw = [s[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(raw, pa.binary())], ["doc_id", "shingles"])
        give_back()

    return _id_and_text(docs).mapInArrow(run, "doc_id long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among ``pairs`` (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = [linked(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _tile(percent: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = part.drop_duplicates("doc_id").reset_index(drop=True)
        rest = part.loc[part["rest"], "doc_id"].unique()
        rest = rows.index[rows["doc_id"].isin(rest)].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        every, off = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))
        label, ids = rows["label"].to_numpy(), rows["doc_id"].to_numpy()
        a, b = [], []
        for i in rest.tolist():
            s = sets[i]
            at = np.searchsorted(s, every)
            hit = s[np.minimum(at, len(s) - 1)] == every
            both = np.add.reduceat(hit, off[:-1], dtype=np.int64)
            ok = (100 * both >= percent * (size + len(s) - both)) & (label != label[i])
            ok[i] = False
            for j in np.flatnonzero(ok).tolist():
                a.append(i)
                b.append(j)
        a, b = roots_local(len(rows), np.array(a, np.int64), np.array(b, np.int64))
        return pd.DataFrame({"u": ids[a], "v": ids[b]}, columns=["u", "v"])

    return run


def near_groups(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text)."""
    percent = banding.percent
    sig = written(signatures(docs, banding), "signatures")
    classes = written(sig.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    copies = written(sig.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    extra = copies.filter("doc_id <> rep").select("doc_id")
    reps = sig.filter("n > 0 and doc_id is not null").join(hinted(extra, 16), "doc_id", "left_anti")
    entries = written(reps.select("doc_id", "n", F.explode("bands").alias("band")), "bands")
    # sums by band are written before they are joined: a join right above its own aggregation can't be split at a hot band
    buckets = written(entries.groupBy("band").agg(F.count("*").alias("size"), F.min("doc_id").alias("hub")).filter("size > 1"), "sizes")
    shared = written(entries.join(buckets, "band").select("band", "doc_id", "n", "size", "hub"), "buckets")
    dropped(sig, classes, entries, buckets)

    cands = written(shared.select("doc_id").distinct(), "candidates")
    sets = written(set_table(docs.join(hinted(cands, 16), "doc_id", "left_semi"), banding.words), "sets")

    few = shared.filter(f"size <= {SMALL}")
    other = few.select("band", F.col("doc_id").alias("v"), F.col("n").alias("nv"))
    fits = f"100 * least(n, nv) >= {percent} * greatest(n, nv)"
    near = few.join(other, "band").filter("doc_id > v").filter(fits).select(F.col("doc_id").alias("u"), "v")
    hubs = shared.filter(f"size > {SMALL} and doc_id <> hub").select(F.col("doc_id").alias("u"), F.col("hub").alias("v"))
    links = written(verified(written(near.union(hubs).distinct(), "pairs"), sets, percent), "links")
    labels = components(links)

    large = shared.filter(f"size > {SMALL}").select("band", "doc_id", "n")
    if not large.isEmpty():
        # a hub drawn at random for each bucket, among buckets that span several components
        spread = written(_spanning(large, labels), "spanning")
        if not spread.isEmpty():
            drawn = written(spread.groupBy("band").agg(F.min(F.xxhash64("doc_id", "band")).alias("least")), "drawn")
            drawn = spread.withColumn("least", F.xxhash64("doc_id", "band")).join(drawn, ["band", "least"]).select("band", F.col("doc_id").alias("v"), F.col("label").alias("lv"), F.col("n").alias("nv"))
            drawn = written(drawn, "drawn")
            more = spread.join(drawn, "band").filter("label <> lv").filter(fits)
            more = written(verified(more.select(F.greatest("doc_id", "v").alias("u"), F.least("doc_id", "v").alias("v")).distinct(), sets, percent), "links")
            links = links.union(more)
            labels = components(links)
            spread = written(_spanning(spread.select("band", "doc_id", "n"), labels), "spanning")
        if not spread.isEmpty():
            links = links.union(written(_swept(spread, sets, percent), "links"))
            labels = components(links)

    dropped(shared, cands, sets)
    label = labels.select(F.col("node").alias("rep"), "component")
    out = copies.join(label, "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _spanning(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The bucket entries (band, doc_id, n) with their label, of buckets that hold more than one label."""
    known = entries.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    known = known.select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    known = written(known, "labelled")
    wide = written(known.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band"), "wide")
    return known.join(wide, "band", "left_semi")


def _swept(spread: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different labels within the buckets ``spread``, by tiles of bounded size."""
    sizes = spread.groupBy("band", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("band").agg(F.sum("c").alias("size"), F.max_by("label", "c").alias("main"), F.max("c").alias("most"))
    main = written(main, "main")
    known = spread.join(main, "band").withColumn("is_rest", F.col("label") != F.col("main"))
    rows = F.greatest(F.lit(1), F.ceil(F.col("size") / TILE)).cast("int")
    cols = F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("most")) / TILE)).cast("int")
    known = known.select("band", "doc_id", "label", "is_rest", rows.alias("rows"), cols.alias("cols"))
    row, col = F.pmod(F.xxhash64("doc_id"), "rows").cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "cols").cast("int")
    every = known.select("band", "doc_id", "label", F.lit(False).alias("rest"), row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    rest = known.filter("is_rest").select("band", "doc_id", "label", F.lit(True).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), col.alias("j"))
    tiles = every.union(rest).join(sets, "doc_id")
    return tiles.groupBy("band", "i", "j").applyInPandas(_tile(percent), "u long, v long")


def drop_near_copies(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; all columns stay."""
    gone = written(near_groups(docs.select("doc_id", "text"), banding).filter("not kept").select(F.col("doc_id").alias("__gone")), "gone")
    return docs.join(hinted(gone, 16), F.col("doc_id") == F.col("__gone"), "left_anti")
