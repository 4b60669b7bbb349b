"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a token.
Tier two: the rest is merged by a heap of candidate merges over a doubly linked list of byte pieces.
Each Python worker keeps a bounded memo of pre-tokens; it only saves repeated work.

The vocabulary file is a parameter. Its bytes are read through Spark on the driver, the tables are built
once and broadcast: their size is that of the vocabulary, whatever the corpus.

Edge cases: null text encodes like the empty text (no ids); bytes that are no UTF-8 are read as U+FFFD each, and so
decode to U+FFFD (Python's "replace"); other columns are ignored or carried along as
they are; a text of any length is one row, and a pre-token of any length takes n log n steps.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import give_back

#: Pre-tokens that a generation of a worker's memo holds.
MEMO = 200_000
#: Text characters put into one output batch.
OUT_CHARS = 1 << 20


class MinimalPerfectHash:
    """Hash and displace: keys of a bucket share a displacement that puts them on free slots; n keys, n slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        slot_of = np.full(self.n, -1, np.int64)
        free = np.ones(self.n, bool)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate(([0], np.cumsum(size)))
        tries = np.arange(256, dtype=np.uint64)
        for k in np.argsort(-size, kind="stable").tolist():
            own = order[first[k] : first[k + 1]]
            if not len(own):
                break
            base = 0
            while True:
                at = self._at(h[own][None, :], (tries + np.uint64(base))[:, None])
                fits = free[at].all(axis=1)
                if len(own) > 1:
                    s = np.sort(at, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    t = int(np.argmax(fits))
                    self.shift[k] = base + t
                    free[at[t]] = False
                    slot_of[own] = at[t]
                    break
                base += len(tries)
                if base > 1 << 24:
                    raise ValueError("no displacement found: repeated keys?")
        self.slot_of = slot_of

    def _at(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (h ^ (h >> np.uint64(32))) * (np.uint64(2) * shift + np.uint64(0x9E3779B97F4A7C15))
        return ((x >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        x = (h ^ (h >> 32)) * (2 * int(self.shift[h % self.buckets]) + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n


class Vocabulary:
    """The ranks of a vocabulary, the minimal perfect hash over its tokens and the pre-token pattern."""

    def __init__(self, rank_lines: bytes, pattern: str) -> None:
        self.pattern = pattern
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_lines.splitlines() if line.strip())}
        self.ranks = ranks
        keys = list(ranks)
        mph = MinimalPerfectHash(keys)
        self.mph = mph
        self.token_at: list[bytes] = [b""] * len(keys)
        for k, s in zip(keys, mph.slot_of.tolist(), strict=True):
            self.token_at[s] = k
        mph.slot_of = None
        self.token = {r: t for t, r in ranks.items()}

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        slot = self.mph.slot(piece)
        if self.token_at[slot] == piece:
            return [self.ranks[piece]]
        return self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        n = len(piece)
        # a piece is known by its first byte's place; end[i] is where it ends, before[i] where its left one begins
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, mid, stop = pop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue  # one of its pieces has merged since
            end[i] = stop
            end[mid] = -1
            if stop < n:
                before[stop] = i
                far = end[stop]
                r = ranks.get(piece[i:far])
                if r is not None:
                    push(heap, (r, i, stop, far))
            left = before[i]
            if left >= 0:
                r = ranks.get(piece[left:stop])
                if r is not None:
                    push(heap, (r, left, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


class _Memo(dict):
    """Ids of pre-tokens seen of late: a young and an old generation of at most MEMO each."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.vocabulary.encode_piece(piece.encode())
            ids = struct.pack(f"<{len(found)}i", *found)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_WORKER: dict = {}


def _tools(vocabulary, key: str):
    if _WORKER.get("key") != key:
        v = vocabulary.value
        _WORKER.update(key=key, v=v, memo=_Memo(v), split=regex.compile(v.pattern).findall)
    return _WORKER["v"], _WORKER["memo"], _WORKER["split"]


def load_vocabulary(spark: SparkSession, path: str, pattern: str):
    """(broadcast, key) of the vocabulary file at ``path``; each session builds it once a path."""
    key = f"{spark.sparkContext.applicationId}|{path}|{pattern}"
    if key not in _LOADED:
        try:
            with open(path, "rb") as f:
                lines = f.read()
        except OSError:  # a path that only Spark reads
            lines = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        _LOADED.clear()
        _LOADED[key] = spark.sparkContext.broadcast(Vocabulary(lines, pattern))
    return _LOADED[key], key


_LOADED: dict = {}


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of the text column; with ``decoded``, also ``bytes``, decoded from the ids."""
    vocabulary, key = load_vocabulary(docs.sparkSession, path, pattern)
    others = [c for c in docs.columns if c not in (text, "ids", "bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, memo, split = _tools(vocabulary, key)
        get, token = memo.__getitem__, v.token.__getitem__
        for batch in batches:
            texts, at, begin, chars = batch.column(len(others)), 0, 0, 0
            ids: list[np.ndarray] = []
            back: list[bytes] = []
            for at in range(len(batch)):
                t = (texts[at].as_py() or b"").decode("utf-8", "replace")
                own = np.frombuffer(b"".join(map(get, split(t))), np.int32)
                ids.append(own)
                if decoded:
                    back.append(b"".join(map(token, own.tolist())))
                chars += len(t)
                if chars > OUT_CHARS or at + 1 == len(batch):
                    cols = [batch.column(i).slice(begin, at + 1 - begin) for i in range(len(others))]
                    cols += [_lists(ids, pa.int32())] + ([pa.array(back, pa.binary())] if decoded else [])
                    yield pa.RecordBatch.from_arrays(cols, [*others, "ids", *["bytes"] * decoded])
                    begin, chars, ids, back = at + 1, 0, [], []
        give_back()

    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).cast("string").cast("binary").alias("__text"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "ids array<int>", *["bytes binary"] * decoded])
    return kept.mapInArrow(run, kinds)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``bytes`` decoded from the column ``ids`` (null: no bytes); an id outside the vocabulary is an error."""
    vocabulary, key = load_vocabulary(rows.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tools(vocabulary, key)[0].token.__getitem__
        for batch in batches:
            back = [b"".join(map(token, x or ())) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(back, pa.binary())], [*batch.schema.names[:-1], "bytes"])

    others = [c for c in rows.columns if c != "bytes"]
    kept = rows.select(*[F.col(f"`{c}`") for c in others], F.col(ids).alias("__ids"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "bytes binary"])
    return kept.mapInArrow(run, kinds)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from ``encode(..., decoded=True)``."""
    return encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
