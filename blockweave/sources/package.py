"""Binary packages of delta instructions: header, base id and one payload (prefix, metadata, inserted blocks).

The format is fixed by its readers: little-endian numbers, COPY and INSERT records with 16-bit places or
varints, blocks in zig-zag order, the payload raw or compressed with zstd at its highest level, whichever is
smaller. Packing and unpacking take one pair at a time; a pair is bounded by its image.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The format's magic, version and codes, and the zig-zag order of 64 coefficients.
MAGIC, VERSION, HEADER_BYTES = b"DDCTDDCT", 5, 52
ROUTES = ("FPM", "DCHash")
METADATA_CODEC, RAW, ZSTD = 1, 0, 1
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
HEAD = struct.Struct("<8sI4B9I")


class PackageError(ValueError):
    """A package that can't be read or written."""


@dataclass
class Copy:
    t_row: int
    t_col: int
    b_row: int
    b_col: int
    length: int


@dataclass
class Insert:
    t_row: int
    t_col: int
    block: np.ndarray  # components x 64


@dataclass
class Package:
    """A target's instructions against a base: sizes in blocks, the target's bytes before its first scan."""

    base_id: str
    route: str
    width: int
    height: int
    components: int
    instructions: list = field(default_factory=list)
    prefix: bytes = b""
    codec: int = RAW


def varint(n: int) -> bytes:
    """A number of 32 bits at most in groups of seven, low ones first."""
    if not 0 <= n < 1 << 32:
        raise PackageError(f"{n} is no unsigned number of 32 bits")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it)."""
    n = 0
    for k in range(5):
        if at + k >= len(data):
            raise PackageError("varint is cut off")
        n |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            return n, at + k + 1
    raise PackageError("varint of more than 5 bytes")


def merged(instructions: Iterable) -> list:
    """Neighbouring COPYs that go on in both grids as one."""
    out: list = []
    for x in instructions:
        last = out[-1] if out else None
        if isinstance(x, Copy) and isinstance(last, Copy) and (last.t_row, last.b_row, last.t_col + last.length, last.b_col + last.length) == (x.t_row, x.b_row, x.t_col, x.b_col):
            out[-1] = Copy(last.t_row, last.t_col, last.b_row, last.b_col, last.length + x.length)
        else:
            out.append(x)
    return out


def _numbers(kind: int, values: list[int]) -> bytes:
    if min(values) < 0:
        raise PackageError(f"negative place or length: {values}")
    if max(values) <= 0xFFFF:
        return bytes([kind, 1]) + struct.pack(f"<{len(values)}H", *values)
    return bytes([kind, 0]) + b"".join(map(varint, values))


def encoded(p: Package, codec: str = "auto") -> bytes:
    """The package's bytes. ``codec``: auto (zstd if strictly smaller), raw or zstd."""
    ins = merged(p.instructions)
    meta, blocks, n = [], [], 0
    order = list(ZIGZAG)
    for x in ins:
        if isinstance(x, Copy):
            if x.length < 1:
                raise PackageError("COPY without a length")
            meta.append(_numbers(0, [x.t_row, x.t_col, x.b_row, x.b_col, x.length]))
        else:
            if len(x.block) != p.components:
                raise PackageError("INSERT with another number of components")
            meta.append(_numbers(1, [x.t_row, x.t_col]))
            blocks.append(np.asarray(x.block, "<i2")[:, order].tobytes())
            n += 1
    meta, blocks = b"".join(meta), b"".join(blocks)
    payload = p.prefix + meta + blocks
    kept, code = payload, RAW
    if codec != "raw" and payload:
        small = zstandard.ZstdCompressor(level=zstandard.MAX_COMPRESSION_LEVEL).compress(payload)
        if codec == "zstd" or len(small) < len(payload):
            kept, code = small, ZSTD
    base = p.base_id.encode()
    return HEAD.pack(MAGIC, VERSION, ROUTES.index(p.route), METADATA_CODEC, code, 0, p.components, p.width, p.height, len(ins), n, len(base), len(p.prefix), len(meta), len(blocks)) + base + kept


def decoded(data: bytes) -> Package:
    """The package in ``data``; anything out of line is an error."""
    if len(data) < HEADER_BYTES:
        raise PackageError("shorter than a header")
    magic, version, route, meta_codec, codec, _, comps, width, height, count, inserts, base_n, prefix_n, meta_n, block_n = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or route >= len(ROUTES) or meta_codec != METADATA_CODEC or codec not in (RAW, ZSTD):
        raise PackageError("unknown magic, version, route or codec")
    if HEADER_BYTES + base_n > len(data):
        raise PackageError("base id is cut off")
    base_id, payload = data[HEADER_BYTES : HEADER_BYTES + base_n].decode(), data[HEADER_BYTES + base_n :]
    size = prefix_n + meta_n + block_n
    if codec == ZSTD:
        try:
            payload = zstandard.ZstdDecompressor().decompress(payload, max_output_size=size)
        except zstandard.ZstdError as e:
            raise PackageError(str(e)) from e
    if len(payload) != size:
        raise PackageError(f"payload of {len(payload)} bytes, {size} expected")
    meta = payload[prefix_n : prefix_n + meta_n]
    blocks = np.frombuffer(payload, "<i2", block_n // 2, prefix_n + meta_n)
    if block_n % 2 or len(blocks) != inserts * 64 * comps:
        raise PackageError("inserted blocks don't fit their number")
    natural = np.empty((inserts, comps, 64), np.int16)
    natural[:, :, list(ZIGZAG)] = blocks.reshape(inserts, comps, 64)
    out, at, k = [], 0, 0
    for _ in range(count):
        if at + 2 > len(meta) or meta[at] > 1 or meta[at + 1] > 1:
            raise PackageError("metadata is cut off or unknown")
        kind, short, at = meta[at], meta[at + 1], at + 2
        n = 2 if kind else 5
        if short:
            if at + 2 * n > len(meta):
                raise PackageError("metadata is cut off")
            values, at = struct.unpack_from(f"<{n}H", meta, at), at + 2 * n
        else:
            values = []
            for _ in range(n):
                v, at = read_varint(meta, at)
                values.append(v)
        if kind:
            if k == inserts:
                raise PackageError("more INSERTs than blocks")
            out.append(Insert(*values, natural[k]))
            k += 1
        else:
            out.append(Copy(*values))
    if at != len(meta) or k != inserts:
        raise PackageError("trailing metadata or blocks")
    return Package(base_id, ROUTES[route], width, height, comps, out, bytes(payload[:prefix_n]), codec)


def as_instructions(rows: Iterable) -> list:
    """Copies and Inserts of rows (kind, t_row, t_col, b_row, b_col, length, block)."""
    return [Copy(int(r.t_row), int(r.t_col), int(r.b_row), int(r.b_col), int(r.length)) if r.kind == "COPY" else Insert(int(r.t_row), int(r.t_col), np.array([np.asarray(c, np.int16) for c in r.block])) for r in rows]


def pack(instructions: DataFrame, heads: DataFrame, codec: str = "auto") -> DataFrame:
    """(pair_id, payload): a package for each pair. ``heads``: pair_id, base_id, route, width, height, components, prefix (binary, may be null)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        h = part.iloc[0]
        p = Package(h.base_id, h.route, int(h.width), int(h.height), int(h.components), as_instructions(part[part["kind"].notna()].itertuples()), bytes(h.prefix) if h.prefix is not None else b"")
        return pd.DataFrame({"pair_id": [key[0]], "payload": [encoded(p, codec)]})

    return heads.join(instructions, "pair_id", "left").groupBy("pair_id").applyInPandas(run, "pair_id string, payload binary")


def unpack(packages: DataFrame) -> DataFrame:
    """Instruction rows of packages (pair_id, payload): pair_id, base_id, route, width, height, components, codec, seq, kind, places, length, block, error.

    A package that can't be read gives one row with the error and nulls.
    """
    names = ["pair_id", "base_id", "route", "width", "height", "components", "codec", "seq", "kind", "t_row", "t_col", "b_row", "b_col", "length", "block", "error"]

    def rows(pair, data):
        try:
            p = decoded(bytes(data))
        except PackageError as e:
            yield (pair, *[None] * 14, str(e))
            return
        head = (pair, p.base_id, p.route, p.width, p.height, p.components, "zstd" if p.codec else "raw")
        for i, x in enumerate(p.instructions):
            if isinstance(x, Copy):
                yield (*head, i, "COPY", x.t_row, x.t_col, x.b_row, x.b_col, x.length, None, None)
            else:
                yield (*head, i, "INSERT", x.t_row, x.t_col, None, None, None, x.block.tolist(), None)

    def run(batches):
        for batch in batches:
            out = pd.DataFrame([r for pair, data in zip(batch["pair_id"], batch["payload"], strict=True) for r in rows(pair, data)], columns=names)
            yield out.astype({c: "Int32" for c in ("width", "height", "components", "seq", "t_row", "t_col", "b_row", "b_col", "length")})

    kinds = "pair_id string, base_id string, route string, width int, height int, components int, codec string, seq int, kind string, t_row int, t_col int, b_row int, b_col int, length int, block array<array<smallint>>, error string"
    return packages.select("pair_id", "payload").mapInPandas(run, kinds)


def raw_size(base_id, prefix_bytes, meta_bytes, insert_bytes):
    """Bytes of a package whose payload is not compressed."""
    return F.lit(HEADER_BYTES) + F.octet_length(base_id) + prefix_bytes + meta_bytes + insert_bytes
