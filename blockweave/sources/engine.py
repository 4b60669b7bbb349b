"""Single pairs of JPEG files: compress a target against a base, restore it, and the features that find bases.

These are the per-file steps of the tables' operators, for callers with files at hand and for the tasks that
handle one pair each; grids are numpy arrays (height x width x components x 64).
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from enum import Enum

import numpy as np

from ..functions import u64
from . import jpeg, package
from .package import Copy, Insert

TOLERANCE, SAME_POSITION = 64, 0.6


class RoutingMode(Enum):
    """How the encoder is chosen: by the pair, or always fixed positions, or always block keys."""

    AUTO = "auto"
    FPM = "fpm"
    DCHASH = "dchash"

    @classmethod
    def parse(cls, name: str) -> RoutingMode:
        return cls(name.strip().lower())


@dataclass
class CompressOptions:
    window_size: int = 2
    num_transforms: int = 10
    strict_lossless: bool = True
    routing_mode: RoutingMode = RoutingMode.AUTO
    codec: str = "auto"


@dataclass
class DedupResult:
    """What compressing a pair gave; a failure has success false and a reason."""

    success: bool = False
    reason: str = ""
    route: str = ""
    original_size: int = 0
    compressed_size: int = 0
    compression_ratio: float = 0.0
    blocks_total: int = 0
    blocks_exact: int = 0
    blocks_similar: int = 0
    blocks_different: int = 0
    block_width: int = 0
    block_height: int = 0
    header_bytes: int = 0
    copy_meta_bytes: int = 0
    insert_raw_bytes: int = 0
    similarity_seconds: float = 0.0
    delta_seconds: float = 0.0
    throughput_mb_s: float = 0.0
    block_map: list = field(default_factory=list)

    def as_row(self) -> dict:
        return asdict(self)


def grid(image: jpeg.Image) -> np.ndarray:
    """All components' blocks by cell; only for images whose sampling factors are all 1."""
    if any((c.h, c.v) != (1, 1) for c in image.components):
        raise jpeg.JpegError("all components need sampling factors of 1")
    return np.stack([c.blocks for c in image.components], axis=2)


def signature(luma: np.ndarray, size: int = 2, transforms: int = 10) -> list[tuple[int, int, int, int, int]]:
    """(transform, hash, window hash, row, col) for each transform, of a luma grid (height x width x 64)."""
    dc = luma[:, :, 0].astype(np.int64)
    if size < 1 or size > 8 or size > min(dc.shape):
        raise ValueError("window size must be 1 to 8 and fit the grid")
    total = int(dc.sum())
    mean = abs(total) // dc.size * (1 if total >= 0 else -1)  # towards zero
    bit = (dc >= mean).astype(np.uint64)
    value = (dc & 0xFFFF).astype(np.uint64) | bit << np.uint64(16)
    rows, cols = dc.shape[0] - size + 1, dc.shape[1] - size + 1
    h, bits = np.full((rows, cols), u64.FOLD_START, np.uint64), np.zeros((rows, cols), np.uint64)
    for r in range(size):
        for c in range(size):
            h = (h ^ value[r : r + rows, c : c + cols]) * np.uint64(u64.FOLD_FACTOR)
            bits = bits << np.uint64(1) | bit[r : r + rows, c : c + cols]
    x = h ^ bits * np.uint64(u64.BITS_FACTOR)
    for factor in (u64.MIX_1, u64.MIX_2):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    x = x ^ x >> np.uint64(33)
    at = np.argwhere((bits != 0) & (bits != np.uint64((1 << size * size) - 1)))
    if not len(at):
        raise ValueError("no window with both bright and dark blocks")
    windows = x[at[:, 0], at[:, 1]]
    out = []
    for i, (a, b) in enumerate(u64.linear_parameters(transforms)):
        t = windows * np.uint64(a) + np.uint64(b)
        k = int(t.argmin())  # the first in scan order
        out.append((i, int(t[k]), int(windows[k]), int(at[k, 0]), int(at[k, 1])))
    return out


def equal_cells(a: np.ndarray, b: np.ndarray, strict: bool) -> np.ndarray:
    """Whether cells (... x components x 64) are equal, or within the tolerance in each component."""
    return (a == b).all(axis=(-1, -2)) if strict else (np.abs(a.astype(np.int32) - b).sum(axis=-1) <= TOLERANCE).all(axis=-1)


def choose_route(target: np.ndarray, base: np.ndarray, hint: tuple | None, mode: RoutingMode, strict: bool) -> str:
    """FPM or DCHash; ``hint`` is (target row, target col, base row, base col) of the first features, or None."""
    if mode is not RoutingMode.AUTO:
        return "FPM" if mode is RoutingMode.FPM else "DCHash"
    if hint:
        return "FPM" if hint[:2] == hint[2:] else "DCHash"
    return "FPM" if equal_cells(target, base, strict).mean() >= SAME_POSITION else "DCHash"


def fpm(target: np.ndarray, base: np.ndarray, strict: bool, min_copy: int = 1) -> list:
    """Runs of equal same-position cells as COPYs, other cells as INSERTs."""
    eq, out = equal_cells(target, base, strict), []
    for r in range(len(eq)):
        cuts = [0, *(np.flatnonzero(eq[r, 1:] != eq[r, :-1]) + 1).tolist(), eq.shape[1]]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += [Copy(r, a, r, a, b - a)] if eq[r, a] and b - a >= min_copy else [Insert(r, c, target[r, c]) for c in range(a, b)]
    return out


def block_keys(cells: np.ndarray) -> np.ndarray:
    """Keys of cells: four low coefficients of the first component, halved, a byte each."""
    low = (cells[..., 0, [0, 1, 8, 9]].astype(np.int64) >> 1) & 255
    return low[..., 0] << 24 | low[..., 1] << 16 | low[..., 2] << 8 | low[..., 3]


def dchash(target: np.ndarray, base: np.ndarray, strict: bool, min_copy: int = 1) -> list:
    """Left to right in each row: the longest run from a base cell of the same key (the first of them), else an INSERT."""
    places: dict[int, list] = {}
    for r, row in enumerate(block_keys(base).tolist()):
        for c, k in enumerate(row):
            places.setdefault(k, []).append((r, c))
    keys, out = block_keys(target).tolist(), []
    width = target.shape[1]
    for r in range(len(target)):
        c = 0
        while c < width:
            best, at = 0, None
            for br, bc in places.get(keys[r][c], ()):
                n = min(width - c, width - bc)
                eq = equal_cells(target[r, c : c + n], base[br, bc : bc + n], strict)
                n = n if eq.all() else int(eq.argmin())
                if n > best:
                    best, at = n, (br, bc)
            if at and best >= min_copy:
                out.append(Copy(r, c, *at, best))
                c += best
            else:
                out.append(Insert(r, c, target[r, c]))
                c += 1
    return package.merged(out)


def replayed(instructions: list, base: np.ndarray) -> np.ndarray:
    """The grid that the instructions make; every cell must be filled."""
    out, filled = np.zeros_like(base), np.zeros(base.shape[:2], bool)
    height, width = filled.shape
    for x in instructions:
        n = x.length if isinstance(x, Copy) else 1
        spans = [(x.t_row, x.t_col)] + ([(x.b_row, x.b_col)] if isinstance(x, Copy) else [])
        if n < 1 or any(not (0 <= r < height and 0 <= c and c + n <= width) for r, c in spans):
            raise package.PackageError("instruction outside the grid")
        out[x.t_row, x.t_col : x.t_col + n] = base[x.b_row, x.b_col : x.b_col + n] if isinstance(x, Copy) else x.block
        filled[x.t_row, x.t_col : x.t_col + n] = True
    if not filled.all():
        raise package.PackageError("cells are left unfilled")
    return out


def compress(target: bytes, base: bytes, base_id: str, options: CompressOptions = CompressOptions(), hint: tuple | None = None) -> tuple[DedupResult, bytes]:
    """(result, package) of a target against a base. Strict results are checked to restore the target's bytes."""
    result = DedupResult(original_size=len(target))
    try:
        t, b = jpeg.read(target), jpeg.read(base)
        start = time.perf_counter()
        size, transforms = max(1, options.window_size), max(1, options.num_transforms)
        ts, bs = (signature(x.components[x.luma()].blocks, size, transforms) for x in (t, b))
        hint = hint or (ts[0][3], ts[0][4], bs[0][3], bs[0][4])
        result.similarity_seconds = time.perf_counter() - start
        tg, bg = grid(t), grid(b)
        if tg.shape != bg.shape:
            raise jpeg.JpegError("grids of different shapes")
        start = time.perf_counter()
        strict = options.strict_lossless
        result.route = choose_route(tg, bg, hint, options.routing_mode, strict)
        ins = (fpm if result.route == "FPM" else dchash)(tg, bg, strict)
        result.delta_seconds = time.perf_counter() - start
    except (jpeg.JpegError, ValueError, KeyError, IndexError) as e:
        result.reason = str(e)
        return result, b""
    p = package.Package(base_id, result.route, tg.shape[1], tg.shape[0], tg.shape[2], ins, jpeg.header_prefix(target))
    data = package.encoded(p, options.codec)
    if strict and restore(data, base) != target:
        result.reason = "the target's scan is not coded as the writer codes it"
        return result, b""
    copied = np.zeros(tg.shape[:2], np.int8)
    exact = 0
    for x in ins:
        if isinstance(x, Copy):
            copied[x.t_row, x.t_col : x.t_col + x.length] = 1
            exact += int(equal_cells(tg[x.t_row, x.t_col : x.t_col + x.length], bg[x.b_row, x.b_col : x.b_col + x.length], True).sum())
    result.blocks_total, result.blocks_exact = copied.size, exact
    result.blocks_similar = int(copied.sum()) - exact
    result.blocks_different = copied.size - int(copied.sum())
    result.block_width, result.block_height = tg.shape[1], tg.shape[0]
    result.header_bytes = len(p.prefix)
    copies = [x for x in ins if isinstance(x, Copy)]
    result.copy_meta_bytes = sum(len(package._numbers(0, [x.t_row, x.t_col, x.b_row, x.b_col, x.length])) for x in copies)
    result.insert_raw_bytes = (len(ins) - len(copies)) * 128 * tg.shape[2]
    result.block_map = copied.reshape(-1).tolist()
    result.compressed_size, result.success = len(data), True
    result.compression_ratio = len(target) / len(data)
    seconds = result.similarity_seconds + result.delta_seconds
    result.throughput_mb_s = len(target) / 1048576 / seconds if seconds > 0 else 0.0
    return result, data


def restore(data: bytes, base: bytes) -> bytes:
    """The target's bytes from its package and the base's bytes."""
    p, image = package.decoded(data), jpeg.read(base)
    made = grid(image)
    if made.shape[:3] != (p.height, p.width, p.components):
        raise package.PackageError("the base has another shape")
    made = replayed(p.instructions, made)
    for i, c in enumerate(image.components):
        c.blocks = made[:, :, i]
    return jpeg.with_prefix(jpeg.write(base, image), p.prefix)
