"""Made-up JPEG pairs for benchmarks: watermarks, shifts, coarser quantisation, and mixtures. Same files for the same seed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from . import jpeg

# Seed, size in pixels, logos and their share of the width, shifts, by strength.
SEED, SIDE = 2024, 1024
LOGOS = {"Light": (1, 0.05, 0.10), "Medium": (3, 0.10, 0.15), "Heavy": (6, 0.15, 0.25)}
STRESS = {"Light": (16, 2), "Medium": (32, 3), "Heavy": (48, 5)}
SHIFT = (32, 16)


def picture(rng: np.random.Generator, side: int) -> np.ndarray:
    """Coefficients (rows x cols x 3 x 64) of a smooth picture with detail."""
    n = side // 8
    out = np.zeros((n, n, 3, 64), np.int16)
    wave = np.cumsum(np.cumsum(rng.normal(0, 6, (n, n, 3)), axis=0), axis=1) / np.sqrt(n)
    out[..., 0] = np.clip(wave + rng.normal(0, 15, (n, n, 3)), -500, 500)
    low = [1, 8, 9, 2, 16, 10, 17]
    out[..., low] = rng.normal(0, 8, (n, n, 3, len(low)))
    return out


def file_of(blocks: np.ndarray, quantisation: int = 2) -> bytes:
    """The file of a picture, all sampling factors 1."""
    n, m = blocks.shape[:2]
    comps = [jpeg.Component(i + 1, 1, 1, 0, m, n, np.ascontiguousarray(blocks[:, :, i])) for i in range(blocks.shape[2])]
    return jpeg.encode(jpeg.Image(m * 8, n * 8, comps), {0: np.full(64, quantisation, np.int64)})


def marked(blocks: np.ndarray, rng: np.random.Generator, logos: int, least: float, most: float) -> np.ndarray:
    """A copy with logos pasted on the block grid."""
    out = blocks.copy()
    n = len(out)
    for _ in range(logos):
        k = max(1, int(n * rng.uniform(least, most)))
        r, c = rng.integers(0, n - k + 1, 2)
        out[r : r + k, c : c + k] = picture(rng, k * 8)
    return out


def moved(blocks: np.ndarray, right: int, down: int) -> np.ndarray:
    """A copy moved by pixels (whole blocks) on black."""
    out = np.zeros_like(blocks)
    out[..., 0] = -512
    r, c = down // 8, right // 8
    out[r:, c:] = blocks[: len(blocks) - r, : blocks.shape[1] - c]
    return out


def coarser(blocks: np.ndarray, factor: int) -> np.ndarray:
    """Coefficients under a quantisation ``factor`` times as coarse."""
    return np.rint(blocks / factor).astype(np.int16)


def pairs(kind: str, count: int, side: int = SIDE, seed: int = SEED) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files of a data set: watermark_<strength>, shift, quality or stress_<strength>."""
    name, _, strength = kind.partition("_")
    for i in range(count):
        rng = np.random.default_rng([seed, i])
        base = picture(rng, side)
        if name == "watermark":
            yield f"{i}_base.jpg", file_of(base)
            yield f"{i}_target.jpg", file_of(marked(base, rng, *LOGOS[strength]))
        elif name == "shift":
            yield f"{i}_base.jpg", file_of(base)
            yield f"{i}_target_shifted.jpg", file_of(moved(base, *SHIFT))
        elif name == "quality":
            yield f"{i}_base_Q90.jpg", file_of(base)
            yield f"{i}_target_Q75.jpg", file_of(coarser(base, 2), 4)
            yield f"{i}_target_Q60.jpg", file_of(coarser(base, 4), 8)
        elif name == "stress":
            shift, logos = STRESS[strength]
            yield f"{i}_base.jpg", file_of(base)
            yield f"{i}_target_stress.jpg", file_of(marked(moved(base, shift, shift), rng, logos, 0.05, 0.15))
        else:
            raise ValueError(f"unknown data set {kind!r}")


def write(folder: str, kind: str, count: int, side: int = SIDE, seed: int = SEED) -> int:
    """Writes a data set's files; how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for name, content in pairs(kind, count, side, seed):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(content)
        n += 1
    return n
