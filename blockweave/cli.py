"""Commands: scan, restore, benchmark, and the steps of a pair of files.

Exit codes: 0 done, 2 missing input or failed verification, 3 nothing to do for benchmark.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import zlib
from pathlib import Path

from .api import compress_image, decompress_image
from .sources import archive, engine, jpeg, package


def _read(path: str) -> bytes:
    return Path(path).read_bytes()


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("blockweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def luma_lines(data: bytes) -> str:
    image = jpeg.read(data)
    c = image.components[image.luma()]
    return "\n".join([f"{c.width} {c.height}", *(" ".join(map(str, b)) for b in c.blocks.reshape(-1, 64).tolist())]) + "\n"


def with_luma(data: bytes, text: str) -> bytes:
    """A file with its luma replaced by a luma text of the same geometry."""
    import numpy as np

    image = jpeg.read(data)
    c = image.components[image.luma()]
    words = text.split()
    width, height = int(words[0]), int(words[1])
    if width < 1 or height < 1:
        raise ValueError("sizes must be positive")
    values = [int(x) for x in words[2 : 2 + width * height * 64]]
    if len(values) < width * height * 64 or any(not -32768 <= v <= 32767 for v in values):
        raise ValueError("numbers are missing or are no 16-bit integers")
    if (width, height) != (c.width, c.height):
        raise ValueError("another geometry")
    c.blocks = np.array(values, np.int16).reshape(height, width, 64)
    return jpeg.write(data, image)


def signature_lines(data: bytes, size: int, transforms: int) -> str:
    image = jpeg.read(data)
    i = image.luma()
    c = image.components[i]
    found = engine.signature(c.blocks, size, transforms)
    return "\n".join([f"{i} {size} {c.width} {c.height} {len(found)}", *(" ".join(map(str, x)) for x in found)]) + "\n"


def best_base(target: bytes, candidates: dict[str, bytes], own: str, size: int, transforms: int) -> tuple[str, int]:
    """(path, votes) of the candidate that shares most features, the first in string order; votes 0 for none."""

    def features(data: bytes) -> set[int]:
        image = jpeg.read(data)
        return {x[1] for x in engine.signature(image.components[image.luma()].blocks, size, transforms)}

    mine = features(target)
    votes = {path: len(mine & features(data)) for path, data in candidates.items() if path != own}
    top = max(votes.values(), default=0)
    return (min(p for p, v in votes.items() if v == top), top) if top else ("", 0)


def cmd_scan(a) -> int:
    from .plans import greedy, images

    if not os.path.isdir(a.input):
        return 2
    options = engine.CompressOptions(routing_mode=engine.RoutingMode.parse(a.force_route) if a.force_route else engine.RoutingMode.AUTO)
    scanned, files, results = images.scan(session(), a.input, a.threshold, force=a.force, options=options)
    root = archive.output_root(a.output, Path(a.input).name)
    path = images.write_archive(scanned, files, results, os.path.join(root, Path(a.input).name + "_deduped" + archive.SUFFIX))
    last = greedy.running_stats(scanned).orderBy("rank", ascending=False).first()
    print(f"archive: {path}")
    if last:
        print(" ".join(f"{k}={v}" for k, v in last.asDict().items() if k not in ("image_id", "rank")))
    return 0


def cmd_restore(a) -> int:
    from .plans import images

    if not os.path.isfile(a.archive):
        return 2
    n = images.write_restored(images.restored(session(), a.archive), archive.output_root(a.output, Path(a.archive).stem))
    print(f"restored: {n}")
    return 0


def cmd_benchmark(a) -> int:
    from pyspark.sql import functions as F

    from .plans import images, rollup, verify

    if not os.path.isdir(a.input):
        return 2
    spark = session()
    from .session import ship

    ship(spark)
    files = images.relative_files(spark, a.input)
    pairs = rollup.prefix_pairs(files.select(F.col("image_id").alias("path"))).select(F.col("target").alias("target_id"), F.col("base").alias("base_id"))
    if pairs.isEmpty():
        return 3
    options = engine.CompressOptions(routing_mode=engine.RoutingMode.parse(a.force_route) if a.force_route else engine.RoutingMode.AUTO)
    results = images.pair_results(pairs, files, options).drop("payload", "block_map")
    t = files.select(F.col("image_id").alias("target_id"), F.col("size").alias("target_size"), F.md5("content").alias("tm"), verify.zlib_bytes("content").alias("zlib_size"))
    b = files.select(F.col("image_id").alias("base_id"), F.col("size").alias("base_size"), F.md5("content").alias("bm"))
    costs = results.join(t, "target_id").join(b, "base_id").select(F.lit(Path(a.input).name).alias("dataset"), "base_id", "target_size", "base_size", F.when(F.col("success"), F.col("compressed_size")).alias("delta_size"), F.when(F.col("tm") == F.col("bm"), 0).otherwise(F.col("target_size")).alias("md5_size"), "zlib_size", (F.col("similarity_seconds") + F.col("delta_seconds")).alias("seconds"))
    rollup.rollup(costs).coalesce(1).write.mode("overwrite").option("header", True).csv(a.output)
    print(f"results: {a.output}")
    return 0


def cmd_pack(a) -> int:
    hint = tuple(a.hint) if a.hint else None
    options = engine.CompressOptions(strict_lossless=a.strict, codec=a.codec, routing_mode=engine.RoutingMode.parse(a.route))
    result, data = engine.compress(_read(a.target), _read(a.base), a.base_id or a.base, options, hint)
    if not result.success:
        print(result.reason, file=sys.stderr)
        return 1
    Path(a.output).write_bytes(data)
    print(f"[Router] Using {result.route} Branch")
    return 0


def cmd_unpack(a) -> int:
    if not decompress_image(a.package, a.base, a.output):
        return 1
    return 0 if not a.target or _read(a.target) == _read(a.output) else 2


def cmd_pair(a) -> int:
    """Both codecs on one pair, in lines that the log parser reads."""
    target, base = _read(a.target), _read(a.base)
    start = time.perf_counter()
    raw, raw_data = engine.compress(target, base, a.base, engine.CompressOptions(codec="raw"))
    small, small_data = engine.compress(target, base, a.base, engine.CompressOptions(codec="zstd"))
    if not raw.success or not small.success:
        print(raw.reason or small.reason, file=sys.stderr)
        return 1
    restored = [engine.restore(data, base) for data in (raw_data, small_data)]
    ok = all(x == target for x in restored)
    blocks = [[c.blocks for c in jpeg.read(x).components] for x in (target, *restored)]
    luma = all(len(x) == len(blocks[0]) and all((p == q).all() for p, q in zip(x, blocks[0], strict=True)) for x in blocks[1:])
    fnv = lambda data: hex(_fnv(data))
    print(f"[Router] Using {raw.route} Branch\nOriginal Size (bytes): {len(target)}\nDedup Size RAW (bytes): {len(raw_data)}\nDedup Size ZSTD (bytes): {len(small_data)}")
    print(f"Compression Ratio RAW: {len(target) / len(raw_data)}\nCompression Ratio ZSTD: {len(target) / len(small_data)}\nSimilarity Detector Time (s): {raw.similarity_seconds}")
    print(f"Idelta Compressor Time (s): {raw.delta_seconds}\nTotal Time (s): {time.perf_counter() - start}\nThroughput (MB/s): {raw.throughput_mb_s}\nZlib Size (bytes): {len(zlib.compress(target, 9))}")
    print(f"Restore Check Luma-DCT: {'passed' if luma else 'failed'}\nRestore Check Bytewise: {'passed' if ok else 'failed'}\nReference Hash FNV1a64: {fnv(target)}\nRestored Hash FNV1a64: {fnv(restored[1])}")
    return 0 if ok else 2


def _fnv(data: bytes) -> int:
    from .functions import u64

    h = u64.FOLD_START
    for x in data:
        h = (h ^ x) * u64.FOLD_FACTOR & u64.MASK
    return h


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *args, **options):
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x)
        for k, kw in options.items():
            s.add_argument("--" + k.replace("_", "-"), **kw)
        s.set_defaults(run=f)

    route = {"choices": [m.value for m in engine.RoutingMode], "default": None}
    add("scan", cmd_scan, "input", output={"default": ""}, threshold={"type": int, "default": 2}, force={"action": "store_true"}, force_route=route)
    add("restore", cmd_restore, "archive", output={"default": ""})
    add("benchmark", cmd_benchmark, "input", "output", force_route=route)
    sizes = {"window": {"type": int, "default": 2}, "transforms": {"type": int, "default": 10}}
    add("dump-y", lambda a: Path(a.output).write_text(luma_lines(_read(a.input))) and 0, "input", "output")
    add("repack-same", lambda a: Path(a.output).write_bytes(jpeg.write(_read(a.input), jpeg.read(_read(a.input)))) and 0, "input", "output")
    add("repack-y", lambda a: Path(a.output).write_bytes(with_luma(_read(a.input), Path(a.text).read_text())) and 0, "input", "text", "output")
    add("signature", lambda a: print(signature_lines(_read(a.input), a.window, a.transforms), end="") or 0, "input", **sizes)

    def run_best(a) -> int:
        base, votes = best_base(_read(a.target), {c: _read(c) for c in a.candidates}, a.target, a.window, a.transforms)
        print(f"{base} {votes}" if votes else "No matching base")
        return 0

    add("best-base", run_best, "target", candidates={"nargs": "+", "required": True}, **sizes)
    add("pack", cmd_pack, "target", "base", "output", base_id={"default": ""}, hint={"type": int, "nargs": 4}, codec={"choices": ["auto", "raw", "zstd"], "default": "auto"}, route={"default": "auto"}, strict={"action": "store_true"})
    add("unpack", cmd_unpack, "package", "base", "output", target={"default": ""})
    add("pair-benchmark", cmd_pair, "target", "base")
    add("compress", lambda a: 0 if compress_image(a.target, a.base, a.output).success else 1, "target", "base", "output")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a) or 0
    except (OSError, jpeg.JpegError, package.PackageError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
