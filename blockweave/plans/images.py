"""The scan of a folder of JPEG files: features, candidates, pair results, greedy choice, archive; and its undoing."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import u64
from ..scratch import Pile, written
from ..session import ship
from ..sources import archive, engine, jpeg
from . import greedy

RESULT = "target_id string, base_id string, success boolean, reason string, route string, original_size long, compressed_size long, compression_ratio double, blocks_total int, blocks_exact int, blocks_similar int, blocks_different int, block_width int, block_height int, header_bytes long, copy_meta_bytes long, insert_raw_bytes long, similarity_seconds double, delta_seconds double, throughput_mb_s double, block_map array<tinyint>, payload binary"


def relative_files(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, rank, size, content) of a folder's JPEG files; the id is the path below the folder."""
    files = jpeg.scan_files(spark, folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(folder)).toUri().getPath()
    bare = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    name = F.when(bare.startswith(root.rstrip("/") + "/"), F.substring(bare, F.lit(len(root.rstrip("/")) + 2), F.length(bare))).otherwise(bare)
    return files.select(name.alias("image_id"), "rank", F.col("length").alias("size"), "content")


def features(files: DataFrame, size: int = 2, transforms: int = 10) -> DataFrame:
    """(image_id, transform_index, hash, window_hash, row, col, error) of files (image_id, content); a failure is one row with its error."""
    names = ["image_id", "transform_index", "hash", "window_hash", "row", "col", "error"]

    def run(batches):
        for batch in batches:
            rows = []
            for image_id, content in zip(batch["image_id"], batch["content"], strict=True):
                try:
                    image = jpeg.read(bytes(content))
                    found = engine.signature(image.components[image.luma()].blocks, size, transforms)
                    rows += [(image_id, i, u64.signed(h), u64.signed(w), r, c, None) for i, h, w, r, c in found]
                except (ValueError, KeyError, IndexError) as e:
                    rows.append((image_id, None, None, None, None, None, str(e) or "unreadable"))
            cols = list(zip(*rows, strict=True)) or [()] * 7  # 64-bit numbers beside nulls must not pass through floats
            yield pd.DataFrame({n: pd.array(c, "Int64") if 0 < i < 6 else pd.Series(c, dtype=object) for i, (n, c) in enumerate(zip(names, cols, strict=True))})

    return files.select("image_id", "content").mapInPandas(run, "image_id string, transform_index int, hash long, window_hash long, row int, col int, error string")


def pair_results(pairs: DataFrame, files: DataFrame, options: engine.CompressOptions) -> DataFrame:
    """RESULT rows of pairs (target_id, base_id): each target compressed against its base, in a task of its own."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for t, b, target, base in zip(batch["target_id"], batch["base_id"], batch["target"], batch["base"], strict=True):
                result, data = engine.compress(bytes(target), bytes(base), b, options)
                rows.append({"target_id": t, "base_id": b, **result.as_row(), "payload": data or None})
            yield pd.DataFrame(rows, columns=names)

    t = files.select(F.col("image_id").alias("target_id"), F.col("content").alias("target"))
    b = files.select(F.col("image_id").alias("base_id"), F.col("content").alias("base"))
    return pairs.select("target_id", "base_id").join(t, "target_id").join(b, "base_id").select("target_id", "base_id", "target", "base").mapInPandas(run, RESULT)


def scan(spark: SparkSession, folder: str, threshold: int = greedy.THRESHOLD, min_ratio: float = greedy.MIN_RATIO, force: bool = False, options: engine.CompressOptions | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, files, results): the status of every file below ``folder``, the files, and the results of the pairs that the scan tried with their packages."""
    ship(spark)
    options = options or engine.CompressOptions()
    files = written(relative_files(spark, folder), "files")
    found = written(features(files, max(1, options.window_size), max(1, options.num_transforms)), "features")
    bad = found.filter("error is not null").select("image_id", F.lit(True).alias("failed"))
    items = written(files.select("image_id", "rank", "size").join(bad, "image_id", "left").select("image_id", "rank", "size", F.coalesce("failed", F.lit(False)).alias("failed")), "items")
    votes = written(greedy.ordered_votes(found.filter("error is null").select("image_id", "transform_index", "hash"), items), "votes")
    done, last = Pile("results"), []  # a table is read by its wave before the pile may replace it

    def result_of(pairs: DataFrame) -> DataFrame:
        while last:
            done.add(last.pop())
        last.append(written(pair_results(pairs, files, options), "results"))
        return last[0]

    scanned = written(greedy.scan(items, votes, result_of, threshold, min_ratio, force), "scanned")
    for table in last:
        done.add(table)
    results = done.union()
    return scanned, files, spark.createDataFrame([], RESULT) if results is None else results


def detailed(scanned: DataFrame, results: DataFrame) -> DataFrame:
    """Scan rows with their pair's block counts and sizes; nulls become 0."""
    cols = ["blocks_total", "blocks_exact", "blocks_similar", "blocks_different", "block_width", "block_height", "header_bytes", "copy_meta_bytes", "insert_raw_bytes"]
    r = results.select(F.col("target_id").alias("image_id"), F.col("base_id").alias("base"), *cols, "block_map")
    out = scanned.join(r, ["image_id", "base"], "left").fillna(0, cols)
    return out.withColumn("block_similarity", greedy.similarity_text("blocks_exact", "blocks_similar", "blocks_different", "blocks_total"))


def write_archive(scanned: DataFrame, files: DataFrame, results: DataFrame, path: str, strict: bool = True) -> str | None:
    """The archive of a scan's deduped files; None if there are none."""
    hashes = files.select("image_id", F.sha2("content", 256).alias("sha256"))
    entries = written(greedy.manifest(scanned, hashes, strict), "manifest")
    kept = scanned.filter("status = 'deduped'").select("image_id", "base")
    payloads = kept.join(results.select(F.col("target_id").alias("image_id"), F.col("base_id").alias("base"), "payload"), ["image_id", "base"])
    deltas = payloads.join(entries.select(F.col("target").alias("image_id"), "ddct_file"), "image_id").select(F.col("ddct_file").alias("name"), F.col("payload").alias("content"))
    bases = files.join(kept.select(F.col("base").alias("image_id")).distinct(), "image_id").select(F.concat(F.lit("bases/"), "image_id").alias("name"), "content")
    return archive.write_archive_of(path, entries, bases, deltas)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """(target, status, expected_sha256, sha256, content) of every entry of an archive; status is restored, missing_ddct, missing_base or restore_failed."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    entries, contents = archive.read_manifests(files), archive.read_archives(files)
    pick = lambda name, kind: contents.select("archive", F.col("name").alias(name), F.col("content").alias(kind))
    rows = entries.join(pick("ddct_file", "delta"), ["archive", "ddct_file"], "left").join(pick("base_file", "base"), ["archive", "base_file"], "left")

    def run(batches):
        for batch in batches:
            out = []
            for target, expected, delta, base in zip(batch["target"], batch["original_sha256"], batch["delta"], batch["base"], strict=True):
                content, status = None, "missing_ddct" if delta is None else "missing_base" if base is None else "restored"
                if status == "restored":
                    try:
                        content = engine.restore(bytes(delta), bytes(base))
                    except ValueError:
                        status = "restore_failed"
                out.append((target, status, expected, hashlib.sha256(content).hexdigest() if content is not None else "", content))
            yield pd.DataFrame(out, columns=["target", "status", "expected_sha256", "sha256", "content"])

    return rows.select("target", "original_sha256", "delta", "base").mapInPandas(run, "target string, status string, expected_sha256 string, sha256 string, content binary")


def write_restored(rows: DataFrame, folder: str) -> int:
    """Writes restored files below ``folder``, one at a time; how many."""
    n = 0
    for r in rows.filter("status = 'restored'").select("target", "content").toLocalIterator():
        path = os.path.normpath(os.path.join(folder, r["target"]))
        if not path.startswith(os.path.abspath(folder) + os.sep) and not path.startswith(os.path.normpath(folder) + os.sep):
            raise ValueError(f"{r['target']} leaves the folder")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(bytes(r["content"]))
        n += 1
    return n


def events(scanned: DataFrame, archive_path: str | None) -> Iterator[dict]:
    """The scan as events: start, a progress row for each file in scan order with the counters so far, done."""
    stats = greedy.running_stats(scanned).join(scanned.select("image_id", "status", "reason", "base", "ratio"), "image_id")
    total = scanned.count()
    yield {"event": "start", "total_images": total}
    for r in stats.orderBy("rank").toLocalIterator():
        yield {"event": "progress", "total_images": total, **r.asDict()}
    yield {"event": "done", "total_images": total, "archive": archive_path}
