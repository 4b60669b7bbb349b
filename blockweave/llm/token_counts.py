"""Token counts of documents in flat token files, by a separator scan.

A token file is a bare run of little-endian uint16 (or uint32) ids, an end-of-document id after each
document and no index. Files are cut into blocks; each block is one vectorised search for the separator and
gives how many it found, the documents that lie whole within, and the loose tokens before its first and
after its last one. A prefix scan stitches the blocks: a running sum of separators numbers the documents and
a running maximum of separator places tells how many tokens a block inherits. The scan has two levels
(blocks within groups, then groups), so one huge file is no single task.

Edge cases: an empty file holds no documents; tokens after the last separator form a last document; two
separators in a row hold an empty document; null and empty texts are written as empty documents; rows that
repeat are documents each; bytes that are no UTF-8 are read as U+FFFD; other columns are ignored. An id that does
not fit the width, and a separator that is an id of the vocabulary, are refused before anything is written.

Tasks read and write the files by pyarrow's file systems: local and HDFS paths and S3 (``s3a://`` is read as
``s3://``). Other stores that only Spark knows are refused by pyarrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import new_path, written

#: Tokens of a block; blocks of a group in the prefix scan.
BLOCK, GROUP = 1 << 20, 256


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, separator: int, width: int = 2) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into token files in ``folder``, one a task.

    (file, ordinal, doc_id): which document is where. A task that runs again writes a file of its own, and
    only the files named here count.
    """
    kind = np.dtype(f"<u{width}")
    ids = bpe.load_vocabulary(docs.sparkSession, path, pattern)[0].value.token
    if max([separator, *ids]) >= 1 << 8 * width or min([separator, *ids]) < 0:
        raise ValueError(f"ids up to {max([separator, *ids])} do not fit {width} bytes")
    if separator in ids:
        raise ValueError(f"the separator {separator} is an id of the vocabulary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        ordinal = 0
        with store.open_output_stream(f"{root}/_{name}") as out:  # a name that Spark's listing leaves out until it is whole
            for batch in batches:
                ids = batch.column(1)
                off = ids.offsets.to_numpy()
                flat = ids.values.to_numpy(zero_copy_only=False)
                n = np.diff(off)
                tokens = np.full(int(n.sum()) + len(n), separator, kind)
                at = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)
                tokens[at] = flat[off[0] : off[-1]]
                out.write(tokens.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(np.arange(ordinal, ordinal + len(n))), batch.column(0)], ["file", "ordinal", "doc_id"])
                ordinal += len(n)
        store.move(f"{root}/_{name}", f"{root}/{name}")

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = bpe.encode(own, path, pattern).select("doc_id", "ids")
    return written(encoded.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-index")


def scan_token_files(spark: SparkSession, folder: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the token files in ``folder``."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    blocks = files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block * width}"))).alias("block"))
    blocks = blocks.repartition(spark.sparkContext.defaultParallelism * 4, "file", "block")
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name, length, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{name}: {length} bytes are no whole number of tokens")
                with store.open_input_file(f"{root}/{name}") as f:
                    f.seek(b * block * width)
                    ids = np.frombuffer(f.read(block * width), kind)
                at = np.flatnonzero(ids == separator)
                first, last = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                inner = np.diff(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([b], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "size", "n", "first", "last", "inner"],
                )

    found = written(blocks.select("file", "length", "block").mapInArrow(run, "file string, block long, size long, n long, first long, last long, inner array<long>"), "blocks")
    return stitched(found, block)


def stitched(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) from the blocks (file, block, size, n, first, last, inner) by a prefix scan."""
    start = F.col("block") * block
    own = found.withColumn("group", F.expr(f"block div {GROUP}")).withColumn("at", start + F.col("last")).withColumn("end", start + F.col("size"))
    groups = own.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("at").alias("at"), F.max("end").alias("end"))
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.coalesce(F.max("at").over(over), F.lit(-1)).alias("at0"), (F.max("end").over(Window.partitionBy("file"))).alias("file_end"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("n1", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("at1", F.max("at").over(inside)).join(groups, ["file", "group"])
    before, since = F.col("n0") + F.col("n1"), F.coalesce("at1", "at0")
    ended = F.when(F.col("n") > 0, F.concat(F.array(start + F.col("first") - since - 1), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    tail = F.col("end") - 1 - F.coalesce("at", since)
    last = F.when((F.col("end") == F.col("file_end")) & (tail > 0), F.array(tail)).otherwise(F.array().cast("array<long>"))
    own = own.select("file", before.alias("before"), F.concat(ended, last).alias("counts"))
    return own.select("file", "before", F.posexplode("counts").alias("i", "n_tokens")).select("file", (F.col("before") + F.col("i")).alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, pattern: str, separator: int) -> DataFrame:
    """(doc_id, file, ordinal, n_tokens): ``docs`` written as token files, then counted from these files alone."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    index = write_token_files(docs, folder, path, pattern, separator)
    counts = scan_token_files(spark, folder, separator)
    return index.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
