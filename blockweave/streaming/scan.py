"""The scan as a stream: files that arrive in micro-batches against the bases registered so far.

State is tables in a folder, a subfolder for each batch: features of registered bases and statuses of items.
A batch that runs again writes its subfolder anew, so the outcome is the same after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans import greedy
from ..scratch import written

FEATURES = "image_id string, transform_index int, hash long, rank long"
STATUSES = "image_id string, rank long, status string, reason string, base string, votes long, ratio double, original_size long, compressed_size long, batch long"


class IncrementalScan:
    """``feature_of`` makes (image_id, transform_index, hash, error) and ``result_of`` makes (target_id, base_id, success, compressed_size) for pairs, given the batch's and all known files."""

    def __init__(self, spark: SparkSession, folder: str, feature_of: Callable[[DataFrame], DataFrame], result_of: Callable[[DataFrame, DataFrame], DataFrame], threshold: int = greedy.THRESHOLD, min_ratio: float = greedy.MIN_RATIO, force: bool = False) -> None:
        self.spark, self.folder, self.feature_of, self.result_of = spark, folder.rstrip("/"), feature_of, result_of
        self.settings = (threshold, min_ratio, force)

    def _before(self, name: str, schema: str, batch: int) -> DataFrame:
        """What batches before ``batch`` wrote."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema + ", batch_id long").parquet(f"{self.folder}/{name}").filter(F.col("batch_id") < batch).drop("batch_id")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch}")

    def statuses(self) -> DataFrame:
        return self._before("statuses", STATUSES, 2**62)

    def __call__(self, files: DataFrame, batch: int) -> None:
        """One micro-batch of files (image_id, rank, size, content); ranks rise over batches."""
        files = written(files.select("image_id", "rank", "size", "content"), "batch")
        known_files = self._before("files", "image_id string, rank long, size long, content binary", batch)
        known = self._before("bases", FEATURES, batch)
        found = written(self.feature_of(files), "features")
        bad = found.filter("error is not null").select("image_id", F.lit(True).alias("failed"))
        items = files.select("image_id", "rank", "size").join(bad, "image_id", "left").select("image_id", "rank", "size", F.coalesce("failed", F.lit(False)).alias("failed"))
        bases = known.select("image_id", "rank").distinct().join(known_files.select("image_id", "size"), "image_id").select("image_id", "rank", "size", F.lit(False).alias("failed"))
        every = written(items.unionByName(bases), "items")
        own = found.filter("error is null").select("image_id", "transform_index", "hash")
        votes = greedy.ordered_votes(own.unionByName(known.select("image_id", "transform_index", "hash")), every)
        votes = written(votes.join(files.select(F.col("image_id").alias("target_id")), "target_id", "left_semi"), "votes")
        all_files = files.unionByName(known_files)
        scanned = written(greedy.scan(every, votes, lambda pairs: self.result_of(pairs, all_files), *self.settings).join(files.select("image_id"), "image_id", "left_semi"), "scanned")
        self._write(scanned.withColumn("batch", F.lit(batch).cast("long")).select([c.split()[0] for c in STATUSES.split(", ")]), "statuses", batch)
        new = scanned.filter("status in ('new_base', 'kept_original')").select("image_id", "rank")
        self._write(own.join(new, "image_id").select("image_id", "transform_index", "hash", "rank"), "bases", batch)
        self._write(files.join(new.select("image_id"), "image_id", "left_semi"), "files", batch)

    def start(self, files: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs over a stream of files (image_id, rank, size, content)."""
        return files.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class GrowthMonitor(StreamingQueryListener):
    """Keeps each batch's number of input rows: what a watcher of growing result files would see."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int]] = []
        self.ended = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True
