"""Metric lines of a benchmark's output as one typed row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the lines begin with, by the metric they carry.
NUMBER, WORD, HEX, COUNT = r"([0-9eE+\-.]+)", r"(\w+)", "(0x[0-9a-fA-F]+)", r"(\d+)"
LINES = {
    "original_size_bytes": ("Original Size (bytes):", COUNT, "bigint"),
    "dedup_size_raw_bytes": ("Dedup Size RAW (bytes):", COUNT, "bigint"),
    "dedup_size_zstd_bytes": ("Dedup Size ZSTD (bytes):", COUNT, "bigint"),
    "compression_ratio_raw": ("Compression Ratio RAW:", NUMBER, "double"),
    "compression_ratio_zstd": ("Compression Ratio ZSTD:", NUMBER, "double"),
    "similarity_seconds": ("Similarity Detector Time (s):", NUMBER, "double"),
    "idelta_seconds": ("Idelta Compressor Time (s):", NUMBER, "double"),
    "total_seconds": ("Total Time (s):", NUMBER, "double"),
    "throughput_mb_s": ("Throughput (MB/s):", NUMBER, "double"),
    "restore_luma_dct": ("Restore Check Luma-DCT:", WORD, "string"),
    "restore_bytewise": ("Restore Check Bytewise:", WORD, "string"),
    "reference_hash_fnv1a64": ("Reference Hash FNV1a64:", HEX, "string"),
    "restored_hash_fnv1a64": ("Restored Hash FNV1a64:", HEX, "string"),
}
ROUTER = r"^\[Router\] Using (.*)$"


def parsed(logs: DataFrame) -> DataFrame:
    """(log_id, router_branch, the metrics of LINES) of logs (log_id, text). The last line of a metric counts; missing words are empty, missing numbers null."""
    lines = F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def last(pattern: str):
        found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    out = [F.coalesce(F.replace(last(ROUTER), F.lit(" Branch"), F.lit("")), F.lit("")).alias("router_branch")]
    for name, (head, value, kind) in LINES.items():
        c = last(rf"^\Q{head}\E\s*{value}$")
        out.append((F.coalesce(c, F.lit("")) if kind == "string" else c.try_cast(kind)).alias(name))
    return logs.select("log_id", *out)


def write_json(metrics: DataFrame, folder: str) -> None:
    """Metric rows as JSON, in place of what is there."""
    metrics.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def append_csv(metrics: DataFrame, folder: str) -> None:
    """Metric rows added to a folder of CSV files, each with its head line."""
    metrics.write.mode("append").option("header", True).csv(folder)
