"""Integrity checks: hashes of contents, pixel error, and the two classifications of restored files."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import u64
from ..sources import jpeg


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with sha256 and md5 in hex; empty for missing contents."""
    return files.withColumn("sha256", F.coalesce(F.sha2(content, 256), F.lit(""))).withColumn("md5", F.coalesce(F.md5(content), F.lit("")))


def fnv1a64(files: DataFrame, content: str = "content", name: str = "fnv") -> DataFrame:
    """``files`` with the fold of the content's bytes (BIGINT of the same bits): xor, then multiply. All contents of a batch step together."""

    def fold(x: pd.Series) -> pd.Series:
        raw = [bytes(v) if v is not None else b"" for v in x]
        order = np.argsort([-len(v) for v in raw], kind="stable")
        size = np.array([len(raw[i]) for i in order])
        data, start = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64), np.concatenate(([0], np.cumsum(size)))[:-1]
        h, factor = np.full(len(raw), u64.FOLD_START, np.uint64), np.uint64(u64.FOLD_FACTOR)
        live = len(raw)
        for j in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -j, "left"))  # the longest come first: those that still have a byte
            h[:live] = (h[:live] ^ data[start[:live] + j]) * factor
        out = np.empty(len(raw), np.int64)
        out[order] = h.view(np.int64)
        return pd.Series([v if y is not None else None for v, y in zip(out.tolist(), x, strict=True)], dtype="Int64")

    return files.withColumn(name, F.pandas_udf(fold, "long")(F.col(content).cast("binary")))


def zlib_bytes(content: str) -> Column:
    """Bytes of the content under zlib at level 9; null for null."""

    def sizes(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else len(zlib.compress(bytes(v), 9)) for v in x], dtype="Int64")

    return F.pandas_udf(sizes, "long")(content)


def exact_baseline(a: Column, b: Column) -> Column:
    """What a target costs when only files of equal MD5 are saved: nothing, or its size."""
    return F.when(F.md5(a) == F.md5(b), F.lit(0)).otherwise(F.octet_length(a)).cast("long")


def pixel_error(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared difference of two pixel arrays; infinite for other shapes."""
    return float("inf") if a.shape != b.shape else float(((a.astype(np.int64) - b.astype(np.int64)) ** 2).mean())


def pixel_mse(a: bytes, b: bytes) -> float:
    """Pixel error of two JPEG files."""
    return pixel_error(jpeg.pixels(a), jpeg.pixels(b))


def with_pixel_mse(files: DataFrame, a: str, b: str, name: str = "mse") -> DataFrame:
    """``files`` with the pixel error of two columns of JPEG contents; null where either is missing or can't be read."""

    def errors(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            try:
                return pixel_mse(bytes(p), bytes(q)) if p is not None and q is not None else None
            except (ValueError, KeyError, IndexError):
                return None

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return files.withColumn(name, F.pandas_udf(errors, "double")(a, b))


def strict_status(entries: DataFrame, strict: bool = True) -> DataFrame:
    """``entries`` with ``status`` and the counters of the command-line check.

    Entries: has_delta, has_base, has_source (a source root was given), has_original, restored, sha_match,
    md5_match, pixel_equal, has_expected (a hash is in the manifest). A strict mismatch counts as mismatched and
    as critical.
    """
    good = F.col("sha_match") & F.col("md5_match") & F.col("pixel_equal")
    status = (
        F.when(~F.col("has_delta"), "MISSING_DDCT")
        .when(~F.col("has_base"), "MISSING_BASE")
        .when(F.col("has_source") & ~F.col("has_original"), "MISSING_ORIGINAL")
        .when(~F.col("restored"), "RESTORE_FAILED")
        .when(~F.col("has_source"), F.when(F.col("sha_match") | ~F.col("has_expected"), "VERIFIED").otherwise("RESTORED"))
        .when(good, "VERIFIED")
        .otherwise("CRITICAL FAILURE" if strict else "MISMATCH")
    )
    return entries.withColumn("status", status)


def strict_summary(classified: DataFrame) -> DataFrame:
    """One row of counters over ``strict_status``."""
    n = lambda *names: F.sum(F.col("status").isin(*names).cast("long"))
    z = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    ended = ("VERIFIED", "RESTORED", "MISMATCH", "CRITICAL FAILURE")
    return classified.agg(F.count("*").alias("total"), z(n(*ended), "restored"), z(n("VERIFIED"), "verified"), z(n("MISMATCH", "CRITICAL FAILURE"), "mismatched"), z(n("CRITICAL FAILURE"), "critical"), z(n("MISSING_DDCT"), "missing_ddct"), z(n("MISSING_BASE"), "missing_base"), z(n("MISSING_ORIGINAL"), "missing_original"), z(n("RESTORE_FAILED"), "restore_failed"))


def view_status(entries: DataFrame) -> DataFrame:
    """``entries`` with the status that the interactive view shows; pixels decide apart from the hash, MD5 does not count.

    A null pixel_equal counts as equal; strict is a column.
    """
    pixel = F.coalesce("pixel_equal", F.lit(True))
    source = F.col("has_source")
    status = (
        F.when(~F.col("has_delta"), "missing_ddct")
        .when(~F.col("has_base"), "missing_base")
        .when(source & ~F.col("has_original"), "missing_original")
        .when(~F.col("restored"), "restore_failed")
        .when(source & F.col("strict") & (~pixel | ~F.col("sha_match")), "critical_failure")
        .when(source & F.col("has_expected") & F.col("sha_match"), F.when(pixel, "verified").otherwise("pixel_mismatch"))
        .when(source & F.col("has_expected"), "sha_mismatch")
        .otherwise("restored")
    )
    return entries.withColumn("view_status", status)


def view_summary(classified: DataFrame) -> DataFrame:
    """One row of counters over ``view_status``; a missing delta counts as failed."""
    n = lambda *names: F.coalesce(F.sum(F.col("view_status").isin(*names).cast("long")), F.lit(0))
    gone = ("missing_ddct", "missing_base", "missing_original", "restore_failed")
    return classified.agg(F.count("*").alias("total"), (F.count("*") - n(*gone)).alias("restored"), n("verified").alias("verified"), n("pixel_mismatch", "sha_mismatch").alias("mismatched"), n("critical_failure").alias("critical"), n("missing_ddct", "restore_failed").alias("failed"), n("missing_base").alias("missing_base"), n("missing_original").alias("missing_original"))


def lookups(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """Manifest rows with ``delta`` and ``base`` contents of the archive (name, content), null where missing."""
    delta = archive.select(F.col("name").alias("ddct_file"), F.col("content").alias("delta"))
    base = archive.select(F.col("name").alias("base_file"), F.col("content").alias("base"))
    return entries.join(delta, "ddct_file", "left").join(base, "base_file", "left")


def preview_source(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(name, target, ddct_file, base_file): for each delta file name the first manifest entry (by target) of that base name."""
    own = entries.withColumn("name", F.element_at(F.split("ddct_file", "/"), -1))
    first = own.groupBy("name").agg(F.min(F.struct("target", "ddct_file", "base_file")).alias("x"))
    return names.join(first, "name").select("name", "x.*")


def last_log(logs: DataFrame) -> DataFrame:
    """The last row (by rank) of each output_ddct among scan rows."""
    last = logs.groupBy("output_ddct").agg(F.max("rank").alias("rank"))
    return logs.join(last, ["output_ddct", "rank"], "left_semi")


def sanitised(rows: DataFrame, integers: list[str]) -> DataFrame:
    """``rows`` for display: missing values are 0, and so are values of integer columns that are no integers."""
    out = rows.withColumns({c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long")) for c in integers})
    return out.fillna(0)
