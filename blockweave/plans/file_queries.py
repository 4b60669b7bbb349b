"""Queries over JPEG files made of the grids, packages of several components, and feature overlaps; they join those of ``queries``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delta, features
from ..scratch import new_path, written
from ..sources import datasets, engine, jpeg, package
from ..sources.archive import write_files
from . import grids, images, verify
from .grids import CELLS, PAIRS, signature_ctes
from .queries import BASE_IMAGES, TARGET_IMAGES, query, runs_sql

#: Files hold coefficients of 11 bits.
MOST = 1000
FITTED = f"list_transform({{c}}, lambda x: greatest(least(x, {MOST}), -{MOST})::smallint)"


def files_of(cells: DataFrame) -> DataFrame:
    """(name, content): a JPEG file <image_id>.jpg for each grid of ``cells`` (image_id, row, col, coeff), coefficients cut to MOST."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "col"])
        blocks = np.clip(np.stack(part["coeff"].to_numpy()), -MOST, MOST).astype(np.int16)
        return pd.DataFrame({"name": [f"{key[0]}.jpg"], "content": [datasets.file_of(blocks.reshape(int(part["row"].max()) + 1, -1, 1, 64))]})

    return cells.select(F.col("image_id").cast("string").alias("image_id"), "row", "col", "coeff").groupBy("image_id").applyInPandas(run, "name string, content binary")


def _folder(spark, cells: DataFrame) -> str:
    folder = new_path(spark, "jpeg")
    write_files(files_of(cells), folder)
    return folder


WHOLE = "whole as (select image_id from cells group by image_id having count(*) = 20)"


def _whole(spark, sf_dir) -> DataFrame:
    cells = grids.cells(spark, sf_dir)
    return cells.join(cells.groupBy("image_id").agg(F.count("*").alias("n")).filter("n = 20").select("image_id"), "image_id", "left_semi")


@query("jpeg_blocks", f"with {CELLS}, {WHOLE} select image_id, \"row\", col, {FITTED.format(c='coeff')} as coeff from cells semi join whole using (image_id)")
def jpeg_blocks(spark, sf_dir):
    """The grids written as files, found by a directory scan and read back."""
    found = jpeg.decode(jpeg.scan_files(spark, _folder(spark, _whole(spark, sf_dir)))).filter("error is null")
    return found.select(F.regexp_extract("image_id", r"([0-9]+)\.jpg$", 1).cast("long").alias("image_id"), "row", "col", "coeff")


@query("jpeg_header_swap", f"with {CELLS}, {WHOLE} select image_id, true as restored, true as readable from whole")
def jpeg_header_swap(spark, sf_dir):
    """Each file's header put on another file of the same picture with another header: the bytes are the first file's."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                image = jpeg.read(bytes(content))
                other = datasets.file_of(image.components[0].blocks[:, :, None, :], 7)
                swapped = jpeg.with_prefix(other, jpeg.header_prefix(bytes(content)))
                rows.append((int(name[:-4]), swapped == bytes(content) and other != swapped, bool((jpeg.read(swapped).components[0].blocks == image.components[0].blocks).all())))
            yield pd.DataFrame(rows, columns=["image_id", "restored", "readable"])

    return files_of(_whole(spark, sf_dir)).mapInPandas(run, "image_id long, restored boolean, readable boolean")


@query("jpeg_rewritten", f"with {CELLS}, {WHOLE} select image_id, \"row\", col, {FITTED.format(c='[(coeff[1] // 2)::smallint] || coeff[2:]')} as coeff from (select image_id, \"row\", col, list_transform(coeff, lambda x: greatest(least(x, {MOST}), 0)::smallint) as coeff from cells semi join whole using (image_id))")
def jpeg_rewritten(spark, sf_dir):
    """Coefficients changed in a file by the coefficient writer (every block's first is halved), read back."""
    cells = _whole(spark, sf_dir).withColumn("coeff", F.expr(f"transform(coeff, x -> cast(greatest(least(x, {MOST}), 0) as smallint))"))

    def run(batches):
        for batch in batches:
            out = []
            for content in batch["content"]:
                image = jpeg.read(bytes(content))
                image.components[0].blocks[..., 0] //= 2
                out.append(jpeg.write(bytes(content), image))
            yield pd.DataFrame({"name": batch["name"], "content": out})

    changed = files_of(cells).mapInPandas(run, "name string, content binary")
    found = jpeg.decode(changed, "name").filter("error is null")
    return found.select(F.regexp_extract("image_id", r"^([0-9]+)", 1).cast("long").alias("image_id"), "row", "col", "coeff")


@query("jpeg_pair_restore", f"with {PAIRS} select distinct pair_id, true as packed, true as restored from target")
def jpeg_pair_restore(spark, sf_dir):
    """Every target file compressed against its base file, restored from package and base, and compared byte by byte."""
    target, base = grids.pairs(spark, sf_dir)
    one = lambda side, name: files_of(grids.as_images(side)).select(F.regexp_replace("name", r"\.jpg$", "").alias("pair_id"), F.col("content").alias(name))
    both = one(target, "target").join(one(base, "base"), "pair_id")

    def run(batches):
        for batch in batches:
            rows = []
            for pair, t, b in zip(batch["pair_id"], batch["target"], batch["base"], strict=True):
                result, data = engine.compress(bytes(t), bytes(b), "base-" + pair)
                rows.append((pair, bool(result.success), result.success and engine.restore(data, bytes(b)) == bytes(t)))
            yield pd.DataFrame(rows, columns=["pair_id", "packed", "restored"])

    return both.mapInPandas(run, "pair_id string, packed boolean, restored boolean")


@query(
    "jpeg_folder_scan",
    f"with {PAIRS}, names as (select distinct pair_id from target where pair_id like 'mutate%') select 'a/' || pair_id || '.jpg' as image_id, true as accounted, true as sizes_add_up from names union all select 'b/' || pair_id || '.jpg', true, true from names",
)
def jpeg_folder_scan(spark, sf_dir):
    """A scan of the base and the target files of the changed grids: every file is a base, kept, or deduped with a package that gives its bytes back."""
    target, base = (x.filter("pair_id like 'mutate%'") for x in grids.pairs(spark, sf_dir))
    folder = new_path(spark, "jpeg")
    for side, sub in ((base, "a"), (target, "b")):
        write_files(files_of(grids.as_images(side)), f"{folder}/{sub}")
    scanned, files, results = images.scan(spark, folder)
    kept = scanned.join(results.select(F.col("target_id").alias("image_id"), F.col("base_id").alias("base"), "payload"), ["image_id", "base"], "left")
    kept = kept.join(files.select("image_id", "content", "size"), "image_id").join(files.select(F.col("image_id").alias("base"), F.col("content").alias("base_content")), "base", "left")

    def run(batches):
        for batch in batches:
            rows = []
            for name, status, content, payload, other, size, stored in zip(*(batch[c] for c in ("image_id", "status", "content", "payload", "base_content", "size", "compressed_size")), strict=True):
                deduped = status == "deduped"
                fine = engine.restore(bytes(payload), bytes(other)) == bytes(content) if deduped else status in ("new_base", "kept_original")
                rows.append((name, fine, int(stored) == (len(payload) if deduped else size)))
            yield pd.DataFrame(rows, columns=["image_id", "accounted", "sizes_add_up"])

    return kept.select("image_id", "status", "content", "payload", "base_content", "size", "compressed_size").mapInPandas(run, "image_id string, accounted boolean, sizes_add_up boolean")


# ---- packages of several components

THREE = f"""{PAIRS},
    target3 as (select pair_id, "row", col, [comps[1], list_reverse(comps[1]), list_transform(comps[1], lambda x: (x + 1)::smallint)] as comps from target),
    base3 as (select pair_id, "row", col, [comps[1], list_reverse(comps[1]), list_transform(comps[1], lambda x: (x + 1)::smallint)] as comps from base)"""
FPM3 = runs_sql("t.comps = b.comps", "x").replace("target t join base b", "target3 t join base3 b")


@query("package_three_components", f"with {THREE}, {FPM3} select pair_id, seq, kind, t_row, t_col, b_row, b_col, length, block, 3 as components from xfpm")
def package_three_components(spark, sf_dir):
    """Fixed-position instructions of grids of three components, packed with a header prefix and unpacked."""
    three = lambda side: side.withColumn("comps", F.expr("array(comps[0], reverse(comps[0]), transform(comps[0], x -> cast(x + 1 as smallint)))"))
    target, base = (written(three(x), "grids") for x in grids.pairs(spark, sf_dir))
    ins = written(delta.fpm_instructions(delta.aligned(target, base), strict=True), "instructions")
    heads = delta.same_shape(target, base).select("pair_id", F.concat(F.lit("base-"), "pair_id").alias("base_id"), F.lit("FPM").alias("route"), "width", "height", F.lit(3).alias("components"), F.unhex(F.lit("FFD8FFE0")).alias("prefix"))
    out = package.unpack(package.pack(ins, heads)).filter("error is null")
    return out.select("pair_id", "seq", "kind", "t_row", "t_col", "b_row", "b_col", "length", "block", "components")


# ---- features

FORTY = 40


@query("minhash_forty_transforms", f"with {CELLS}, {signature_ctes('cells', transforms=FORTY)} select * from features")
def minhash_forty_transforms(spark, sf_dir):
    """More transforms than there are fixed parameters."""
    return features.signatures(grids.cells(spark, sf_dir), 2, FORTY)


UNSIGNED = "case when {0} < 0 then {0}::hugeint + 18446744073709551616::hugeint else {0}::hugeint end"


@query(
    "signature_text",
    f"""with {CELLS}, {signature_ctes('cells')}, {WHOLE},
    lines as (select image_id, count(*) as n, string_agg(transform_index || ' ' || {UNSIGNED.format('hash')} || ' ' || {UNSIGNED.format('window_hash')} || ' ' || "row" || ' ' || col, chr(10) order by transform_index) as l from features group by image_id)
    select image_id, '0 2 5 4 ' || n || chr(10) || l || chr(10) as text from lines semi join whole using (image_id)""",
)
def signature_text(spark, sf_dir):
    cells = _whole(spark, sf_dir)
    shapes = cells.select("image_id").distinct().select("image_id", F.lit(5).alias("width"), F.lit(4).alias("height"))
    return features.signature_text(features.signatures(cells), shapes)


OVERLAP = f"""{PAIRS}, {TARGET_IMAGES}, {BASE_IMAGES}, {signature_ctes('t', 't_')}, {signature_ctes('bi', 'b_')},
    th as (select image_id, list(distinct hash) as h, count(*) as n from t_features group by 1), bh as (select image_id, list(distinct hash) as h, count(*) as n from b_features group by 1)"""


@query("feature_overlap", f"with {OVERLAP} select th.image_id, th.image_id as other_id, th.n::int as n_a, bh.n::int as n_b, len(list_intersect(th.h, bh.h))::int as shared, len(list_intersect(th.h, bh.h)) = 0 as disjoint from th join bh using (image_id)")
def feature_overlap(spark, sf_dir):
    """How many feature hashes the two sides of each pair share."""
    target, base = grids.pairs(spark, sf_dir)
    a = features.extract_features(grids.as_images(target)).withColumn("other_id", F.col("image_id"))
    b = features.extract_features(grids.as_images(base)).select(F.col("image_id").alias("other_id"), F.col("hashes").alias("other_hashes"))
    return features.shared_features(a, b)


GRID_TEXT = "string_agg(array_to_string(comps[1], ','), ';' order by \"row\", col)"


@query("md5_pair_baseline", f"""with {PAIRS}, t as (select pair_id, {GRID_TEXT} as x from target group by 1), b as (select pair_id, {GRID_TEXT} as y from base group by 1)
    select pair_id, case when md5(x) = md5(y) then 0 else strlen(x) end::bigint as stored_bytes from t join b using (pair_id)""")
def md5_pair_baseline(spark, sf_dir):
    """What each target costs when only targets equal to their base are saved."""
    target, base = grids.pairs(spark, sf_dir)
    text = lambda side, name: side.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "comps"))).alias("c")).select("pair_id", F.concat_ws(";", F.transform("c", lambda x: F.concat_ws(",", x["comps"][0].cast("array<string>")))).cast("binary").alias(name))
    both = text(target, "t").join(text(base, "b"), "pair_id")
    return both.select("pair_id", verify.exact_baseline(F.col("t"), F.col("b")).alias("stored_bytes"))
