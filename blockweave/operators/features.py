"""Similarity features of coefficient grids: brightness bitmap, window hashes, MinHash over linear transforms.

A grid is rows (image_id, row, col, coeff) of an image's luma blocks, coeff holding 64 coefficients of which the
first is the block's brightness. All steps but the index are partitioned by image, so a signature costs one
shuffle of the narrow (image_id, row, col, dc) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import u64


def luma_component(components: DataFrame) -> DataFrame:
    """(image_id, comp): the only component, else the first of component_id 1, else the first of the largest grid.

    ``components``: image_id, comp, component_id, width, height in blocks.
    """
    w = Window.partitionBy("image_id").orderBy((F.col("component_id") != 1).cast("int"), (-F.col("width") * F.col("height")), "comp")
    return components.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("image_id", "comp")


def dc_bitmap(cells: DataFrame) -> DataFrame:
    """(image_id, row, col, dc, bit): bit is whether dc reaches the image's mean, truncated towards zero."""
    dc = cells.select("image_id", "row", "col", F.element_at("coeff", 1).alias("dc"))
    mean = F.expr("sum(cast(dc as bigint)) over (partition by image_id) div count(*) over (partition by image_id)")
    return dc.select("image_id", "row", "col", "dc", (F.col("dc") >= mean).cast("tinyint").alias("bit"))


def window_hashes(bitmap: DataFrame, size: int = 2) -> DataFrame:
    """(image_id, row, col, window_hash) of each size x size window (1 to 8) that is not all ones or all zeros."""
    if not 1 <= size <= 8:
        raise ValueError("window size must be 1 to 8")
    with u64.wrapping(bitmap.sparkSession):
        cell = F.struct(F.col("dc").cast("long").bitwiseAND(65535).bitwiseOR(F.shiftleft(F.col("bit").cast("long"), 16)).alias("v"), F.col("bit").cast("long").alias("b"), F.col("row").alias("r"), F.col("col").alias("c"))
        across = Window.partitionBy("image_id", "row").orderBy("col")
        down = Window.partitionBy("image_id", "col").orderBy("row")
        x = bitmap.select("image_id", "row", "col", cell.alias("x0"))
        x = x.select("*", *[F.lead("x0", k).over(across).alias(f"x{k}") for k in range(1, size)])
        line = F.array(*[f"x{k}" for k in range(size)])
        x = x.select("image_id", "row", "col", line.alias("y0"))
        x = x.select("*", *[F.lead("y0", k).over(down).alias(f"y{k}") for k in range(1, size)])
        cells = [F.col(f"y{i}")[j] for i in range(size) for j in range(size)]
        # a neighbour that is missing or not the next one ends the window
        whole = reduce(lambda a, b: a & b, [(c["r"] == F.col("row") + i // size) & (c["c"] == F.col("col") + i % size) for i, c in enumerate(cells)])
        h, bits = u64.lit(u64.FOLD_START), F.lit(0).cast("long")
        for c in cells:
            h = h.bitwiseXOR(c["v"]) * u64.lit(u64.FOLD_FACTOR)
            bits = F.shiftleft(bits, 1).bitwiseOR(c["b"])
        x = x.filter(F.coalesce(whole, F.lit(False))).select("image_id", "row", "col", h.alias("h"), bits.alias("bits"))
        uniform = (1 << size * size) - 1
        x = x.filter((F.col("bits") != 0) & (F.col("bits") != u64.lit(uniform)))
        return x.select("image_id", "row", "col", u64.mixed(F.col("h").bitwiseXOR(F.col("bits") * u64.lit(u64.BITS_FACTOR))).alias("window_hash"))


def minhash_features(windows: DataFrame, transforms: int = 10) -> DataFrame:
    """(image_id, transform_index, hash, window_hash, row, col): for each transform a * h + b its unsigned least window.

    Ties go to the first window in scan order. Images without windows have no features.
    """
    if transforms < 1:
        raise ValueError("at least one transform is needed")
    with u64.wrapping(windows.sparkSession):

        def least(a: int, b: int) -> Column:
            value = u64.ordered(F.col("window_hash") * u64.lit(a) + u64.lit(b))
            return F.min(F.struct(value.alias("value"), F.col("row"), F.col("col"), F.col("window_hash")))

        per = windows.groupBy("image_id").agg(*[least(a, b).alias(f"t{i}") for i, (a, b) in enumerate(u64.linear_parameters(transforms))])
        each = F.posexplode(F.array(*[f"t{i}" for i in range(transforms)])).alias("transform_index", "x")
        return per.select("image_id", each).select("image_id", "transform_index", u64.ordered(F.col("x.value")).alias("hash"), "x.window_hash", "x.row", "x.col")


def signatures(cells: DataFrame, size: int = 2, transforms: int = 10) -> DataFrame:
    """The features of luma grids, from cells to MinHash."""
    return minhash_features(window_hashes(dc_bitmap(cells), size), transforms)


def extract_features(cells: DataFrame, size: int = 2, transforms: int = 10) -> DataFrame:
    """(image_id, hashes): the feature hashes in transform order; sizes below 1 count as 1."""
    f = signatures(cells, max(1, size), max(1, transforms))
    return f.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("transform_index", "hash"))), lambda x: x["hash"]).alias("hashes"))


def signature_text(features: DataFrame, grids: DataFrame, luma: int = 0, size: int = 2) -> DataFrame:
    """(image_id, text): a head line ``luma size width height n``, then ``index hash window_hash row col``, unsigned.

    ``grids``: image_id, width, height.
    """
    line = F.concat_ws(" ", "transform_index", u64.decimal_text(F.col("hash")), u64.decimal_text(F.col("window_hash")), "row", "col")
    lines = features.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("transform_index", line.alias("line")))).alias("lines"))
    head = F.concat_ws(" ", F.lit(luma), F.lit(size), "width", "height", F.size("lines"))
    return lines.join(grids, "image_id").select("image_id", F.concat(F.concat_ws("\n", F.array(head), F.transform("lines", lambda x: x["line"])), F.lit("\n")).alias("text"))


def shared_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, other_id, n_a, n_b, shared, disjoint): overlap of the feature hashes of images named in pairs.

    ``a``: image_id, other_id, hashes; ``b``: other_id, other_hashes.
    """
    both = F.size(F.array_intersect("hashes", "other_hashes"))
    return a.join(b, "other_id").select("image_id", "other_id", F.size("hashes").alias("n_a"), F.size("other_hashes").alias("n_b"), both.alias("shared"), (both == 0).alias("disjoint"))
