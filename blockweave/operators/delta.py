"""Delta encoding of a target grid against a base grid: compare, route, encode, replay, account.

A pair of grids is rows (pair_id, row, col, comps) for each side; comps holds every component's 64 coefficients
of the cell. Instructions are rows (pair_id, seq, kind, t_row, t_col, b_row, b_col, length, block): COPY takes
``length`` cells of a base row, INSERT carries a block (and nulls). Grid rows are independent, so encoding is
partitioned by (pair_id, row) and no task sees more than a grid row with its matches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sum of absolute differences of a component up to which blocks count as similar; share of equal cells for FPM.
TOLERANCE, SAME_POSITION = 64, 0.6
#: Target rows that share a copy of their base grid in the tolerant any-position encoding.
STRIPE = 32


# ---- comparing blocks

def equal_strict(a: Column, b: Column) -> Column:
    """Same components with the same coefficients."""
    return a == b


def equal_tolerant(a: Column, b: Column, tolerance: int = TOLERANCE) -> Column:
    """Same number of components, each within the tolerance. The first coefficient alone is looked at first."""

    def near(x: Column, y: Column) -> Column:
        total = F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, d: s + d)
        return (F.abs(x[0].cast("int") - y[0].cast("int")) <= tolerance) & (total <= tolerance)

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, near), lambda ok: ok)


def compared(a: Column, b: Column, strict: bool) -> Column:
    """EXACT, SIMILAR (only without ``strict``) or DIFFERENT."""
    exact = F.when(equal_strict(a, b), "EXACT")
    return (exact if strict else exact.when(equal_tolerant(a, b), "SIMILAR")).otherwise("DIFFERENT")


def block_equal(a: Column, b: Column, strict: bool) -> Column:
    return equal_strict(a, b) if strict else equal_strict(a, b) | equal_tolerant(a, b)


def dc_hash(comps: Column) -> Column:
    """Key of a block: 8 bits each of four low coefficients of its first component, halved."""
    c = comps[0]
    out = F.lit(0).cast("long")
    for k in (0, 1, 8, 9):
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftright(c[k].cast("int"), 1).bitwiseAND(255).cast("long"))
    return out


def gathered(blocks: DataFrame, components: DataFrame) -> DataFrame:
    """(image_id, row, col, comps) of images whose components all have sampling factors of 1.

    ``blocks``: image_id, comp, row, col, coeff; ``components``: image_id, comp, h_samp, v_samp.
    """
    fit = components.groupBy("image_id").agg(F.max(F.greatest("h_samp", "v_samp")).alias("m"), F.count("*").alias("n")).filter("m = 1").select("image_id", "n")
    cells = blocks.join(fit, "image_id").groupBy("image_id", "row", "col", "n").agg(F.array_sort(F.collect_list(F.struct("comp", "coeff"))).alias("x"))
    return cells.filter("size(x) = n").select("image_id", "row", "col", F.transform("x", lambda c: c["coeff"]).alias("comps"))


def shape(cells: DataFrame) -> DataFrame:
    """(pair_id, height, width)."""
    return cells.groupBy("pair_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count("*").alias("n"))


def same_shape(target: DataFrame, base: DataFrame) -> DataFrame:
    """(pair_id, height, width) of the pairs whose grids are whole and of one shape."""
    t, b = shape(target), shape(base)
    return t.join(b, ["pair_id", "height", "width", "n"]).filter("n = height * width").select("pair_id", "height", "width")


def aligned(target: DataFrame, base: DataFrame) -> DataFrame:
    """(pair_id, row, col, t_comps, b_comps): same-position cells."""
    t = target.select("pair_id", "row", "col", F.col("comps").alias("t_comps"))
    return t.join(base.select("pair_id", "row", "col", F.col("comps").alias("b_comps")), ["pair_id", "row", "col"])


# ---- routing

def coordinate_hints(target_features: DataFrame, base_features: DataFrame) -> DataFrame:
    """(pair_id, t_row, t_col, b_row, b_col): where both signatures' first feature lies. Hash values are not compared.

    Features carry pair_id, transform_index, row, col.
    """
    t = target_features.filter("transform_index = 0").select("pair_id", F.col("row").alias("t_row"), F.col("col").alias("t_col"))
    b = base_features.filter("transform_index = 0").select("pair_id", F.col("row").alias("b_row"), F.col("col").alias("b_col"))
    return t.join(b, "pair_id")


def routes(pairs: DataFrame, mode: str = "auto", same_ratio: DataFrame | None = None) -> DataFrame:
    """(pair_id, route): FPM or DCHash. A forced mode wins; else a hint that is aligned means FPM, another hint DCHash; without a hint the share of equal same-position cells decides.

    ``pairs``: pair_id and the hint's columns, nulls for none; ``same_ratio``: pair_id, ratio.
    """
    if mode not in ("auto", "fpm", "dchash"):
        raise ValueError(f"unknown mode {mode!r}: auto, fpm or dchash")
    if mode != "auto":
        return pairs.select("pair_id", F.lit({"fpm": "FPM", "dchash": "DCHash"}[mode]).alias("route"))
    hint = F.when(F.col("t_row").isNotNull(), (F.col("t_row") == F.col("b_row")) & (F.col("t_col") == F.col("b_col")))
    if same_ratio is not None:
        pairs = pairs.join(same_ratio, "pair_id", "left")
        hint = F.coalesce(hint, F.col("ratio") >= SAME_POSITION)
    return pairs.select("pair_id", F.when(F.coalesce(hint, F.lit(False)), "FPM").otherwise("DCHash").alias("route"))


def same_position_ratio(cells: DataFrame, strict: bool) -> DataFrame:
    """(pair_id, ratio) from ``aligned`` cells."""
    return cells.groupBy("pair_id").agg(F.avg(block_equal(F.col("t_comps"), F.col("b_comps"), strict).cast("double")).alias("ratio"))


# ---- encoding

def _numbered(rows: DataFrame) -> DataFrame:
    """Sequence numbers in scan order of the targets."""
    w = Window.partitionBy("pair_id").orderBy("t_row", "t_col")
    i = lambda c: F.col(c).cast("int").alias(c)
    return rows.select("pair_id", (F.row_number().over(w) - 1).alias("seq"), "kind", i("t_row"), i("t_col"), i("b_row"), i("b_col"), i("length"), "block")


def fpm_runs(cells: DataFrame, strict: bool, min_copy: int = 1) -> DataFrame:
    """(pair_id, row, start, length, copy): maximal runs of equal and of unequal same-position cells of ``aligned``; a run of equal cells shorter than ``min_copy`` is no copy."""
    eq = cells.select("pair_id", "row", "col", block_equal(F.col("t_comps"), F.col("b_comps"), strict).alias("eq"))
    island = F.col("col") - F.row_number().over(Window.partitionBy("pair_id", "row", "eq").orderBy("col"))
    runs = eq.withColumn("island", island).groupBy("pair_id", "row", "eq", "island").agg(F.min("col").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.select("pair_id", "row", "start", "length", (F.col("eq") & (F.col("length") >= min_copy)).alias("copy"))


def fpm_instructions(cells: DataFrame, strict: bool, min_copy: int = 1) -> DataFrame:
    """Fixed-position encoding of ``aligned`` cells: COPY for runs of equal cells, INSERT for each other cell."""
    runs = fpm_runs(cells, strict, min_copy)
    none = F.lit(None).cast("int")
    copies = runs.filter("copy").select("pair_id", F.lit("COPY").alias("kind"), F.col("row").alias("t_row"), F.col("start").alias("t_col"), F.col("row").alias("b_row"), F.col("start").alias("b_col"), "length", F.lit(None).cast("array<array<smallint>>").alias("block"))
    spots = runs.filter("not copy").select("pair_id", "row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("col"))
    inserts = spots.join(cells, ["pair_id", "row", "col"]).select("pair_id", F.lit("INSERT").alias("kind"), F.col("row").alias("t_row"), F.col("col").alias("t_col"), none.alias("b_row"), none.alias("b_col"), none.alias("length"), F.col("t_comps").alias("block"))
    return _numbered(copies.unionByName(inserts))


def dchash_candidates(target: DataFrame, base: DataFrame) -> DataFrame:
    """(pair_id, t_row, t_col, b_row, b_col): target and base cells of equal block keys."""
    t = target.select("pair_id", F.col("row").alias("t_row"), F.col("col").alias("t_col"), dc_hash(F.col("comps")).alias("key"))
    b = base.select("pair_id", F.col("row").alias("b_row"), F.col("col").alias("b_col"), dc_hash(F.col("comps")).alias("key"))
    return t.join(b, ["pair_id", "key"]).drop("key")


def spans(cells: DataFrame) -> DataFrame:
    """(pair_id, row, span, start, length, comps): maximal stretches of neighbouring cells of a row with the same blocks, numbered in the row."""
    w = Window.partitionBy("pair_id", "row").orderBy("col")
    same = (F.lag("comps").over(w) == F.col("comps")) & (F.lag("col").over(w) == F.col("col") - 1)
    marked = cells.select("pair_id", "row", "col", "comps", (~F.coalesce(same, F.lit(False))).cast("int").alias("new")).withColumn("span", F.sum("new").over(w))
    return marked.groupBy("pair_id", "row", "span").agg(F.min("col").alias("start"), F.count("*").cast("int").alias("length"), F.first("comps").alias("comps"))


def longest_matches(target: DataFrame, base: DataFrame) -> DataFrame:
    """(pair_id, t_row, t_col, b_row, b_col, length): for each target cell the base place from which the longest run of equal cells follows, strictly; ties go to the first in row-major order.

    Neighbouring equal cells of a row are one span, and spans of equal blocks are an equi-join: two blank grids of n
    rows meet in n * n spans, not in all pairs of their cells. Of target and base spans that end together, the match goes on
    into the next two; from a target cell with k cells of its span left, a base span of k or more cells is entered k
    before its end if the match goes on from there, else at its start. Base spans that serve a target span alike
    are reduced to the first. Textures of single cells still meet cell by cell.
    """
    t, b = spans(target), spans(base)
    t = t.select("pair_id", "comps", F.col("row").alias("t_row"), F.col("span").alias("t_span"), F.col("start").alias("t_start"), F.col("length").alias("t_length"))
    b = b.select("pair_id", "comps", F.col("row").alias("b_row"), F.col("span").alias("b_span"), F.col("start").alias("b_start"), F.col("length").alias("b_length"))
    # all that follows is of one target row: partitioned once
    hits = t.join(b, ["pair_id", "comps"]).drop("comps").repartition("pair_id", "t_row").withColumn("diagonal", F.col("b_span") - F.col("t_span"))
    line = Window.partitionBy("pair_id", "t_row", "b_row", "diagonal")
    w = line.orderBy("t_span")
    meets = lambda x, y: (y("t_start") == x("t_start") + x("t_length")) & (y("b_start") == x("b_start") + x("b_length"))
    lag, lead = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    goes_on = meets(lag, F.col) & (lag("t_length") == lag("b_length"))
    hits = hits.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("next", F.coalesce(meets(F.col, lead), F.lit(False)))
    hits = hits.withColumn("chain", F.sum("new").over(w))
    rest = Window.partitionBy("pair_id", "t_row", "b_row", "diagonal", "chain").orderBy(F.desc("t_span"))
    hits = hits.withColumn("reach", F.sum(F.least("t_length", "b_length")).over(rest))
    hits = hits.withColumn("after", F.when(F.col("next"), F.lead("reach").over(w)).otherwise(0))
    first = F.min(F.struct("b_row", "b_start")).alias("x")
    hits = hits.groupBy("pair_id", "t_row", "t_start", "t_length", "b_length", "after").agg(first).select("*", "x.*")
    k, long = F.col("k"), F.col("b_length") >= F.col("k")
    cells = hits.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("t_length"))))
    length = F.when(long, k + F.col("after")).otherwise(F.col("b_length"))
    place = F.col("b_start") + F.when(long & (F.col("after") > 0), F.col("b_length") - k).otherwise(0)
    cells = cells.select("pair_id", "t_row", (F.col("t_start") + F.col("t_length") - k).alias("t_col"), length.alias("length"), "b_row", place.cast("int").alias("b_col"))
    best = F.min(F.struct((-F.col("length")).alias("l"), "b_row", "b_col")).alias("x")
    return cells.groupBy("pair_id", "t_row", "t_col").agg(best).select("pair_id", "t_row", "t_col", "x.b_row", "x.b_col", (-F.col("x.l")).cast("int").alias("length"))


def dchash_instructions(target: DataFrame, base: DataFrame, min_copy: int = 1) -> DataFrame:
    """Any-position encoding, strict: left to right in each row, the longest match is copied and skipped over, other cells are inserted.

    The greedy walk over a row is one fold over its cells' best matches.
    """
    best = longest_matches(target, base)
    own = target.select("pair_id", F.col("row").alias("t_row"), F.col("col").alias("t_col")).join(best, ["pair_id", "t_row", "t_col"], "left")
    cell = F.struct(F.col("t_col"), F.col("b_row"), F.col("b_col"), F.when(F.col("length") >= min_copy, F.col("length")).alias("length"))
    lines = own.groupBy("pair_id", "t_row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    kind = "array<struct<t_col:int,b_row:int,b_col:int,length:int>>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast(kind).alias("out"))

    def step(acc: Column, c: Column) -> Column:
        taken = F.struct(c["t_col"].cast("int").alias("t_col"), c["b_row"].cast("int").alias("b_row"), c["b_col"].cast("int").alias("b_col"), c["length"].cast("int").alias("length"))
        free = c["t_col"] >= acc["next"]
        return F.struct(
            F.when(free, (c["t_col"] + F.coalesce(c["length"], F.lit(1))).cast("int")).otherwise(acc["next"]).alias("next"),
            F.when(free, F.concat(acc["out"], F.array(taken).cast(kind))).otherwise(acc["out"]).alias("out"),
        )

    walked = lines.select("pair_id", "t_row", F.explode(F.aggregate("cells", start, step)["out"]).alias("x")).select("pair_id", "t_row", "x.*")
    blocks = target.select("pair_id", F.col("row").alias("t_row"), F.col("col").alias("t_col"), "comps")
    walked = walked.join(blocks, ["pair_id", "t_row", "t_col"])
    copy = F.col("length").isNotNull()
    out = walked.select("pair_id", F.when(copy, "COPY").otherwise("INSERT").alias("kind"), "t_row", "t_col", F.when(copy, F.col("b_row")).alias("b_row"), F.when(copy, F.col("b_col")).alias("b_col"), "length", F.when(~copy, F.col("comps")).alias("block"))
    return _numbered(coalesced(out))


def dchash_instructions_tolerant(target: DataFrame, base: DataFrame, min_copy: int = 1, tolerance: int = TOLERANCE) -> DataFrame:
    """Any-position encoding that also copies similar blocks: a run begins where block keys are equal and goes on while blocks are within the tolerance.

    A run may pass through blocks whose keys differ, so it is no equi-join: STRIPE target rows of a pair walk beside
    its base grid (bounded by its image), which is sent once for each stripe and indexed by key.
    """
    t = target.groupBy("pair_id", F.floor(F.col("row") / STRIPE).alias("stripe")).agg(F.array_sort(F.collect_list(F.struct("row", "col", "comps"))).alias("cells"))
    b = base.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "comps"))).alias("base"))
    stripes = t.join(b, "pair_id").select("pair_id", "cells", "base")

    def blocks(cells):
        width = max(c["col"] for c in cells) + 1
        flat = np.array([[np.asarray(x, np.int64) for x in c["comps"]] for c in cells])
        return flat.reshape(-1, width, *flat.shape[1:])

    def key(grid):
        return ((grid[..., 0, [0, 1, 8, 9]] >> 1) & 255) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])

    def run(batches):
        for batch in batches:
            out = []
            for pair, cells, grid in batch.itertuples(index=False):
                own_rows, all_base = blocks(cells), blocks(grid)
                width, first = all_base.shape[1], cells[0]["row"]
                base_keys = key(all_base).ravel()
                order = np.argsort(base_keys, kind="stable")  # row-major among equal keys
                base_keys = base_keys[order]
                for row, (own, keys) in enumerate(zip(own_rows, key(own_rows), strict=True), first):
                    col = 0
                    while col < len(own):
                        best, at, left = 0, None, len(own) - col
                        for place in order[slice(*np.searchsorted(base_keys, (keys[col], keys[col] + 1)))].tolist():
                            r, c = divmod(place, width)
                            n = min(left, width - c)
                            if n <= best:  # a tie goes to the first
                                continue
                            near = np.abs(own[col : col + n] - all_base[r, c : c + n]).sum(axis=-1).max(axis=-1) <= tolerance
                            n = n if near.all() else int(near.argmin())
                            if n > best:
                                best, at = n, (r, c)
                            if best == left:
                                break
                        if at and best >= min_copy:
                            out.append((pair, "COPY", row, col, *at, best, None))
                            col += best
                        else:
                            out.append((pair, "INSERT", row, col, None, None, None, [x.tolist() for x in own[col]]))
                            col += 1
            yield pd.DataFrame(out, columns=["pair_id", "kind", "t_row", "t_col", "b_row", "b_col", "length", "block"]).astype({"b_row": "Int64", "b_col": "Int64", "length": "Int64"})

    kinds = f"pair_id {dict(target.dtypes)['pair_id']}, kind string, t_row int, t_col int, b_row int, b_col int, length int, block array<array<smallint>>"
    return _numbered(coalesced(stripes.mapInPandas(run, kinds)))


def coalesced(instructions: DataFrame) -> DataFrame:
    """Neighbouring COPYs that go on in both grids as one; INSERTs as they are."""
    w = Window.partitionBy("pair_id", "t_row").orderBy("t_col")
    before = lambda c: F.lag(c).over(w)
    goes_on = (F.col("kind") == "COPY") & (before("kind") == "COPY") & (before("b_row") == F.col("b_row")) & (before("t_col") + before("length") == F.col("t_col")) & (before("b_col") + before("length") == F.col("b_col"))
    marked = instructions.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(w))
    copies = marked.filter("kind = 'COPY'").groupBy("pair_id", "kind", "t_row", "b_row", "run").agg(F.min("t_col").alias("t_col"), F.min("b_col").alias("b_col"), F.sum("length").cast("int").alias("length"))
    copies = copies.withColumn("block", F.lit(None).cast("array<array<smallint>>"))
    return copies.drop("run").unionByName(marked.filter("kind = 'INSERT'").drop("new", "run", "seq"))


def delta_instructions(target: DataFrame, base: DataFrame, route: DataFrame, strict: bool = True, min_copy: int = 1) -> DataFrame:
    """Instructions of each pair by its route (pair_id, route); pairs of unequal shapes have none."""
    fit = same_shape(target, base).select("pair_id")
    of = lambda df, name: df.join(fit, "pair_id", "left_semi").join(route.filter(F.col("route") == name).select("pair_id"), "pair_id", "left_semi")
    fpm = fpm_instructions(aligned(of(target, "FPM"), of(base, "FPM")), strict, min_copy)
    other = dchash_instructions if strict else dchash_instructions_tolerant
    return fpm.unionByName(other(of(target, "DCHash"), of(base, "DCHash"), min_copy))


# ---- replay and checks

def copied_cells(instructions: DataFrame) -> DataFrame:
    """(pair_id, seq, row, col, b_row, b_col): the cells of the COPYs."""
    spread = instructions.filter("kind = 'COPY'").select("pair_id", "seq", "t_row", "t_col", "b_row", "b_col", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("k"))
    return spread.select("pair_id", "seq", F.col("t_row").alias("row"), (F.col("t_col") + F.col("k")).alias("col"), "b_row", (F.col("b_col") + F.col("k")).alias("b_col"))


def replay(instructions: DataFrame, base: DataFrame) -> DataFrame:
    """(pair_id, row, col, comps): the grid that the instructions make of the base; a later instruction overwrites an earlier one."""
    b = base.select("pair_id", F.col("row").alias("b_row"), F.col("col").alias("b_col"), "comps")
    copies = copied_cells(instructions).join(b, ["pair_id", "b_row", "b_col"]).select("pair_id", "seq", "row", "col", "comps")
    inserts = instructions.filter("kind = 'INSERT'").select("pair_id", "seq", F.col("t_row").alias("row"), F.col("t_col").alias("col"), F.col("block").alias("comps"))
    last = Window.partitionBy("pair_id", "row", "col").orderBy(F.desc("seq"))
    return copies.unionByName(inserts).withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("pair_id", "row", "col", "comps")


def uncovered(instructions: DataFrame, grid: DataFrame) -> DataFrame:
    """(pair_id, row, col): cells of ``grid`` that no instruction fills."""
    filled = copied_cells(instructions).select("pair_id", "row", "col").union(instructions.filter("kind = 'INSERT'").select("pair_id", "t_row", "t_col"))
    return grid.select("pair_id", "row", "col").join(filled, ["pair_id", "row", "col"], "left_anti")


def out_of_bounds(instructions: DataFrame, shapes: DataFrame) -> DataFrame:
    """Instructions with a place or span outside the grid (pair_id, height, width) or an empty span."""
    n = F.when(F.col("kind") == "COPY", F.col("length")).otherwise(F.lit(1))
    inside = (n > 0) & (F.col("t_row") >= 0) & (F.col("t_row") < F.col("height")) & (F.col("t_col") >= 0) & (F.col("t_col") + n <= F.col("width"))
    base = (F.col("b_row") >= 0) & (F.col("b_row") < F.col("height")) & (F.col("b_col") >= 0) & (F.col("b_col") + n <= F.col("width"))
    ok = inside & ((F.col("kind") == "INSERT") | base)
    return instructions.join(shapes, "pair_id").filter(~F.coalesce(ok, F.lit(False))).select(*instructions.columns)


def verified(target: DataFrame, restored: DataFrame) -> DataFrame:
    """(pair_id, cells, equal, ok): whether the restored grid is the target, all components exactly."""
    t = target.select("pair_id", "row", "col", F.col("comps").alias("t"))
    both = t.join(restored.select("pair_id", "row", "col", F.col("comps").alias("r")), ["pair_id", "row", "col"], "full")
    same = F.coalesce(F.col("t") == F.col("r"), F.lit(False))
    return both.groupBy("pair_id").agg(F.count("*").alias("cells"), F.sum(same.cast("long")).alias("equal"), F.min(same).alias("ok"))


# ---- statistics

def block_map(instructions: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_id, block_map): 1 for cells of COPYs and 0 for others, in row-major order."""
    copied = copied_cells(instructions).select("pair_id", "row", "col").distinct().withColumn("copy", F.lit(1))
    cells = target.select("pair_id", "row", "col").join(copied, ["pair_id", "row", "col"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce("copy", F.lit(0)).cast("tinyint").alias("m"))))
    return cells.groupBy("pair_id").agg(F.transform(ordered, lambda x: x["m"]).alias("block_map"))


def similarity_stats(instructions: DataFrame, target: DataFrame, base: DataFrame, strict: bool = True) -> DataFrame:
    """(pair_id, blocks_total, blocks_exact, blocks_similar, blocks_different): how copied cells compare with their source; all others are different."""
    t = target.select("pair_id", "row", "col", F.col("comps").alias("t"))
    b = base.select("pair_id", F.col("row").alias("b_row"), F.col("col").alias("b_col"), F.col("comps").alias("b"))
    kinds = copied_cells(instructions).join(t, ["pair_id", "row", "col"]).join(b, ["pair_id", "b_row", "b_col"]).select("pair_id", "row", "col", compared(F.col("t"), F.col("b"), strict).alias("k"))
    cells = t.select("pair_id", "row", "col").join(kinds, ["pair_id", "row", "col"], "left")
    n = lambda k: F.sum((F.col("k") == k).cast("long"))
    counts = cells.groupBy("pair_id").agg(F.count("*").alias("blocks_total"), F.coalesce(n("EXACT"), F.lit(0)).alias("blocks_exact"), F.coalesce(n("SIMILAR"), F.lit(0)).alias("blocks_similar"))
    return counts.withColumn("blocks_different", F.col("blocks_total") - F.col("blocks_exact") - F.col("blocks_similar"))


def varint_bytes(x: Column) -> Column:
    """Bytes of an unsigned number of at most 32 bits in groups of seven."""
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 21, 3).when(x < 1 << 28, 4).otherwise(5)


def size_accounting(instructions: DataFrame, components: int = 1) -> DataFrame:
    """(pair_id, copies, inserts, copy_meta_bytes, insert_raw_bytes) without packing: 12 bytes a COPY of 16-bit numbers, else its varints; 128 bytes a component of each INSERT."""
    names = ["t_row", "t_col", "b_row", "b_col", "length"]
    short = F.greatest(*names) <= 65535
    meta = F.when(F.col("kind") == "COPY", F.when(short, 12).otherwise(2 + sum((varint_bytes(F.col(c)) for c in names), F.lit(0)))).otherwise(0)
    insert = (F.col("kind") == "INSERT").cast("long")
    return instructions.groupBy("pair_id").agg((F.count("*") - F.sum(insert)).alias("copies"), F.sum(insert).alias("inserts"), F.sum(meta.cast("long")).alias("copy_meta_bytes"), (F.sum(insert) * 128 * max(1, components)).alias("insert_raw_bytes"))
