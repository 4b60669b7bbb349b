"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its share of the tokens to the power ``alpha`` (0: equal weights, 1: as they come),
normalised. ``alpha`` is found by bisection, many grid points a round, each evaluated for all sources by one
aggregation: either the largest alpha whose weights have at least a target entropy, or the smallest one for
which no source is repeated more than a limit. A token budget times its weight is what a source gives: whole
passes over it, then a part of one more pass.

A pass runs through the source in permuted blocks: a hash of the id deals documents into 64 blocks of 64
blocks of 64 blocks, each level's order is permuted for each source, and documents follow by hash within the
smallest. Where the budget ends is found level by level: token sums of 64 blocks, then of the 64 blocks of
the one in which the budget ends, and so on. So no task sees more of a hot source than one smallest block,
and sums are combined before they are sent. A document is taken if the budget covers it and all before it.

Edge cases: a null source is the source ""; null or blank texts have 0 tokens and go along with their place
in the pass; rows that repeat are at one place and are taken together; a source without tokens gets weight
0 and one copy of its rows; an empty table gives none; other columns are ignored or carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, written

#: Entropy aimed at, as a part of that of equal weights; grid points of a bisection round; rounds.
ENTROPY, GRID, ROUNDS = 0.92, 64, 8
LEVELS = ("b1", "b2", "b3")


def tokens(text="text") -> Column:
    """Words of a text: maximal runs other than 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _number(*parts: Column) -> Column:
    """60 bits of the md5 of some columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def place(seed: int, doc_id: Column, source: Column) -> list[Column]:
    """A document's place in its source's pass: three permuted block numbers, a hash, the id."""
    u = _number(F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    shift = _number(F.lit(f"{seed} order"), source)
    digits = [F.shiftright(u, s).bitwiseAND(63) for s in (54, 48, 42)]
    ranks = [F.pmod(d * 37 + F.shiftright(shift, 6 * i), F.lit(64)).cast("long").alias(n) for i, (d, n) in enumerate(zip(digits, LEVELS, strict=True))]
    return [*ranks, u.alias("u")]


def find_alpha(shares: DataFrame, entropy: float | None, repeats: float | None, budget_share: float = 1.0) -> float:
    """The exponent for ``shares`` (share: positive, summing to 1).

    With ``entropy`` (a part of that of equal weights, 0 to 1): the largest alpha in [0, 1] that reaches it.
    With ``repeats``: the smallest alpha in [0, 1] with at most that many passes over any source, 1 if none is.
    """
    lo, hi = 0.0, 1.0

    def fits(grid: list[float]) -> list[bool]:
        a = F.explode(F.array(*[F.lit(x) for x in grid])).alias("a")
        p = F.pow("share", "a")
        rows = shares.select("share", a).groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.col("a") * F.log("share")).alias("e"), F.max(F.pow("share", F.col("a") - 1)).alias("m"), F.count("*").alias("k"))
        by = {r["a"]: r for r in rows.collect()}  # a row for each grid point
        if entropy is not None:
            return [math.log(by[x]["z"]) - by[x]["e"] / by[x]["z"] >= entropy * math.log(by[x]["k"]) - 1e-12 for x in grid]
        return [by[x]["m"] / by[x]["z"] * budget_share <= repeats + 1e-12 for x in grid]

    ends = fits([lo, hi])
    if ends[1] and entropy is not None or not ends[1] and entropy is None:
        return 1.0
    if entropy is None and ends[0]:
        return 0.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / (GRID + 1) for i in range(1, GRID + 1)]
        ok = fits(grid)
        if entropy is not None:  # true, then false
            n = sum(ok)
            lo, hi = ([lo, *grid][n], [*grid, hi][n])
        else:  # false, then true
            n = ok.index(True) if True in ok else len(ok)
            lo, hi = ([lo, *grid][n], [*grid, hi][n])
        if hi - lo < 1e-14:
            break
    return lo if entropy is not None else hi


def cuts(sized: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, weight, passes, b1, b2, b3, u, doc_id): a source's weight, whole passes and last place in the part of a pass (nulls: none).

    ``sized`` has doc_id, source, n_tokens and the columns of ``place``. ``budget``: tokens of the mix, as many as there are by default.
    """
    per = written(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = per.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = per.filter("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(total)).alias("share")) if total else per.filter("false").select("source", "tokens", F.lit(0.0).alias("share"))
    alpha = find_alpha(shares, entropy, repeats, budget / total) if total else 1.0
    z = shares.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0] or 1.0
    weight = F.pow("share", F.lit(alpha)) / F.lit(z)
    goal = F.round(weight * F.lit(float(budget))).cast("long")
    plan = shares.select("source", "tokens", weight.alias("weight"), F.expr("0").alias("zero"), goal.alias("goal"))
    plan = plan.select("source", "weight", F.expr("goal div tokens").alias("passes"), F.expr("goal % tokens").alias("left"))
    plan = written(plan, "plan")
    # where the rest ends: in which block of each level, with how many tokens of it left
    at = plan.select("source", "left")
    for k, level in enumerate(LEVELS):
        keys = ["source", *LEVELS[:k]]
        inside = sized if k == 0 else sized.join(hinted(at.select(*keys), 256), keys, "left_semi")
        sums = inside.groupBy(*keys, level).agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy("source").orderBy(level)  # 64 rows a source at most
        sums = sums.withColumn("upto", F.sum("n").over(w)).join(at, keys)
        at = written(sums.filter("upto > left").groupBy(*keys).agg(F.min(F.struct(F.col(level), (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("x")).select(*keys, f"x.{level}", "x.left"), "ends")
    keys = ["source", *LEVELS]
    inside = sized.join(hinted(at.select(*keys), 256), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy("u", "doc_id")  # one smallest block; equal places count together
    last = inside.withColumn("upto", F.sum("n_tokens").over(w)).join(at, keys).filter("upto <= left")
    last = last.groupBy(*keys).agg(F.max(F.struct("u", "doc_id")).alias("x")).select(*keys, "x.u", "x.doc_id")
    ends = at.select(*keys).join(last, keys, "left").select(*keys, F.coalesce("u", F.lit(-1)).alias("u"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))
    out = per.select("source").join(plan.select("source", "weight", "passes"), "source", "left").join(ends, "source", "left")
    return written(out.select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(1)).cast("long").alias("passes"), *LEVELS, "u", "doc_id"), "cuts")


def sized_rows(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, place), written."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of().alias("source"), tokens().alias("n_tokens"))
    return written(own.select("doc_id", "source", "n_tokens", *place(seed, F.col("doc_id"), F.col("source"))), "sized")


def copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (with source, doc_id and place) with ``weight`` and ``copies``: how often the mix takes each."""
    cut = cut.select("source", "weight", "passes", F.when(F.col("b1").isNotNull(), F.struct(*LEVELS, "u", "doc_id")).alias("last"))
    own = F.struct(*LEVELS, "u", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))
    taken = F.coalesce((own <= F.col("last")).cast("long"), F.lit(0).cast("long"))
    return rows.join(hinted(cut, 256), "source").withColumn("copies", F.col("passes") + taken).drop("last", "passes")


def mixed(docs: DataFrame, seed: int = 1, entropy: float | None = ENTROPY, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, block, copies), a row for each row of ``docs`` (doc_id, text, source)."""
    sized = sized_rows(docs, seed)
    out = copies(sized, cuts(sized, entropy, repeats, budget))
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), F.col("b1").cast("int").alias("block"), "copies")


def take_mix(docs: DataFrame, seed: int = 1, entropy: float | None = ENTROPY, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, each as often as the mix takes it."""
    cut = cuts(sized_rows(docs, seed), entropy, repeats, budget)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(whole, source_of().alias("source"), F.col("doc_id").cast("long").alias("doc_id"))
    own = own.select("row", "source", "doc_id", *place(seed, F.col("doc_id"), F.col("source")))
    out = copies(own, cut).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
