"""Grids and pairs made from the embeddings table: a vector of 64 numbers is one block, 20 blocks are a 4 x 5 grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, row, col, coeff): coefficients are a thousand times the numbers, rounded down."""
    return load(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 20").alias("image_id"),
        F.expr("cast((vec_id % 20) div 5 as int)").alias("row"),
        F.expr("cast(vec_id % 5 as int)").alias("col"),
        F.expr("transform(embedding, x -> cast(floor(cast(x as double) * 1000) as smallint))").alias("coeff"),
        (F.col("vec_id") % 7 == 0).alias("mark"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(targets, bases) of rows (pair_id, row, col, comps), over all whole grids.

    The pair shift-i moves grid i right by two columns and fills in the first two of the next grid (the
    first's after the last); the pair mutate-i changes two coefficients of every seventh vector by 3.
    """
    own = cells(spark, sf_dir)
    n = load(spark, sf_dir, "embeddings").agg(F.expr("count(*) div 20").alias("n"))
    own = own.withColumn("n", n.scalar()).filter("image_id < n")
    name = lambda kind, image: F.concat(F.lit(f"{kind}-"), image.cast("string")).alias("pair_id")
    comps = F.array("coeff").alias("comps")
    image = F.col("image_id")
    moved = own.filter("col < 3").select(name("shift", image), "row", (F.col("col") + 2).cast("int").alias("col"), comps)
    filled = own.filter("col < 2").select(name("shift", (image - 1 + F.col("n")) % F.col("n")), "row", "col", comps)
    changed = F.expr("array(if(mark, transform(coeff, (x, i) -> cast(case i when 0 then x + 3 when 1 then x - 3 else x end as smallint)), coeff))").alias("comps")
    mutated = own.select(name("mutate", image), "row", "col", changed)
    targets = moved.unionByName(filled).unionByName(mutated)
    bases = own.select(name("shift", image), "row", "col", comps).unionByName(own.select(name("mutate", image), "row", "col", comps))
    return targets, bases


def as_images(pairs_side: DataFrame) -> DataFrame:
    """The cells of one side of pairs as luma grids (image_id, row, col, coeff)."""
    return pairs_side.select(F.col("pair_id").alias("image_id"), "row", "col", F.col("comps")[0].alias("coeff"))


# ---- the same in DuckDB SQL

CELLS = """
    cells as (select vec_id // 20 as image_id, ((vec_id % 20) // 5)::int as "row", (vec_id % 5)::int as col, vec_id,
                     list_transform(embedding, lambda x: floor(x::double * 1000)::smallint) as coeff from embeddings)"""
PAIRS = (
    CELLS
    + """,
    whole as (select c.*, n from cells c, (select count(*) // 20 as n from embeddings) where image_id < n),
    base as (select k || '-' || image_id as pair_id, "row", col, [coeff] as comps from whole, (values ('shift'), ('mutate')) v(k)),
    target as (
        select 'shift-' || image_id as pair_id, "row", col + 2 as col, [coeff] as comps from whole where col < 3
        union all select 'shift-' || ((image_id - 1 + n) % n), "row", col, [coeff] from whole where col < 2
        union all select 'mutate-' || image_id, "row", col,
            [case when vec_id % 7 = 0 then list_concat([(coeff[1] + 3)::smallint, (coeff[2] - 3)::smallint], coeff[3:]) else coeff end] from whole)"""
)


def signature_ctes(source: str, prefix: str = "", transforms: int = 10) -> str:
    """CTEs {prefix}bitmap, {prefix}windows and {prefix}features over ``source`` (image_id, row, col, coeff), window 2."""
    from ..functions import u64

    two64 = "18446744073709551616"
    mul = lambda a, k: f"(({a})::uhugeint * {k}::uhugeint % {two64}::uhugeint)::ubigint"
    signed = lambda a: f"case when {a} >= 9223372036854775808 then ({a}::hugeint - {two64}::hugeint)::bigint else {a}::bigint end"
    v = "((dc::int + 65536) % 65536 + bit::int * 65536)::ubigint"
    fold = f"{u64.FOLD_START}::ubigint"
    for i in range(4):
        fold = mul(f"xor({fold}, w{i})", u64.FOLD_FACTOR)
    params = ", ".join(f"({i}, {a}::ubigint, {b}::ubigint)" for i, (a, b) in enumerate(u64.linear_parameters(transforms)))
    p = prefix
    return f"""
    {p}bitmap as (select image_id, "row", col, dc, (dc >= sum(dc) over w // count(*) over w)::tinyint as bit
        from (select image_id, "row", col, coeff[1] as dc from {source}) window w as (partition by image_id)),
    {p}coded as (select *, {v} as v from {p}bitmap),
    {p}quads as (select a.image_id, a."row", a.col, a.v as w0, b.v as w1, c.v as w2, d.v as w3, (a.bit::int * 8 + b.bit::int * 4 + c.bit::int * 2 + d.bit::int) as bits
        from {p}coded a join {p}coded b on b.image_id = a.image_id and b."row" = a."row" and b.col = a.col + 1
        join {p}coded c on c.image_id = a.image_id and c."row" = a."row" + 1 and c.col = a.col
        join {p}coded d on d.image_id = a.image_id and d."row" = a."row" + 1 and d.col = a.col + 1),
    {p}m0 as (select image_id, "row", col, xor({fold}, {mul("bits", u64.BITS_FACTOR)}) as x from {p}quads where bits not in (0, 15)),
    {p}m1 as (select image_id, "row", col, {mul("xor(x, x >> 33)", u64.MIX_1)} as x from {p}m0),
    {p}m2 as (select image_id, "row", col, {mul("xor(x, x >> 33)", u64.MIX_2)} as x from {p}m1),
    {p}windows as (select image_id, "row", col, xor(x, x >> 33) as h from {p}m2),
    {p}transformed as (select image_id, i, (({mul("h", "a")})::uhugeint + b) % {two64}::uhugeint as t, h, "row", col from {p}windows, (values {params}) q(i, a, b)),
    {p}features as (select image_id, i::int as transform_index, {signed("t::ubigint")} as hash, {signed("h")} as window_hash, "row", col
        from {p}transformed qualify row_number() over (partition by image_id, i order by t, "row", col) = 1)"""


def signed_sql(a: str) -> str:
    return f"case when {a} >= 9223372036854775808 then ({a}::hugeint - 18446744073709551616::hugeint)::bigint else {a}::bigint end"
