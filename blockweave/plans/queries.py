"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows (where SQL can)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, features, votes
from ..scratch import settled, written
from ..session import ship
from . import grids
from .grids import CELLS, PAIRS, load, signature_ctes, signed_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return settled(lambda: f(spark, sf_dir), name)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


# ---- features

@query("dc_bitmap", f"with {CELLS}, {signature_ctes('cells')} select image_id, \"row\", col, dc, bit from bitmap")
def dc_bitmap(spark, sf_dir):
    return features.dc_bitmap(grids.cells(spark, sf_dir))


@query("window_hashes", f"with {CELLS}, {signature_ctes('cells')} select image_id, \"row\", col, {signed_sql('h')} as window_hash from windows")
def window_hashes(spark, sf_dir):
    return features.window_hashes(features.dc_bitmap(grids.cells(spark, sf_dir)))


@query("minhash_features", f"with {CELLS}, {signature_ctes('cells')} select * from features")
def minhash_features(spark, sf_dir):
    return features.signatures(grids.cells(spark, sf_dir))


@query("feature_api", f"with {CELLS}, {signature_ctes('cells')} select image_id, list(hash order by transform_index) as hashes from features group by image_id")
def feature_api(spark, sf_dir):
    return features.extract_features(grids.cells(spark, sf_dir))


@query("inverted_index", f"with {CELLS}, {signature_ctes('cells')} select distinct hash, image_id from features")
def inverted_index(spark, sf_dir):
    return votes.inverted_index(features.signatures(grids.cells(spark, sf_dir)))


TARGET_IMAGES = "t as (select pair_id as image_id, \"row\", col, comps[1] as coeff from target)"
BOTH = f"{PAIRS}, {TARGET_IMAGES}, {signature_ctes('t', 't_')}, {signature_ctes('cells', 'b_')}"
GRID_VOTES = f"""{BOTH},
    votes as (select t.image_id as target_id, b.image_id::varchar as base_id, count(*) as votes
        from (select distinct hash, image_id from t_features) t join (select distinct hash, image_id from b_features) b using (hash) group by all)"""


def _target_features(spark, sf_dir):
    return features.signatures(grids.as_images(grids.pairs(spark, sf_dir)[0]))


def _base_features(spark, sf_dir):
    return features.signatures(grids.cells(spark, sf_dir)).withColumn("image_id", F.col("image_id").cast("string"))


@query("vote_scores", f"with {GRID_VOTES} select * from votes")
def vote_scores(spark, sf_dir):
    return votes.vote_scores(_target_features(spark, sf_dir), _base_features(spark, sf_dir))


@query("best_base_lexicographic", f"with {GRID_VOTES} select target_id, base_id, votes from votes qualify row_number() over (partition by target_id order by votes desc, base_id) = 1")
def best_base_lexicographic(spark, sf_dir):
    return votes.best_base(votes.vote_scores(_target_features(spark, sf_dir), _base_features(spark, sf_dir)))


@query(
    "best_base_first_seen",
    f"""with {BOTH},
    firsts as (select image_id, hash, min(transform_index) as f from t_features group by all),
    placed as (select image_id, hash, row_number() over (partition by image_id order by f) as pos from firsts),
    votes as (select t.image_id as target_id, b.image_id as rank, count(*) as votes, min(pos) as first_pos
        from placed t join (select distinct hash, image_id from b_features) b using (hash) group by all)
    select target_id, rank::varchar as base_id, votes from votes
    qualify row_number() over (partition by target_id order by votes desc, first_pos, rank) = 1 and votes >= 2""",
)
def best_base_first_seen(spark, sf_dir):
    bases = _base_features(spark, sf_dir)
    ranks = bases.select(F.col("image_id").alias("base_id"), F.col("image_id").cast("long").alias("rank")).distinct()
    return votes.best_base_first_seen(votes.first_seen_votes(_target_features(spark, sf_dir), bases), ranks, 2)


TRIGRAMS = r"""list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""


def _trigrams(df: DataFrame, key: str) -> DataFrame:
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.select(F.col(key).cast("string").alias("image_id"), w.alias("w"))
    grams = F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2])))")
    return df.select("image_id", F.explode(F.array_distinct(grams)).alias("hash"))


@query(
    "document_passage_votes",
    rf"""with d as (select doc_id::varchar as id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    b as (select item_id::varchar as id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
    dg as (select id, unnest({TRIGRAMS}) as g from d where len(w) > 2), bg as (select id, unnest({TRIGRAMS}) as g from b where len(w) > 2),
    v as (select dg.id as target_id, bg.id as base_id, count(*) as votes from dg join bg using (g) group by all)
    select target_id, base_id, votes from v qualify row_number() over (partition by target_id order by votes desc, base_id) = 1 and votes >= 2""",
)
def document_passage_votes(spark, sf_dir):
    # the items' trigrams are written, so that their size is known when the join is planned: small ones are broadcast, and the documents' are not shuffled
    docs, items = _trigrams(load(spark, sf_dir, "documents"), "doc_id"), written(_trigrams(load(spark, sf_dir, "benchmark"), "item_id"), "trigrams")
    return votes.best_base(votes.vote_scores(docs, items, exclude_same=False, distinct=True)).filter("votes >= 2")


# ---- comparing and routing

L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(t.comps[1][i]::int - b.comps[1][i]::int)))"
POSITIONS = 'target t join base b on t.pair_id = b.pair_id and t."row" = b."row" and t.col = b.col'


@query("block_classify", f"""with {PAIRS} select t.pair_id, t."row", t.col, case when t.comps = b.comps then 'EXACT' else 'DIFFERENT' end as strict, case when t.comps = b.comps then 'EXACT' when {L1} <= 64 then 'SIMILAR' else 'DIFFERENT' end as tolerant from {POSITIONS}""")
def block_classify(spark, sf_dir):
    c = delta.aligned(*grids.pairs(spark, sf_dir))
    t, b = F.col("t_comps"), F.col("b_comps")
    return c.select("pair_id", "row", "col", delta.compared(t, b, True).alias("strict"), delta.compared(t, b, False).alias("tolerant"))


KEY = "((({c}[1]::int >> 1) & 255)::bigint * 16777216 + (({c}[2]::int >> 1) & 255) * 65536 + (({c}[9]::int >> 1) & 255) * 256 + (({c}[10]::int >> 1) & 255))"


@query("dc_hash_key", f"""with {PAIRS} select pair_id, "row", col, {KEY.format(c="comps[1]")} as key from base""")
def dc_hash_key(spark, sf_dir):
    return grids.pairs(spark, sf_dir)[1].select("pair_id", "row", "col", delta.dc_hash(F.col("comps")).alias("key"))


@query("dc_hash_candidates", f"""with {PAIRS} select t.pair_id, t."row" as t_row, t.col as t_col, b."row" as b_row, b.col as b_col from target t join base b on t.pair_id = b.pair_id and {KEY.format(c="t.comps[1]")} = {KEY.format(c="b.comps[1]")}""")
def dc_hash_candidates(spark, sf_dir):
    return delta.dchash_candidates(*grids.pairs(spark, sf_dir))


BASE_IMAGES = "bi as (select pair_id as image_id, \"row\", col, comps[1] as coeff from base)"
HINTS = f"""{PAIRS}, {TARGET_IMAGES}, {BASE_IMAGES}, {signature_ctes('t', 't_')}, {signature_ctes('bi', 'b_')},
    hints as (select t.image_id as pair_id, t."row" as t_row, t.col as t_col, b."row" as b_row, b.col as b_col from t_features t join b_features b on t.image_id = b.image_id and t.transform_index = 0 and b.transform_index = 0),
    ratios as (select t.pair_id, avg((t.comps = b.comps)::int) as ratio from {POSITIONS} group by all),
    routes as (select r.pair_id, case when t_row is not null then case when t_row = b_row and t_col = b_col then 'FPM' else 'DCHash' end when ratio >= 0.6 then 'FPM' else 'DCHash' end as route from ratios r left join hints h on r.pair_id = h.pair_id)"""


def _hints(target, base):
    f = lambda side: features.signatures(grids.as_images(side)).withColumnRenamed("image_id", "pair_id")
    return delta.coordinate_hints(f(target), f(base))


def _routes(target, base):
    ratio = delta.same_position_ratio(delta.aligned(target, base), True)
    return delta.routes(ratio.select("pair_id").join(_hints(target, base), "pair_id", "left"), same_ratio=ratio)


@query("coordinate_hint", f"with {HINTS} select * from hints")
def coordinate_hint(spark, sf_dir):
    return _hints(*grids.pairs(spark, sf_dir))


@query("select_route", f"with {HINTS} select * from routes")
def select_route(spark, sf_dir):
    return _routes(*grids.pairs(spark, sf_dir))


@query("same_position_ratio", f"with {HINTS} select * from ratios")
def same_position_ratio(spark, sf_dir):
    return delta.same_position_ratio(delta.aligned(*grids.pairs(spark, sf_dir)), True)


# ---- encoding

def runs_sql(equal: str, tag: str) -> str:
    return f"""
    {tag}eq as (select t.pair_id, t."row", t.col, ({equal}) as eq, t.comps as block from {POSITIONS}),
    {tag}isl as (select *, col - row_number() over (partition by pair_id, "row", eq order by col) as island from {tag}eq),
    {tag}runs as (select pair_id, "row", min(col) as start, count(*)::int as length, eq as copy from {tag}isl group by pair_id, "row", eq, island),
    {tag}ins as (select pair_id, 'COPY' as kind, "row" as t_row, start as t_col, "row" as b_row, start as b_col, length, null::smallint[][] as block from {tag}runs where copy
        union all select pair_id, 'INSERT', "row", col, null, null, null, block from {tag}eq where not eq),
    {tag}fpm as (select pair_id, (row_number() over (partition by pair_id order by t_row, t_col) - 1)::int as seq, kind, t_row::int as t_row, t_col::int as t_col, b_row::int as b_row, b_col::int as b_col, length::int as length, block from {tag}ins)"""


STRICT, TOLERANT = "t.comps = b.comps", f"t.comps = b.comps or {L1} <= 64"


@query("fpm_copy_runs", f"with {PAIRS}, {runs_sql(TOLERANT, 'x')} select * from xruns")
def fpm_copy_runs(spark, sf_dir):
    return delta.fpm_runs(delta.aligned(*grids.pairs(spark, sf_dir)), strict=False)


@query("fpm_instructions", f"with {PAIRS}, {runs_sql(STRICT, 'x')} select * from xfpm")
def fpm_instructions(spark, sf_dir):
    return delta.fpm_instructions(delta.aligned(*grids.pairs(spark, sf_dir)), strict=True)


@query("fpm_instructions_tolerant", f"with {PAIRS}, {runs_sql(TOLERANT, 'x')} select * from xfpm")
def fpm_instructions_tolerant(spark, sf_dir):
    return delta.fpm_instructions(delta.aligned(*grids.pairs(spark, sf_dir)), strict=False)


def dchash_sql(start: str, go_on: str, tag: str) -> str:
    """Longest match of each cell by recursion along the diagonal, then the greedy walk by recursion along the row."""
    return f"""
    {tag}ok as (select t.pair_id, t."row" as t_row, t.col as t_col, b."row" as b_row, b.col as b_col, ({start}) as first from target t join base b on t.pair_id = b.pair_id where {go_on}),
    {tag}ext as (select pair_id, t_row, t_col, b_row, b_col, 1 as length from {tag}ok where first
        union all select e.pair_id, e.t_row, e.t_col, e.b_row, e.b_col, e.length + 1 from {tag}ext e join {tag}ok o
            on o.pair_id = e.pair_id and o.t_row = e.t_row and o.b_row = e.b_row and o.t_col = e.t_col + e.length and o.b_col = e.b_col + e.length),
    {tag}best as (select * from {tag}ext qualify row_number() over (partition by pair_id, t_row, t_col order by length desc, b_row, b_col) = 1),
    {tag}cell as (select t.pair_id, t."row" as t_row, t.col as t_col, b_row, b_col, length, comps from target t left join {tag}best x on x.pair_id = t.pair_id and x.t_row = t."row" and x.t_col = t.col),
    {tag}walk as (select * from {tag}cell where t_col = 0
        union all select c.* from {tag}walk w join {tag}cell c on c.pair_id = w.pair_id and c.t_row = w.t_row and c.t_col = w.t_col + coalesce(w.length, 1)),
    {tag}dch as (select pair_id, (row_number() over (partition by pair_id order by t_row, t_col) - 1)::int as seq, case when length is null then 'INSERT' else 'COPY' end as kind,
        t_row::int as t_row, t_col::int as t_col, b_row::int as b_row, b_col::int as b_col, length::int as length, case when length is null then comps end as block from {tag}walk)"""


KEYS = f"{KEY.format(c='t.comps[1]')} = {KEY.format(c='b.comps[1]')}"


@query("dchash_longest_match", f"with recursive {PAIRS}, {dchash_sql(KEYS, STRICT, 'x')} select * from xbest")
def dchash_longest_match(spark, sf_dir):
    return delta.longest_matches(*grids.pairs(spark, sf_dir))


@query("dchash_instructions", f"with recursive {PAIRS}, {dchash_sql(KEYS, STRICT, 'x')} select * from xdch")
def dchash_instructions(spark, sf_dir):
    return delta.dchash_instructions(*grids.pairs(spark, sf_dir))


@query("dchash_instructions_tolerant", f"with recursive {PAIRS}, {dchash_sql(KEYS, TOLERANT, 'x')} select * from xdch")
def dchash_instructions_tolerant(spark, sf_dir):
    return delta.dchash_instructions_tolerant(*grids.pairs(spark, sf_dir))


#: Instructions of every pair by its route, strict.
ROUTED = f"""{HINTS}, {runs_sql(STRICT, 'f')}, {dchash_sql(KEYS, STRICT, 'd')},
    ins as (select * from ffpm semi join (select pair_id from routes where route = 'FPM') using (pair_id) union all select * from ddch semi join (select pair_id from routes where route = 'DCHash') using (pair_id)),
    copied as (select pair_id, seq, t_row as "row", t_col + k as col, b_row, b_col + k as b_col from (select *, unnest(range(length)) as k from ins where kind = 'COPY'))"""


def routed(spark, sf_dir):
    """(targets, bases, instructions) of every pair, each computed once and written."""
    target, base = (written(x, "grids") for x in grids.pairs(spark, sf_dir))
    route = written(_routes(target, base), "routes")
    return target, base, written(delta.delta_instructions(target, base, route, strict=True), "instructions")


@query("delta_instructions", f"with recursive {ROUTED} select * from ins")
def delta_instructions(spark, sf_dir):
    return routed(spark, sf_dir)[2]


@query("similarity_stats", f"""with recursive {ROUTED} select t.pair_id, count(*) as blocks_total, count(c.seq) as blocks_exact, 0::bigint as blocks_similar, count(*) - count(c.seq) as blocks_different from target t left join copied c on c.pair_id = t.pair_id and c."row" = t."row" and c.col = t.col group by t.pair_id""")
def similarity_stats(spark, sf_dir):
    target, base, ins = routed(spark, sf_dir)
    return delta.similarity_stats(ins, target, base).withColumn("blocks_similar", F.col("blocks_similar").cast("long"))


@query("block_map", f"""with recursive {ROUTED} select t.pair_id, list((c.seq is not null)::tinyint order by t."row", t.col) as block_map from target t left join copied c on c.pair_id = t.pair_id and c."row" = t."row" and c.col = t.col group by t.pair_id""")
def block_map(spark, sf_dir):
    target, _, ins = routed(spark, sf_dir)
    return delta.block_map(ins, target)


@query("heatmap_cells", f"""with recursive {ROUTED} select t.pair_id, (row_number() over (partition by t.pair_id order by t."row", t.col) - 1)::int as place, (c.seq is not null)::tinyint as copied from target t left join copied c on c.pair_id = t.pair_id and c."row" = t."row" and c.col = t.col""")
def heatmap_cells(spark, sf_dir):
    return block_map(spark, sf_dir).select("pair_id", F.posexplode("block_map").alias("place", "copied"))


@query("replay_target", f"""with recursive {PAIRS} select pair_id, "row", col, comps from target""")
def replay_target(spark, sf_dir):
    _, base, ins = routed(spark, sf_dir)
    return delta.replay(ins, base)


@query("replay_verify", f"""with recursive {PAIRS} select pair_id, count(*) as cells, count(*) as equal, true as ok from target group by pair_id""")
def replay_verify(spark, sf_dir):
    target, base, ins = routed(spark, sf_dir)
    return delta.verified(target, delta.replay(ins, base))


@query("coverage_bounds_check", f"""with {PAIRS} select pair_id, 0::bigint as uncovered, 0::bigint as outside from target group by pair_id""")
def coverage_bounds_check(spark, sf_dir):
    target, base, ins = routed(spark, sf_dir)
    ids = target.select("pair_id").distinct()
    gaps = delta.uncovered(ins, target).groupBy("pair_id").agg(F.count("*").alias("uncovered"))
    outside = delta.out_of_bounds(ins, delta.same_shape(target, base)).groupBy("pair_id").agg(F.count("*").alias("outside"))
    zero = F.lit(0).cast("long")
    return ids.join(gaps, "pair_id", "left").join(outside, "pair_id", "left").select("pair_id", F.coalesce("uncovered", zero).alias("uncovered"), F.coalesce("outside", zero).alias("outside"))


ACCOUNTED = f"""{ROUTED}, sizes as (select pair_id, count(*) filter (kind = 'COPY') as copies, count(*) filter (kind = 'INSERT') as inserts, count(*) filter (kind = 'COPY') * 12 as copy_meta_bytes, count(*) filter (kind = 'INSERT') * 128 as insert_raw_bytes from ins group by pair_id)"""


@query("package_size_accounting", f"with recursive {ACCOUNTED} select * from sizes")
def package_size_accounting(spark, sf_dir):
    return delta.size_accounting(routed(spark, sf_dir)[2])
