"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import settled
from ..session import ship
from . import bpe, embedding_dedup, exact_dedup, license_scan, minhash, mixing, secret_scan, substring_dedup, token_counts, toxicity
from .common import table

#: The id that the vocabulary's files leave free; it ends documents.
SEPARATOR = 50256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return settled(lambda: f(spark, sf_dir), name)

        QUERIES[name] = run
        return run

    return add


@query("op1_minhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), minhash.Banding(words=2))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_findings(table(spark, sf_dir, "documents"))


@query("op3_embedding_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"), path="source")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe.default_vocabulary()
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, pattern, SEPARATOR).select("doc_id", "n_tokens")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, *bpe.default_vocabulary(), decoded=True))


@query("op8_exact_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(table(spark, sf_dir, "documents"))


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {
    "op10_mixing": r"""
        with recursive d as (select doc_id, coalesce(source, '') as source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as n from documents),
        s as (select source, sum(n)::bigint as tokens from d group by 1),
        p as (select source, tokens, total, tokens::double / total as share from s, (select sum(tokens)::bigint as total from s) where tokens > 0),
        b as (
            select 0 as i, 0.0::double as lo, 1.0::double as hi
            union all
            select i + 1, case when h >= least_h then mid else lo end, case when h >= least_h then hi else mid end from (
                select i, lo, hi, (lo + hi) / 2 as mid, ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ((lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2)) as h, 0.92::double * ln(count(*)) - 1e-12 as least_h
                from b, p where i < 60 group by i, lo, hi)),
        a as (select case when (select -sum(share * ln(share)) >= 0.92::double * ln(count(*)) - 1e-12 from p) then 1.0::double else (select lo from b where i = 60) end as alpha),
        w as (select source, tokens, pow(share, alpha) / (select sum(pow(share, alpha)) from p, a) as weight, total from p, a),
        g as (select source, weight, round(weight * total)::bigint // tokens as passes, round(weight * total)::bigint % tokens as rest from w),
        u as (select *, ('0x' || substr(md5('1|' || doc_id), 1, 15))::bigint as u, ('0x' || substr(md5('1 order|' || source), 1, 15))::bigint as o from d),
        r as (select *, (((u >> 54) & 63) * 37 + o) % 64 as b1, (((u >> 48) & 63) * 37 + (o >> 6)) % 64 as b2, (((u >> 42) & 63) * 37 + (o >> 12)) % 64 as b3 from u),
        c as (select *, sum(n) over (partition by source order by b1, b2, b3, u, doc_id) as upto from r)
        select doc_id, source, n as n_tokens, round(coalesce(weight, 0.0::double), 9) as weight, b1::int as block, (coalesce(passes, 1) + coalesce((upto <= rest)::int, 0))::bigint as copies
        from c left join g using (source)
    """,
    "op1_minhash_dedup": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents),
        s as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
            from w),
        n as (select doc_id, len(s) as n from s),
        e as (select doc_id, unnest(s) as x from s),
        c as (select a.doc_id as u, b.doc_id as v, count(*) as k from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by all),
        l as (select u, v from c join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 80 * (a.n + b.n - k)),
        r as (select doc_id, doc_id as c from n union select l.v, r.c from r join l on l.u = r.doc_id),
        m as (select doc_id, min(c) as c from r group by doc_id)
        select doc_id, n as n_shingles, c as component_id, doc_id = c as kept from n join m using (doc_id)
    """,
    "op3_embedding_dedup": r"""
        with recursive g as (
            select vec_id, embedding::double[] as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l as (select a.vec_id as u, b.vec_id as v from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
              where list_cosine_similarity(a.e, b.e) >= 0.95),
        r as (select vec_id, vec_id as c from embeddings union select l.v, r.c from r join l on l.u = r.vec_id),
        m as (select vec_id, min(c) as c from r group by vec_id),
        k as (select u, count(*) as k from l group by u)
        select vec_id, coalesce(k, 0)::bigint as n_links, c as component_id, vec_id = c as kept
        from embeddings join m using (vec_id) left join k on u = vec_id
    """,
    "op8_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from n
    """,
}
