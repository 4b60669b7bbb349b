"""Documents as block sequences: a line is a block, its number the position. For scans and rollups over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from ..scratch import written

#: Lines of a document's sketch: those of the smallest MD5.
SKETCH = 10
#: So many pairs count as few: their ids are broadcast.
FEW = 50000
HEAD_BYTES, COPY_BYTES, INSERT_BYTES = 52, 12, 6


def parsed(docs: DataFrame, *more: Column) -> DataFrame:
    """(image_id, doc_id, size, failed, sketch, lines) and ``more``: all that a scan needs of the documents' texts, which it reads once.

    sketch: the SKETCH smallest MD5 of a document's distinct lines, in their order. lines: digest and bytes of each line.
    """
    own = docs.select("doc_id", "text", F.split("text", "\n").alias("l"))
    md5s = F.transform(F.filter(F.array_distinct("l"), lambda x: x != ""), lambda x: F.md5(x))
    lines = F.transform("l", lambda x: F.struct(F.unhex(F.sha2(x, 256)).alias("digest"), F.octet_length(x).alias("n")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return own.select(F.col("doc_id").cast("string").alias("image_id"), "doc_id", size.alias("size"), F.coalesce(F.col("text") == "", F.lit(True)).alias("failed"), F.slice(F.array_sort(md5s), 1, SKETCH).alias("sketch"), lines.alias("lines"), *more)


def items(parsed: DataFrame) -> DataFrame:
    """(image_id, rank, size, failed): documents in id order; those without text fail."""
    return ranked(parsed.select("doc_id", "image_id", "size", "failed"), "doc_id").select("image_id", "rank", "size", "failed")


def lines(parsed: DataFrame) -> DataFrame:
    """(doc_id, lines) of the documents with text."""
    return parsed.filter("lines is not null").select(F.col("image_id").alias("doc_id"), "lines")


def line_deltas(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(target_id, base_id, success, compressed_size) of pairs (target_id, base_id) by fixed-position line runs of ``lines``.

    Runs of equal lines at equal positions cost COPY_BYTES, other lines INSERT_BYTES and themselves. ``pairs`` should be
    a written table: it is counted first, and for few pairs the lines of their documents are picked out in one pass.
    """
    pairs = pairs.select("target_id", "base_id").distinct()
    if pairs.limit(FEW + 1).count() <= FEW:
        ids = pairs.select(F.col("target_id").alias("doc_id")).union(pairs.select("base_id")).distinct()
        lines = written(lines.join(F.broadcast(ids), "doc_id", "left_semi"), "picked")
    both = pairs.join(lines.select(F.col("doc_id").alias("target_id"), F.col("lines").alias("t")), "target_id")
    both = both.join(lines.select(F.col("doc_id").alias("base_id"), F.col("lines").alias("b")), "base_id", "left")
    eq = lambda i: F.coalesce(F.get("t", i)["digest"] == F.get("b", i)["digest"], F.lit(False))
    cost = lambda x, i: F.when(eq(i), F.when(eq(i - 1), 0).otherwise(COPY_BYTES)).otherwise(x["n"] + INSERT_BYTES).cast("long")
    total = F.aggregate(F.transform("t", cost), F.lit(0).cast("long"), lambda s, c: s + c)
    return both.select("target_id", "base_id", F.lit(True).alias("success"), (total + HEAD_BYTES + F.octet_length("base_id")).cast("long").alias("compressed_size"))


# ---- the same in DuckDB SQL

SCAN = f"""
    lines as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
    sk as (select doc_id, hash, row_number() over (partition by doc_id order by hash) as pos from (select distinct doc_id, md5(line) as hash from lines where line <> '')
        qualify pos <= {SKETCH}),
    docs as (select doc_id, row_number() over (order by doc_id) - 1 as rank, coalesce(strlen(text), 0) as size, coalesce(text = '', true) as failed from documents),
    votes as (select t.doc_id as t, b.doc_id as b, count(*) as votes, min(t.pos) as first_pos from sk t join sk b on t.hash = b.hash and b.doc_id < t.doc_id
        where t.doc_id not in (select doc_id from docs where failed) and b.doc_id not in (select doc_id from docs where failed) group by all),
    eq as (select v.t, v.b, l.pos, l.line, coalesce(l.line = m.line, false) as eq from votes v join lines l on l.doc_id = v.t left join lines m on m.doc_id = v.b and m.pos = l.pos where votes >= 2),
    costs as (select t, b, case when eq then case when coalesce(lag(eq) over (partition by t, b order by pos), false) then 0 else {COPY_BYTES} end else strlen(line) + {INSERT_BYTES} end as cost from eq),
    results as (select t, b, sum(cost)::bigint + {HEAD_BYTES} + strlen(b::varchar) as size from costs group by t, b),
    cand as (select t, b, votes, first_pos, size from votes join results using (t, b)),
    walk as (
        select -1::bigint as rank, []::bigint[] as reg, null::bigint as doc_id, '' as status, '' as reason, null::bigint as base, null::bigint as votes, 0.0::double as ratio, null::bigint as stored
        union all
        select rank, case when status in ('new_base', 'kept_original') then list_append(reg, doc_id) else reg end, doc_id, status, reason, base, votes, ratio, stored from (
            select d.rank, w.reg, d.doc_id,
                case when d.failed then 'failed' when c.t is null then 'new_base' when c.size > 0 and d.size::double / c.size > 1.05 then 'deduped' when d.size::double / c.size < 1.0 then 'kept_original' else 'new_base' end as status,
                case when d.failed then 'feature extraction failed' when c.t is null then 'no_match' when c.size > 0 and d.size::double / c.size > 1.05 then 'dedup_success' when d.size::double / c.size < 1.0 then 'redundancy_low_keep_original' else 'low_ratio_or_failed' end as reason,
                c.b as base, c.votes, case when c.t is null then 0.0 else d.size::double / c.size end as ratio,
                case when c.t is not null and d.size::double / c.size > 1.05 then c.size else d.size end as stored
            from walk w join docs d on d.rank = w.rank + 1 left join cand c on c.t = d.doc_id and list_contains(w.reg, c.b)
            qualify row_number() over (order by c.votes desc nulls last, c.first_pos, c.b) = 1)),
    steps as (select * from walk where rank >= 0),
    bases as (select doc_id from steps where status in ('new_base', 'kept_original')),
    seen as (select t as doc_id, max(votes) as seen from votes where b in (select doc_id from bases) group by t),
    scanned as (select doc_id::varchar as image_id, rank, status, reason, coalesce(base::varchar, '') as base, case when reason = 'no_match' then coalesce(seen, 0) else coalesce(votes, 0) end::bigint as votes, ratio,
        d.size as original_size, stored as compressed_size from steps left join seen using (doc_id) join (select doc_id, size from docs) d using (doc_id))"""
