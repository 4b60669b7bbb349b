"""Queries over documents, packages, statistics and checks; they join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import delta
from ..operators.ordering import ranked, running_sums
from ..scratch import written
from ..sources import logs, package, text
from . import documents, greedy, grids, rollup, sketch_scan, verify
from .grids import CELLS, PAIRS, load
from .queries import ACCOUNTED, ROUTED, query, routed

# ---- packages


def _packed(spark, sf_dir):
    target, base, ins = routed(spark, sf_dir)
    shapes = delta.same_shape(target, base)
    route = ins.groupBy("pair_id").agg(F.max((F.col("b_row").isNotNull() & ((F.col("b_row") != F.col("t_row")) | (F.col("b_col") != F.col("t_col")))).cast("int")).alias("moved"))
    heads = shapes.join(route, "pair_id").select("pair_id", F.concat(F.lit("base-"), "pair_id").alias("base_id"), F.when(F.col("moved") == 1, "DCHash").otherwise("FPM").alias("route"), "width", "height", F.lit(1).alias("components"), F.lit(None).cast("binary").alias("prefix"))
    return target, base, ins, package.pack(ins, heads)


@query("package_roundtrip", f"with recursive {ROUTED} select pair_id, seq, kind, t_row, t_col, b_row, b_col, length, block from ins")
def package_roundtrip(spark, sf_dir):
    return package.unpack(_packed(spark, sf_dir)[3]).filter("error is null").select("pair_id", "seq", "kind", "t_row", "t_col", "b_row", "b_col", "length", "block")


@query("package_restore_verify", f"with {PAIRS} select pair_id, count(*) as cells, count(*) as equal, true as ok from target group by pair_id")
def package_restore_verify(spark, sf_dir):
    target, base, _, packed = _packed(spark, sf_dir)
    return delta.verified(target, delta.replay(package.unpack(packed), base))


@query("package_raw_size", f"with recursive {ACCOUNTED} select pair_id, 52 + strlen('base-' || pair_id) + copy_meta_bytes + inserts * 6 + insert_raw_bytes as raw_bytes from sizes")
def package_raw_size(spark, sf_dir):
    sizes = delta.size_accounting(routed(spark, sf_dir)[2])
    meta = F.col("copy_meta_bytes") + F.col("inserts") * 6
    return sizes.select("pair_id", package.raw_size(F.concat(F.lit("base-"), "pair_id"), F.lit(0), meta, F.col("insert_raw_bytes")).cast("long").alias("raw_bytes"))


@query("zigzag_order", f"with {CELLS} select image_id, \"row\", col, list_transform([{', '.join(map(str, package.ZIGZAG))}], lambda i: coeff[i + 1]) as zigzag from cells")
def zigzag_order(spark, sf_dir):
    order = F.array(*[F.lit(i) for i in package.ZIGZAG])
    return grids.cells(spark, sf_dir).select("image_id", "row", "col", F.transform(order, lambda i: F.element_at("coeff", i + 1)).alias("zigzag"))


@query("luma_text", f"with {CELLS} select image_id, (max(col) + 1) || ' ' || (max(\"row\") + 1) || chr(10) || string_agg(array_to_string(coeff, ' '), chr(10) order by \"row\", col) || chr(10) as text from cells group by image_id")
def luma_text(spark, sf_dir):
    return text.luma_text(grids.cells(spark, sf_dir))


@query("luma_text_roundtrip", f"with {CELLS}, whole as (select image_id from cells group by image_id having count(*) = 20) select image_id, \"row\", col, coeff from cells semi join whole using (image_id)")
def luma_text_roundtrip(spark, sf_dir):
    return text.parse_luma_text(text.luma_text(grids.cells(spark, sf_dir))).filter("error is null").select("image_id", "row", "col", "coeff")


# ---- hashes and baselines

@query("content_digests", "select doc_id, sha256(coalesce(text, '')) as sha256, md5(coalesce(text, '')) as md5 from documents")
def content_digests(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return verify.digests(docs).select("doc_id", "sha256", "md5")


@query("exact_dedup_baseline", "select doc_id, case when row_number() over (partition by md5(coalesce(text, '')) order by doc_id) > 1 then 0 else strlen(coalesce(text, '')) end::bigint as stored_bytes from documents")
def exact_dedup_baseline(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    first = docs.groupBy("md5").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "md5").select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("size")).otherwise(0).cast("long").alias("stored_bytes"))


@query("zlib_baseline")
def zlib_baseline(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return docs.select("doc_id", F.octet_length("content").cast("long").alias("size"), verify.zlib_bytes("content").alias("zlib_bytes"))


@query(
    "fnv1a64_bytes",
    """with recursive b as (select item_id, hex(encode(text)) as h from benchmark),
    f as (select item_id, h, 0 as i, 1469598103934665603::ubigint as x from b
        union all select item_id, h, i + 1, (xor(x, ('0x' || substr(h, 2 * i + 1, 2))::ubigint)::uhugeint * 1099511628211::uhugeint % 18446744073709551616::uhugeint)::ubigint from f where 2 * i < len(h))
    select item_id, case when x >= 9223372036854775808 then (x::hugeint - 18446744073709551616::hugeint)::bigint else x::bigint end as fnv from f where 2 * i = len(h)""",
)
def fnv1a64_bytes(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("content"))
    return verify.fnv1a64(items).select("item_id", "fnv")


# ---- the scan over documents

def parsed_documents(spark, sf_dir, *more: Column) -> DataFrame:
    return written(documents.parsed(load(spark, sf_dir, "documents").select("doc_id", "text"), *more), "parsed")


def scanned_documents(spark, sf_dir, docs: DataFrame | None = None) -> DataFrame:
    """The scan of ``docs``, the parsed documents where they are made already."""
    docs = parsed_documents(spark, sf_dir) if docs is None else docs
    lines = documents.lines(docs)
    return sketch_scan.scan(documents.items(docs), docs.select("image_id", "sketch"), lambda pairs: documents.line_deltas(pairs, lines))


@query("greedy_scan_status", f"with recursive {documents.SCAN} select * from scanned")
def greedy_scan_status(spark, sf_dir):
    return scanned_documents(spark, sf_dir)


@query(
    "scan_manifest",
    f"""with recursive {documents.SCAN}, tries as (select *, row_number() over (order by rank) as n from scanned where reason not in ('no_match', 'feature extraction failed'))
    select image_id as target, 'deltas/' || image_id || '.' || lpad(n::varchar, 6, '0') || '.ddct' as ddct_file, 'bases/' || base as base_file, sha256(coalesce(text, '')) as original_sha256, true as strict_lossless
    from tries join documents on doc_id::varchar = image_id where status = 'deduped'""",
)
def scan_manifest(spark, sf_dir):
    docs = parsed_documents(spark, sf_dir, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return greedy.manifest(written(scanned_documents(spark, sf_dir, docs), "scanned"), docs.select("image_id", "sha256"))


STATS = """sum(1) over w as processed_images, sum((status in ('new_base', 'kept_original'))::int) over w as base_images, sum((status = 'deduped')::int) over w as deduped_images,
    sum((status = 'failed')::int) over w as failed_images, sum(original_size) over w as processed_original_size, sum(compressed_size) over w as dedup_total_size"""


@query(
    "running_scan_stats",
    f"""with recursive {documents.SCAN}, s as (select image_id, rank, {STATS} from scanned window w as (order by rank))
    select image_id, rank, processed_images::bigint as processed_images, base_images::bigint as base_images, deduped_images::bigint as deduped_images, failed_images::bigint as failed_images,
        processed_original_size::bigint as processed_original_size, dedup_total_size::bigint as dedup_total_size,
        case when dedup_total_size > 0 then processed_original_size::double / dedup_total_size::double else 0.0 end as compression_ratio,
        case when processed_original_size > 0 then (1.0::double - dedup_total_size::double / processed_original_size::double) * 100.0::double else 0.0 end as savings_percent,
        greatest(0.0::double, processed_original_size::double - dedup_total_size::double) / 1048576.0::double as saved_mb from s""",
)
def running_scan_stats(spark, sf_dir):
    return greedy.running_stats(written(scanned_documents(spark, sf_dir), "scanned"))


@query("running_event_stats", "select event_id, (sum(value) over (order by event_id))::bigint as value_so_far, count(*) over (order by event_id) as events_so_far from (select event_id, floor(coalesce(value, 0))::bigint as value from events)")
def running_event_stats(spark, sf_dir):
    own = load(spark, sf_dir, "events").select("event_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("value_so_far"), F.lit(1).cast("long").alias("events_so_far"))
    return running_sums(ranked(own, "event_id"), "rank", ["value_so_far", "events_so_far"]).select("event_id", "value_so_far", "events_so_far")


@query("block_similarity_text", f"""with recursive {ROUTED}, n as (select t.pair_id, count(*) as n, count(c.seq) as e from target t left join copied c on c.pair_id = t.pair_id and c."row" = t."row" and c.col = t.col group by t.pair_id)
    select pair_id, printf('Exact %.1f%% | Similar %.1f%% | Different %.1f%%', 100.0::double * e / n, 0.0::double, 100.0::double * (n - e) / n) as similarity from n""")
def block_similarity_text(spark, sf_dir):
    target, base, ins = routed(spark, sf_dir)
    return delta.similarity_stats(ins, target, base).select("pair_id", greedy.similarity_text("blocks_exact", "blocks_similar", "blocks_different", "blocks_total").alias("similarity"))


# ---- rollups

def _grid_costs(spark, sf_dir):
    target, base, ins = routed(spark, sf_dir)
    meta = delta.size_accounting(ins)
    text = lambda side, name: side.groupBy("pair_id").agg(F.md5(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "comps"))), lambda c: F.concat_ws(",", c["comps"][0].cast("array<string>"))))).alias(name), (F.count("*") * 128).alias(f"{name}_size"))
    both = text(target, "t").join(text(base, "b"), "pair_id").join(meta, "pair_id")
    size = F.lit(52) + F.octet_length(F.concat(F.lit("base-"), "pair_id")) + F.col("copy_meta_bytes") + F.col("inserts") * 6 + F.col("insert_raw_bytes")
    return both.select(F.element_at(F.split("pair_id", "-"), 1).alias("dataset"), F.element_at(F.split("pair_id", "-"), 2).alias("base_id"), F.col("t_size").alias("target_size"), F.col("b_size").alias("base_size"), size.cast("long").alias("delta_size"), F.when(F.col("t") == F.col("b"), 0).otherwise(F.col("t_size")).cast("long").alias("md5_size"), F.col("t_size").alias("zlib_size"), F.lit(0.0).alias("seconds"))


@query(
    "benchmark_rollup",
    f"""with recursive {ACCOUNTED}, tt as (select pair_id, list(comps order by "row", col) as t, count(*) * 128 as size from target group by 1), bb as (select pair_id, list(comps order by "row", col) as b from base group by 1),
    p as (select split_part(pair_id, '-', 1) as dataset, size, case when t = b then 0 else size end as md5_size, 52 + strlen('base-' || pair_id) + copy_meta_bytes + inserts * 6 + insert_raw_bytes as d from tt join bb using (pair_id) join sizes using (pair_id)),
    s as (select dataset, count(*) as pairs, sum(size)::bigint as o, sum(d)::bigint as d, sum(md5_size)::bigint as m from p group by dataset)
    select dataset, pairs, o as original_size, 2 * o as full_original_size, d as delta_size, m as md5_size, o as base_pack_size, pairs as bases, o + d as archive_size, o::double / d as delta_ratio,
        case when m > 0 then o::double / m else 1.0 end as md5_ratio, (2 * o)::double / (o + d) as full_flow_ratio,
        greatest(o::double - d::double, 0.0::double) / o::double * 100.0::double as delta_saving_pct, greatest((2 * o)::double - (o + d)::double, 0.0::double) / (2 * o)::double * 100.0::double as system_wide_saving_pct from s""",
)
def benchmark_rollup(spark, sf_dir):
    return rollup.rollup(_grid_costs(spark, sf_dir)).select("dataset", "pairs", "original_size", "full_original_size", "delta_size", "md5_size", "base_pack_size", "bases", "archive_size", "delta_ratio", "md5_ratio", "full_flow_ratio", "delta_saving_pct", "system_wide_saving_pct")


# ---- integrity, names, logs

ENTRIES = """entries as (select doc_id, doc_id % 17 <> 0 as has_delta, doc_id % 19 <> 0 as has_base, doc_id % 2 = 0 as has_source, doc_id % 23 <> 0 as has_original, doc_id % 29 <> 0 as restored,
    doc_id % 5 <> 0 and doc_id % 13 <> 0 as sha_match, doc_id % 31 <> 0 as md5_match, doc_id % 37 <> 0 as pixel_equal, doc_id % 13 <> 0 as has_expected, doc_id % 3 = 0 as strict from documents)"""


def _entries(spark, sf_dir):
    load(spark, sf_dir, "documents").createOrReplaceTempView("blockweave_documents")
    return spark.sql("with " + ENTRIES.replace("from documents", "from blockweave_documents") + " select * from entries")


STRICT_STATUS = "case when not has_delta then 'MISSING_DDCT' when not has_base then 'MISSING_BASE' when has_source and not has_original then 'MISSING_ORIGINAL' when not restored then 'RESTORE_FAILED' when not has_source then case when sha_match or not has_expected then 'VERIFIED' else 'RESTORED' end when sha_match and md5_match and pixel_equal then 'VERIFIED' else 'CRITICAL FAILURE' end"
VIEW_STATUS = "case when not has_delta then 'missing_ddct' when not has_base then 'missing_base' when has_source and not has_original then 'missing_original' when not restored then 'restore_failed' when has_source and strict and (not pixel_equal or not sha_match) then 'critical_failure' when has_source and has_expected and sha_match then case when pixel_equal then 'verified' else 'pixel_mismatch' end when has_source and has_expected then 'sha_mismatch' else 'restored' end"


@query("integrity_status", f"with {ENTRIES} select doc_id, {STRICT_STATUS} as status, {VIEW_STATUS} as view_status from entries")
def integrity_status(spark, sf_dir):
    return verify.view_status(verify.strict_status(_entries(spark, sf_dir))).select("doc_id", "status", "view_status")


@query("integrity_summary", f"""with {ENTRIES}, c as (select {STRICT_STATUS} as s from entries)
    select count(*) as total, count(*) filter (s in ('VERIFIED', 'RESTORED', 'MISMATCH', 'CRITICAL FAILURE')) as restored, count(*) filter (s = 'VERIFIED') as verified, count(*) filter (s in ('MISMATCH', 'CRITICAL FAILURE')) as mismatched,
        count(*) filter (s = 'CRITICAL FAILURE') as critical, count(*) filter (s = 'MISSING_DDCT') as missing_ddct, count(*) filter (s = 'MISSING_BASE') as missing_base, count(*) filter (s = 'MISSING_ORIGINAL') as missing_original, count(*) filter (s = 'RESTORE_FAILED') as restore_failed from c""")
def integrity_summary(spark, sf_dir):
    return verify.strict_summary(verify.strict_status(_entries(spark, sf_dir)))


NAMED = "case doc_id % 5 when 0 then '_base.jpg' when 1 then '_target.jpg' when 2 then '_target_shifted.jpg' when 3 then '_target_stress.jpg' else '_base_Q90.jpg' end"


@query("pair_names", f"""with f as (select 'set/' || (doc_id // 5) || {NAMED} as path from documents), t as (select path, split_part(path, '_target', 1) as p from f where path like '%\\_target%.jpg' escape '\\')
    select t.path as target, f.path as base from t join f on f.path = t.p || '_base.jpg'""")
def pair_names(spark, sf_dir):
    files = load(spark, sf_dir, "documents").select(F.expr(f"concat('set/', cast(doc_id div 5 as string), {NAMED}) as path"))
    return rollup.exact_pairs(files)


@query("pair_names_by_prefix", f"""with f as (select 'set/' || (doc_id // 5) || {NAMED} as path from documents), t as (select path, split_part(path, '_target', 1) as p from f where path like '%\\_target.jpg' escape '\\' or path like '%\\_target\\_shifted.jpg' escape '\\')
    select t.path as target, min(f.path) as base from t join f on starts_with(f.path, t.p || '_base') group by t.path""")
def pair_names_by_prefix(spark, sf_dir):
    files = load(spark, sf_dir, "documents").select(F.expr(f"concat('set/', cast(doc_id div 5 as string), {NAMED}) as path"))
    return rollup.prefix_pairs(files)


@query("metric_log_parse", """select doc_id as log_id, case when doc_id % 2 = 0 then 'FPM' else 'DCHash' end as router_branch, strlen(text) as original_size_bytes, (doc_id + 400)::bigint as dedup_size_raw_bytes, null::bigint as dedup_size_zstd_bytes,
    2.5::double as compression_ratio_raw, null::double as compression_ratio_zstd, null::double as similarity_seconds, null::double as idelta_seconds, 0.25::double as total_seconds, null::double as throughput_mb_s,
    '' as restore_luma_dct, 'passed' as restore_bytewise, '0xabc' as reference_hash_fnv1a64, '' as restored_hash_fnv1a64 from documents""")
def metric_log_parse(spark, sf_dir):
    text = F.concat(F.lit("[Router] Using "), F.when(F.col("doc_id") % 2 == 0, "FPM").otherwise("DCHash"), F.lit(" Branch\nOriginal Size (bytes): "), F.octet_length("text").cast("string"), F.lit("\n  Dedup Size RAW (bytes): "), (F.col("doc_id") + 400).cast("string"), F.lit("\nCompression Ratio RAW: 2.5\nTotal Time (s): 2.5e-1\nRestore Check Bytewise: passed\nReference Hash FNV1a64: 0xabc\nnoise: 3\n"))
    return logs.parsed(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("log_id"), text.alias("text")))
