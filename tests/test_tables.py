import numpy as np
import pytest
from jpeg_fixture import baseline, image
from pyspark.sql import functions as F

from blockweave import api, cli
from blockweave.functions import u64
from blockweave.operators import components, delta, features, ordering
from blockweave.plans import documents, greedy, images, queries, rollup, scan_queries, sketch_scan, verify
from blockweave.sources import archive, jpeg, logs, package, text
from blockweave.streaming import scan as stream
from test_codecs import shifted, sparse


def cells(spark, grid, pair="p"):
    rows = [(pair, r, c, grid[r, c].tolist()) for r in range(grid.shape[0]) for c in range(grid.shape[1])]
    return spark.createDataFrame(rows, "pair_id string, row int, col int, comps array<array<smallint>>")


def shown(ins):
    return [(r.t_row, r.t_col, r.b_row, r.b_col, r.length) if r.kind == "COPY" else (r.t_row, r.t_col) for r in ins.orderBy("pair_id", "seq").collect()]


def test_encoders_agree_with_the_single_pair_engine(spark):
    from blockweave.sources import engine

    for target, base in (sparse(), shifted()):
        t, b = cells(spark, target), cells(spark, base)
        for strict in (True, False):
            want = [(x.t_row, x.t_col, x.b_row, x.b_col, x.length) if isinstance(x, package.Copy) else (x.t_row, x.t_col) for x in engine.fpm(target, base, strict)]
            assert shown(delta.fpm_instructions(delta.aligned(t, b), strict)) == want
            f = delta.dchash_instructions if strict else delta.dchash_instructions_tolerant
            want = [(x.t_row, x.t_col, x.b_row, x.b_col, x.length) if isinstance(x, package.Copy) else (x.t_row, x.t_col) for x in engine.dchash(target, base, strict)]
            assert shown(f(t, b)) == want


def test_tolerant_encoder_over_several_stripes(spark):
    from blockweave.sources import engine

    rng = np.random.default_rng(5)
    some = rng.integers(-300, 300, (4, 2, 64)).astype(np.int16)
    target, base = (some[rng.integers(0, 4, (delta.STRIPE + 3, 5))] for _ in range(2))
    target = target + rng.integers(0, 2, target.shape).astype(np.int16)  # some blocks within the tolerance, some not
    want = [(x.t_row, x.t_col, x.b_row, x.b_col, x.length) if isinstance(x, package.Copy) else (x.t_row, x.t_col) for x in engine.dchash(target, base, False)]
    got = shown(delta.dchash_instructions_tolerant(cells(spark, target), cells(spark, base)))
    assert got == want and {len(x) for x in got} == {2, 5}


def test_longest_matches_by_brute_force(spark):
    """Grids of few different blocks, so that spans, ties and matches over several spans abound; one with cells left out."""
    rng = np.random.default_rng(8)
    some = rng.integers(-300, 300, (2, 1, 64)).astype(np.int16)
    for n, (shares, hole) in enumerate([((0.5, 0.5), 0), ((0.9, 0.1), 0), ((1.0, 0.0), 0), ((0.7, 0.3), 1)]):
        t, b = (rng.choice(2, (6, 9), p=shares) for _ in range(2))
        keep = lambda df: df.filter("not (row % 3 = 1 and col = 4)") if hole else df  # noqa: B023, E731
        gone = lambda r, c: hole and r % 3 == 1 and c == 4  # noqa: B023, E731

        def length(r, c, y, x, t=t, b=b, gone=gone):
            k = 0
            while c + k < 9 and x + k < 9 and not gone(r, c + k) and not gone(y, x + k) and t[r, c + k] == b[y, x + k]:
                k += 1
            return k

        want = {}
        for r, c in np.ndindex(6, 9):
            found = [(-length(r, c, y, x), y, x) for y, x in np.ndindex(6, 9) if length(r, c, y, x)]
            if found:
                want[r, c] = (min(found)[1], min(found)[2], -min(found)[0])
        got = delta.longest_matches(keep(cells(spark, some[t])), keep(cells(spark, some[b]))).collect()
        assert {(x.t_row, x.t_col): (x.b_row, x.b_col, x.length) for x in got} == want, n


def test_random_grids_replay(spark):
    rng = np.random.default_rng(3)
    some = rng.integers(-300, 300, (3, 2, 64)).astype(np.int16)
    ts, bs = zip(*[(cells(spark, some[rng.integers(0, 3, (4, 6))], f"p{i}"), cells(spark, some[rng.integers(0, 3, (4, 6))], f"p{i}")) for i in range(3)], strict=True)
    target, base = ts[0].union(ts[1]).union(ts[2]), bs[0].union(bs[1]).union(bs[2])
    ins = delta.dchash_instructions(target, base).cache()
    assert delta.uncovered(ins, target).count() == 0
    assert delta.out_of_bounds(ins, delta.same_shape(target, base)).count() == 0
    assert [r.ok for r in delta.verified(target, delta.replay(ins, base)).collect()] == [True] * 3
    bad = ins.withColumn("b_col", F.col("b_col") + 90)
    assert delta.out_of_bounds(bad, delta.same_shape(target, base)).count() == ins.filter("kind = 'COPY'").count()


def test_routes(spark):
    pairs = spark.createDataFrame([("a", 1, 1, 1, 1), ("b", 1, 1, 1, 2), ("c", None, None, None, None), ("d", None, None, None, None)], "pair_id string, t_row int, t_col int, b_row int, b_col int")
    ratio = spark.createDataFrame([("c", 0.7), ("d", 0.5), ("b", 0.9)], "pair_id string, ratio double")
    assert dict(delta.routes(pairs, same_ratio=ratio).collect()) == {"a": "FPM", "b": "DCHash", "c": "FPM", "d": "DCHash"}
    assert {r.route for r in delta.routes(pairs, "dchash").collect()} == {"DCHash"}
    with pytest.raises(ValueError):
        delta.routes(pairs, "other")


def test_u64(spark):
    xs = [0, 1, 2**63, 2**64 - 1, 0x123456789ABCDEF]
    with u64.wrapping(spark):
        df = spark.createDataFrame([(u64.signed(x),) for x in xs], "x long").select("x", u64.mixed(F.col("x")).alias("m"), u64.decimal_text(F.col("x")).alias("t"))

    def mixed(x):
        for f in (u64.MIX_1, u64.MIX_2):
            x = (x ^ x >> 33) * f & u64.MASK
        return x ^ x >> 33

    assert [(r.m, r.t) for r in df.collect()] == [(u64.signed(mixed(x)), str(x)) for x in xs]
    assert len(u64.linear_parameters(40)) == 40 and all(a & 1 for a, _ in u64.linear_parameters(40)[32:])


def test_signature_text_and_luma_choice(spark):
    _, base = sparse()
    luma = cells(spark, base).select(F.col("pair_id").alias("image_id"), "row", "col", F.col("comps")[0].alias("coeff"))
    f = features.signatures(luma)
    out = features.signature_text(f, spark.createDataFrame([("p", 8, 4)], "image_id string, width int, height int")).first()["text"].splitlines()
    assert out[0] == "0 2 8 4 10" and out[1].startswith("0 1547300959844562293 ") and out[1].endswith(" 1 4")
    comps = spark.createDataFrame([("a", 0, 3, 1, 1), ("a", 1, 1, 9, 9), ("b", 0, 5, 2, 2), ("b", 1, 6, 3, 3), ("c", 0, 7, 1, 1)], "image_id string, comp int, component_id int, width int, height int")
    assert dict(features.luma_component(comps).collect()) == {"a": 1, "b": 1, "c": 0}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 500)]
    uf = components.UnionFind()
    for a, b in edges:
        uf.union(a, b)
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: uf.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    """10,000 links in a row, dealt over partitions that are never joined into one: O(log n) rounds, not n."""
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        rounds = []
        out = components.components(spark.range(10_000).selectExpr("id as u", "id + 1 as v").repartition(100), rounds)
        assert len(rounds) <= 20 and out.count() == 10_001 and out.filter("component <> 0").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranks_and_running_sums(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(1).cast("long").alias("n"), F.col("id").alias("v"))
    out = ordering.running_sums(ordering.ranked(df, "k"), "rank", ["n", "v"], width=16).orderBy("rank").collect()
    v = dict(df.select("k", "v").collect())
    total = 0
    for i, r in enumerate(out):
        total += v[i]
        assert (r["k"], r["rank"], r["n"], r["v"]) == (i, i, i + 1, total)


def decided(original, result, min_ratio, force):
    """(status, reason) of one target, step by step."""
    if result is None:
        return "new_base", "compress_image failed"
    success, size = result
    ratio = original / size if success and size > 0 else 0.0
    if success and size > 0 and (ratio > min_ratio or force):
        return "deduped", "forced_dedup" if force and not ratio > min_ratio else "dedup_success"
    if not force and ratio < 1.0:
        return "kept_original", "redundancy_low_keep_original"
    return "new_base", "low_ratio_or_failed"


def sequential(items, votes, results, threshold=2, min_ratio=1.05, force=False):
    bases, out = set(), {}
    rank = {i: r for i, r, _, _ in items}
    for i, _, size, failed in sorted(items, key=lambda x: x[1]):
        own = {b: (v, p) for (t, b), (v, p) in votes.items() if t == i and b in bases}
        top = max((v for v, _ in own.values()), default=0)
        if failed:
            out[i] = ("failed", "", 0)
            continue
        if top < threshold:
            bases.add(i)
            out[i] = ("new_base", "", top)
            continue
        best = min(own, key=lambda b: (-own[b][0], own[b][1], rank[b]))
        status, _ = decided(size, results.get((i, best)), min_ratio, force)
        if status != "deduped":
            bases.add(i)
        out[i] = (status, best, top)
    return out


@pytest.mark.parametrize("force", [False, True])
def test_scan_is_the_sequential_scan(spark, force):
    rng = np.random.default_rng(11)
    items = [(f"f{i:02}", i, 1000, bool(i % 17 == 3)) for i in range(60)]
    votes, results = {}, {}
    for t in range(60):
        for b in range(t):
            if t % 17 != 3 and b % 17 != 3 and rng.random() < 0.12:
                votes[f"f{t:02}", f"f{b:02}"] = (int(rng.integers(1, 5)), int(rng.integers(1, 4)))
                if rng.random() < 0.9:
                    results[f"f{t:02}", f"f{b:02}"] = (bool(rng.random() < 0.8), int(rng.choice([500, 960, 2000])))
    got = greedy.scan(
        spark.createDataFrame(items, "image_id string, rank long, size long, failed boolean"),
        spark.createDataFrame([(*k, *v) for k, v in votes.items()], "target_id string, base_id string, votes long, first_pos int"),
        spark.createDataFrame([(*k, *v) for k, v in results.items()], "target_id string, base_id string, success boolean, compressed_size long"),
        force=force,
    ).collect()
    assert {r.image_id: (r.status, r.base, r.votes) for r in got} == sequential(items, votes, results, force=force)


def test_a_chain_of_waves_asks_for_one_pair_an_item(spark):
    """Every item depends on the one before: as many waves as items, more than a pile keeps apart."""
    n, asked = 12, []
    items = [(f"f{i:02}", i, 1000, False) for i in range(n)]
    votes = {(f"f{t:02}", f"f{b:02}"): (9 if b == t - 1 else 3, 1) for t in range(n) for b in (t - 1, t - 2) if b >= 0}
    results = {pair: (True, 500) for pair in votes}
    table = spark.createDataFrame([(*k, *v) for k, v in results.items()], "target_id string, base_id string, success boolean, compressed_size long")

    def result_of(pairs):
        asked.extend((r.target_id, r.base_id) for r in pairs.collect())
        return table

    got = greedy.scan(
        spark.createDataFrame(items, "image_id string, rank long, size long, failed boolean"),
        spark.createDataFrame([(*k, *v) for k, v in votes.items()], "target_id string, base_id string, votes long, first_pos int"),
        result_of,
    ).collect()
    assert {r.image_id: (r.status, r.base, r.votes) for r in got} == sequential(items, votes, results)
    tried = [t for t, _ in asked]
    assert len(tried) == len(set(tried)) and set(asked) < set(votes)


@pytest.mark.parametrize("threshold", [2, 3])
def test_scan_by_sketches_is_the_sequential_scan(spark, threshold):
    rng = np.random.default_rng(threshold)
    made = []
    for i in range(150):  # single lines of many items, near and equal sketches, own lines
        if made and rng.random() < 0.4:
            own = [x for x in made[int(rng.integers(len(made)))] if rng.random() < rng.choice([0.8, 1.0])]
        else:
            own = [f"h{x}" for x in rng.choice(25, int(rng.integers(0, 6)), replace=False)]
        made.append(own + [f"own{i}"] * bool(rng.random() < 0.3))
    items = [(f"f{i:03}", i, 1000, bool(i % 17 == 3)) for i in range(len(made))]
    place = [{x: k for k, x in enumerate(own)} for own in made]
    votes, results = {}, {}
    for t in range(len(made)):
        for b in range(t):
            both = set(place[t]) & set(place[b])
            if both and t % 17 != 3 and b % 17 != 3:
                votes[f"f{t:03}", f"f{b:03}"] = (len(both), min(place[t][x] for x in both))
                if rng.random() < 0.9:
                    results[f"f{t:03}", f"f{b:03}"] = (bool(rng.random() < 0.8), int(rng.choice([500, 960, 2000])))
    table = spark.createDataFrame([(*k, *v) for k, v in results.items()], "target_id string, base_id string, success boolean, compressed_size long")
    got = sketch_scan.scan(
        spark.createDataFrame(items, "image_id string, rank long, size long, failed boolean"),
        spark.createDataFrame([(f"f{i:03}", own) for i, own in enumerate(made)], "image_id string, sketch array<string>"),
        lambda pairs: pairs.join(table, ["target_id", "base_id"]),
        threshold,
    ).collect()
    assert {r.image_id: (r.status, r.base, r.votes) for r in got} == sequential(items, votes, results, threshold)


def test_the_documents_scan_asks_for_few_pairs_an_item(spark, tmp_path, monkeypatch):
    """Documents that all share two lines are no pair each with each."""
    n, asked = 120, []
    rows = [(i, f"first line of all\nsecond line of all\nown {i}") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = documents.line_deltas
    monkeypatch.setattr(documents, "line_deltas", lambda pairs, docs: (asked.append(pairs.count()), whole(pairs, docs))[1])
    got = {r.image_id: (r.status, r.base, r.votes) for r in scan_queries.scanned_documents(spark, str(tmp_path)).collect()}
    assert got == {str(i): ("kept_original", "0", 2) if i else ("new_base", "", 0) for i in range(n)}
    assert sum(asked) <= 2 * n


def test_a_round_of_the_scan_by_sketches_writes_few_tables(spark, monkeypatch):
    """Rounds are many short jobs: their number is most of the time of a scan."""
    made, whole = [], sketch_scan.written
    monkeypatch.setattr(sketch_scan, "written", lambda df, name: (made.append(name), whole(df, name))[1])
    n = 5  # each item shares two features with the one before
    items = spark.createDataFrame([(f"f{i}", i, 1000, False) for i in range(n)], "image_id string, rank long, size long, failed boolean")
    sketches = spark.createDataFrame([(f"f{i}", [f"h{2 * i + k}" for k in range(4)]) for i in range(n)], "image_id string, sketch array<string>")
    result = [F.lit(True).alias("success"), F.lit(500).cast("long").alias("compressed_size")]
    got = sketch_scan.scan(items, sketches, lambda pairs: pairs.select("target_id", "base_id", *result)).collect()
    assert {r.image_id: r.base for r in got} == {"f0": "", "f1": "f0", "f2": "", "f3": "f2", "f4": ""}
    ends = [i for i, name in enumerate(made) if name == "choices"]
    assert len(ends) > 2 and all(j - i <= 5 for i, j in zip(ends, ends[1:]))


@pytest.mark.parametrize(("query", "rows"), [("running_scan_stats", 30), ("scan_manifest", 15)])
def test_the_documents_scan_reads_texts_once(spark, monkeypatch, query, rows):
    seen = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame([(i, "\n".join(f"line {k} of the two documents {i // 2}" for k in range(9))) for i in range(30)], "doc_id long, text string")

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    monkeypatch.setattr(scan_queries, "load", lambda *_: table.withColumn("text", read("text")))
    assert queries.QUERIES[query](spark, "").count() == rows
    assert seen.value == 30


def test_decisions(spark):
    rows = [(100, None, None), (100, True, 50), (105, True, 100), (100, False, 0), (100, True, 200), (100, True, 0), (100, True, 100)]
    df = spark.createDataFrame(rows, "o long, s boolean, c long")
    for force in (False, True):
        got = [(r.status, r.reason) for r in df.select(*[c.alias(k) for k, c in greedy.outcome(F.col("o"), F.col("s"), F.col("c"), 1.05, force).items()]).collect()]
        assert got == [decided(o, None if s is None else (s, c), 1.05, force) for o, s, c in rows]


@pytest.fixture
def folder(tmp_path):
    """Two bases, a near copy of each, an equal copy, a file that is no JPEG and one with halved colours."""
    root = tmp_path / "set"
    (root / "sub").mkdir(parents=True)
    a, b = image(128, 128, [(1, 1)] * 3, seed=1), image(128, 128, [(1, 1)] * 3, seed=2)
    (root / "1_base.jpg").write_bytes(baseline(a))
    (root / "2_base.jpg").write_bytes(baseline(b))
    a.components[0].blocks[9, 9, 3] += 5
    b.components[1].blocks[3, 4, 0] += 9
    (root / "1_target.jpg").write_bytes(baseline(a))
    (root / "sub" / "2_target.JPEG").write_bytes(baseline(b))
    (root / "sub" / "3 é.jpg").write_bytes((root / "1_base.jpg").read_bytes())
    (root / "bad.jpg").write_bytes(b"no picture")
    (root / "notes.txt").write_bytes(b"text")
    return root


def test_folder_scan_archive_and_restore(spark, folder, tmp_path):
    scanned, files, results = images.scan(spark, str(folder))
    got = {r.image_id: (r.status, r.base) for r in scanned.collect()}
    assert got == {"1_base.jpg": ("new_base", ""), "1_target.jpg": ("deduped", "1_base.jpg"), "2_base.jpg": ("new_base", ""), "bad.jpg": ("failed", ""), "sub/2_target.JPEG": ("deduped", "2_base.jpg"), "sub/3 é.jpg": ("deduped", "1_base.jpg")}
    assert images.detailed(scanned, results).filter("status = 'deduped'").first()["block_similarity"].startswith("Exact ")
    path = images.write_archive(scanned, files, results, str(tmp_path / ("x" + archive.SUFFIX)))
    rows = images.restored(spark, path)
    assert {(r.target, r.status, r.sha256 == r.expected_sha256) for r in rows.collect()} == {("1_target.jpg", "restored", True), ("sub/2_target.JPEG", "restored", True), ("sub/3 é.jpg", "restored", True)}
    out = tmp_path / "back"
    assert images.write_restored(rows, str(out)) == 3
    assert (out / "sub" / "2_target.JPEG").read_bytes() == (folder / "sub" / "2_target.JPEG").read_bytes()
    last = greedy.running_stats(scanned).orderBy(F.desc("rank")).first()
    assert (last.processed_images, last.base_images, last.deduped_images, last.failed_images) == (6, 2, 3, 1)


def test_decoded_blocks(spark, folder):
    rows = jpeg.decode(jpeg.scan_files(spark, str(folder))).filter("image_id like '%1_base.jpg' or error is not null")
    assert rows.filter("error is null").count() == 3 * 256 and rows.filter("error is not null").count() == 1
    comps = rows.filter("error is null").select("image_id", "comp", "h_samp", "v_samp").distinct()
    whole = delta.gathered(rows.filter("error is null"), comps)
    assert whole.count() == 256 and len(whole.first()["comps"]) == 3


def test_stream_gives_the_statuses_of_the_batch_scan(spark, folder, tmp_path):
    from blockweave.sources import engine

    files = images.relative_files(spark, str(folder))
    state = stream.IncrementalScan(spark, str(tmp_path / "state"), lambda f: images.features(f), lambda pairs, known: images.pair_results(pairs, known, engine.CompressOptions()).select("target_id", "base_id", "success", "compressed_size"))
    state(files.filter("rank < 3"), 0)
    state(files.filter("rank >= 3"), 1)
    state(files.filter("rank >= 3"), 1)  # again, as after a failure
    assert {r.image_id: r.status for r in state.statuses().collect()} == {r.image_id: r.status for r in images.scan(spark, str(folder))[0].collect()}


def test_stream_over_files(spark, folder, tmp_path):
    from blockweave.sources import engine

    images.relative_files(spark, str(folder)).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("image_id string, rank long, size long, content binary").parquet(str(tmp_path / "in"))
    state = stream.IncrementalScan(spark, str(tmp_path / "state"), lambda f: images.features(f), lambda pairs, known: images.pair_results(pairs, known, engine.CompressOptions()).select("target_id", "base_id", "success", "compressed_size"))
    monitor = stream.GrowthMonitor()
    spark.streams.addListener(monitor)
    state.start(source, str(tmp_path / "check")).awaitTermination(300)
    spark.streams.removeListener(monitor)
    assert state.statuses().filter("status = 'deduped'").count() == 3


def test_commands(spark, folder, tmp_path, capsys):
    p = lambda name: str(folder / name)
    out = lambda name: str(tmp_path / name)
    assert cli.main(["dump-y", p("1_base.jpg"), out("y.txt")]) == 0
    assert cli.main(["repack-same", p("1_base.jpg"), out("same.jpg")]) == 0
    assert cli.main(["repack-y", p("1_base.jpg"), out("y.txt"), out("again.jpg")]) == 0
    assert (tmp_path / "same.jpg").read_bytes() == (tmp_path / "again.jpg").read_bytes() == (folder / "1_base.jpg").read_bytes()
    assert cli.main(["signature", p("1_base.jpg")]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "0 2 16 16 10"
    assert cli.main(["best-base", p("1_target.jpg"), "--candidates", p("1_base.jpg"), p("2_base.jpg")]) == 0
    assert capsys.readouterr().out.startswith(p("1_base.jpg"))
    assert cli.main(["pack", p("1_target.jpg"), p("1_base.jpg"), out("d"), "--hint", "1", "1", "1", "1", "--strict"]) == 0
    assert "FPM" in capsys.readouterr().out
    assert cli.main(["unpack", out("d"), p("1_base.jpg"), out("t.jpg"), "--target", p("1_target.jpg")]) == 0
    assert cli.main(["unpack", out("d"), p("1_base.jpg"), out("t.jpg"), "--target", p("2_base.jpg")]) == 2
    assert cli.main(["pair-benchmark", p("1_target.jpg"), p("1_base.jpg")]) == 0
    log = spark.createDataFrame([(1, capsys.readouterr().out)], "log_id long, text string")
    row = logs.parsed(log).first()
    assert row.restore_bytewise == "passed" and row.original_size_bytes == (folder / "1_target.jpg").stat().st_size and row.reference_hash_fnv1a64 == row.restored_hash_fnv1a64
    assert cli.main(["benchmark", str(folder), out("bench")]) == 0
    assert spark.read.option("header", True).csv(out("bench")).first()["pairs"] == "1"
    assert cli.main(["scan", str(tmp_path / "nothing")]) == 2
    assert cli.main(["compress", p("1_target.jpg"), p("2_base.jpg"), out("w")]) == 0
    assert api.decompress_image(out("w"), p("2_base.jpg"), out("w.jpg")) and not api.decompress_image(p("bad.jpg"), p("2_base.jpg"), out("w.jpg"))
    assert len(set(api.extract_features(p("1_base.jpg"))) & set(api.extract_features(p("2_base.jpg")))) == 0
    with pytest.raises(jpeg.JpegError):
        api.extract_features(p("bad.jpg"))


def test_luma_text_errors(spark):
    bad = spark.createDataFrame([("a", "0 1 5"), ("b", "1 1 " + "1 " * 63), ("c", "1 1 " + "70000 " * 64), ("d", ""), ("e", "1 1 " + "5 " * 70)], "image_id string, text string")
    got = {r.image_id: r.error for r in text.parse_luma_text(bad).collect()}
    assert got["e"] is None and all(got[k] for k in "abcd")


def test_luma_replace(spark):
    blocks = spark.createDataFrame([("a", 0, True, 0, 0, [1]), ("a", 1, False, 0, 0, [2]), ("b", 0, True, 0, 0, [3])], "image_id string, comp int, is_luma boolean, row int, col int, coeff array<smallint>")
    new = spark.createDataFrame([("a", 0, 0, [9]), ("b", 0, 0, [9]), ("b", 0, 1, [9])], "image_id string, row int, col int, coeff array<smallint>")
    assert {(r.image_id, r.comp): r.coeff for r in text.replace_luma(blocks, new).collect()} == {("a", 0): [9], ("a", 1): [2], ("b", 0): [3]}


def test_fnv_and_pixels(spark):
    row = verify.fnv1a64(spark.createDataFrame([(bytearray(b"abc"),)], "content binary")).first()
    assert row.fnv == u64.signed(cli._fnv(b"abc"))
    grey, colour = baseline(image(24, 16, [(1, 1)])), baseline(image(24, 16, [(2, 2), (1, 1), (1, 1)]))
    assert jpeg.pixels(grey).shape == jpeg.pixels(colour).shape == (16, 24, 3)
    assert verify.pixel_mse(grey, grey) == 0 and verify.pixel_mse(grey, colour) > 0 and verify.pixel_mse(grey, baseline(image(16, 16, [(1, 1)]))) == float("inf")
    flat = jpeg.Image(8, 8, [jpeg.Component(1, 1, 1, 0, 1, 1, np.array([[[80] + [0] * 63]], np.int16))])
    assert (jpeg.pixels(jpeg.encode(flat, {0: np.full(64, 4, np.int64)})) == 128 + 80 * 4 // 8).all()
    df = spark.createDataFrame([(bytearray(grey), bytearray(grey)), (bytearray(grey), None), (bytearray(b"x"), bytearray(grey))], "a binary, b binary")
    assert [r.mse for r in verify.with_pixel_mse(df, "a", "b").collect()] == [0.0, None, None] or str([r.mse for r in verify.with_pixel_mse(df, "a", "b").collect()]) == "[0.0, nan, nan]"


def test_lookups(spark):
    entries = spark.createDataFrame([("t", "deltas/t.1.ddct", "bases/b"), ("u", "deltas/u.2.ddct", "bases/gone"), ("a", "deltas/x/t.1.ddct", "bases/b")], "target string, ddct_file string, base_file string")
    contents = spark.createDataFrame([("deltas/t.1.ddct", bytearray(b"1")), ("bases/b", bytearray(b"2"))], "name string, content binary")
    got = {r.target: (r.delta is not None, r.base is not None) for r in verify.lookups(entries, contents).collect()}
    assert got == {"t": (True, True), "u": (False, False), "a": (False, True)}
    assert verify.preview_source(entries, spark.createDataFrame([("t.1.ddct",)], "name string")).first()["target"] == "a"


def test_display_rows(spark):
    rows = spark.createDataFrame([("1", None, "a", 1), ("x", 2.5, "a", 3)], "n string, v double, output_ddct string, rank long")
    assert [(r.n, r.v) for r in verify.sanitised(rows, ["n"]).collect()] == [(1, 0.0), (0, 2.5)]
    assert verify.last_log(rows).first()["rank"] == 3


def test_events(spark, folder, tmp_path):
    scanned, _, _ = images.scan(spark, str(folder))
    seen = list(images.events(scanned, "x"))
    assert [e["event"] for e in seen] == ["start", *["progress"] * 6, "done"] and seen[-2]["processed_images"] == 6


def test_metric_sinks(spark, tmp_path):
    row = logs.parsed(spark.createDataFrame([(1, "Original Size (bytes): 10")], "log_id long, text string"))
    for _ in range(2):
        logs.append_csv(row, str(tmp_path / "csv"))
        logs.write_json(row, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.json(str(tmp_path / "json")).first()["original_size_bytes"] == 10


@pytest.mark.parametrize(("kind", "route"), [("watermark_Light", "any"), ("shift", "DCHash"), ("quality", None), ("stress_Light", "any")])
def test_made_up_pairs(kind, route, tmp_path):
    from blockweave.sources import datasets, engine

    files = dict(datasets.pairs(kind, 1, side=128))
    assert files == dict(datasets.pairs(kind, 1, side=128)) and datasets.write(str(tmp_path / "d"), kind, 1, side=64) == len(files)
    (base,) = [x for n, x in files.items() if "_base" in n]
    for name, target in files.items():
        if "_target" in name:
            result, data = engine.compress(target, base, "b")
            if route is None:
                assert result.compression_ratio < 1.2
            else:
                assert result.success and result.compression_ratio > 1.2 and engine.restore(data, base) == target
                assert route == "any" or result.route == route


def test_empty_archive(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert archive.write_archive(str(tmp_path / "x"), {}, [], []) is None
    assert archive.entry({"required_base": "b"})[1] == "b"
    assert archive.output_root("/proc/none/x", "set").endswith("set_Output")


def test_rollup_of_failures(spark):
    rows = [("a", "b1", 100, 50, None, 0, 80, 1.0), ("a", "b1", 100, 50, 20, 100, 80, 1.0)]
    r = rollup.rollup(spark.createDataFrame(rows, "dataset string, base_id string, target_size long, base_size long, delta_size long, md5_size long, zlib_size long, seconds double")).first()
    assert (r.delta_size, r.base_pack_size, r.archive_size, r.delta_ratio, r.md5_ratio, r.avg_ms) == (120, 50, 170, 200 / 120, 2.0, 1000.0)
