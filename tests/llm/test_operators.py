"""The operators against brute force, exact round trips and held-out labels, on small fixtures with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from blockweave.llm import bpe, embedding_dedup, exact_dedup, license_scan, minhash, mixing, queries, secret_scan, substring_dedup, textkit, token_counts, toxicity
from blockweave.llm.common import table

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text_of(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def edited(text, every, seed=0):
    r = random.Random(seed)
    return " ".join(w if r.randrange(every) else f"x{r.randint(0, 999)}" for w in text.split())


def odd_documents():
    """(doc_id, text, lang, source, u, label): nulls, blanks, short, long, equal and near texts, columns of clashing names."""
    base, long = text_of(1, 120), text_of(2, 20_000)
    texts = [None, "", "   ", "one", "One", "two words", "two\t words", base, base.upper(), base + "  ", edited(base, 60), edited(base, 12), edited(base, 4), long, edited(long, 50, 3), None, "é ñ 漢字 \U0001f600", "a\x0bb\x0cc"]
    texts += [edited(base, 25, s) for s in range(30)] + [text_of(100 + s, 40) for s in range(20)]
    return [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, i, "label") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, u int, label string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def grouped(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_near(rows, k, percent):
    sets = {i: shingles_of(t, k) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, grouped(ids, links)


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_are_those_of_all_pairs(odd, k):
    sets, comp = brute_near(odd_documents(), k, 80)
    got = minhash.near_groups(odd, minhash.Banding(words=k)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_hot_group_near_the_threshold(spark):
    """A large group whose pairs lie on both sides of the threshold: hubs, random hubs and tiles all have work."""
    base = text_of(9, 150)
    rows = [(i, edited(base, random.Random(i).choice([8, 12, 18, 40]), i)) for i in range(400)]
    sets, comp = brute_near(rows, 2, 80)
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Banding(words=2)).collect()
    assert {r.doc_id: r.component_id for r in got} == comp
    assert len(set(comp.values())) > 5


def test_near_groups_of_repeated_null_and_no_rows(spark, empty):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b  c d")]
    got = sorted(map(tuple, minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Banding(words=2)).collect()), key=repr)
    assert [g[:2] for g in got if g[0]] == [(1, 3), (1, 3), (2, 3)] and {g[2] for g in got if g[0]} == {1}
    assert minhash.near_groups(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9):
        b = np.concatenate([a[: int(400 * share)], rng.integers(0, 2**63, 400 - int(400 * share), dtype=np.uint64)])
        sig = minhash.superminhash(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 400, 800]), 128)
        j = share * 400 / (800 - share * 400)
        assert abs((sig[0] == sig[1]).mean() - j) < 0.15
    one = minhash.superminhash(np.array([5], np.uint64), np.array([0, 1, 1]), 100)
    assert (one[0] >> np.uint64(48)).tolist() != [0] * 100 and len(set((one[0] >> np.uint64(48)).tolist())) == 100  # a walk visits each slot once
    assert (one[1] == ~np.uint64(0)).all()


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = [t for _, t, *_ in odd_documents()]
    for most in (64, 1 << 19):
        data, off = textkit.bytes_of(pa.array(texts))
        seen = {}
        for a, b in textkit.chunks(off, most):
            h, s, e, first = textkit.words(data[off[a] : off[b]], off[a : b + 1] - off[a])
            part = bytes(data[off[a] : off[b]])
            for r in range(a, b):
                own = [part[s[i] : e[i]] for i in range(first[r - a], first[r - a + 1])]
                assert own == re.findall(rb"[^\x20\x09-\x0d]+", (texts[r] or "").encode())
                for w, x in zip(own, h[first[r - a] : first[r - a + 1]].tolist(), strict=True):
                    assert seen.setdefault(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w), x) == x
        assert len(set(seen.values())) == len(seen)


# ---- exact dedup

def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def test_exact_groups(spark, odd, empty):
    rows = [(i, t) for i, t, *_ in odd_documents()]
    first, size = {}, {}
    for i, t in rows:
        first[norm(t)] = min(first.get(norm(t), i), i)
        size[norm(t)] = size.get(norm(t), 0) + 1
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(odd).collect()}
    assert got == {i: (first[norm(t)], size[norm(t)], first[norm(t)] == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0
    again = odd.union(odd)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(again).collect()) == sorted(first.values())
    lost = spark.createDataFrame([(None, "q"), (4, "q"), (None, "only")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(lost).collect()), key=repr) == [(4, "q"), (None, "only")]
    ties = spark.createDataFrame([(None, "q"), (None, " q".strip()), (3, "a  b"), (3, "a  b"), (2, "c"), (1, "c")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(ties).collect()), key=repr) == [(1, "c"), (3, "a  b"), (None, "q")]
    assert [r.kept for r in exact_dedup.exact_groups(ties).filter("doc_id is null or doc_id = 3").collect()] == [True] * 4
    assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(lost).collect()])) == sorted(map(repr, [(None, 4, 2, False), (4, 4, 2, True), (None, None, 1, True)]))


def test_counting_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    total, merged = {}, None
    for n in (0, 1, 7, 500, 3000):
        v = np.unique(rng.integers(0, 2**20, n, dtype=np.uint64))
        c = rng.integers(1, 600, len(v))
        q = exact_dedup.slots_for(len(v))
        f = exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.build(v, c, 24 - q, q).to_bytes())
        for a, b in zip(v.tolist(), c.tolist(), strict=True):
            total[a] = total.get(a, 0) + b
        merged = f if merged is None else merged.merged(f)
    values, counts = merged.items()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == total
    assert all(merged.get(v) == n for v, n in list(total.items())[:200])
    assert all(merged.get(v) == 0 for v in range(2**20, 2**20 + 50))


# ---- embeddings

def test_embedding_groups_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 16))
    x = np.concatenate([x, x[:40] + rng.normal(size=(40, 16)) * 0.2, x[:30] * 3, np.tile(x[5], (20, 1)), np.zeros((1, 16))]).astype(np.float32)
    rows = [(i * 2, v.tolist(), i % 3) for i, v in enumerate(x)] + [(901, None, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (906, [], 0), (907, [3e38] * 16, 0), (908, [1e38] * 16, 0), (909, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links = []
    for a, (i, u, _) in enumerate(rows):
        for j, v, _ in rows[a + 1 :]:
            if u and v and None not in u and None not in v and len(u) == len(v) and np.isfinite(u).all() and np.isfinite(v).all() and any(u) and any(v):
                p, q = np.array(u, np.float64), np.array(v, np.float64)
                if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= 0.95:
                    links.append((i, j))
    comp = grouped([r[0] for r in rows], links)
    n = {i: sum(i in e for e in links) for i in comp}
    for tile in (2048, 30):
        embedding_dedup.TILE, before = tile, embedding_dedup.TILE
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(df).collect()}
        embedding_dedup.TILE = before
        assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert embedding_dedup.embedding_groups(df.filter("false")).count() == 0


def test_vectors_without_an_id_are_linked_like_others(spark):
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [-1.0, 0.0]), (7, [1.0, 0.02]), (None, None)]
    got = [tuple(r) for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component_id", F.lit("x"))).collect()]
    assert sorted(got, key=repr) == sorted([(None, 2, 5, False), (5, 2, 5, True), (7, 2, 5, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (None, 0, None, True)], key=repr)


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(2)
    for scale in (1, 30):
        a = rng.normal(size=(60, 32)) * np.exp(rng.normal(size=(60, 32)) * np.log(scale))
        a /= np.sqrt((a * a).sum(axis=1))[:, None]
        for least in (-0.2, 0.0, 0.3):
            i, j = embedding_dedup.possible(a, a, least)
            found = set(zip(i.tolist(), j.tolist(), strict=True))
            assert {(p, q) for p, q in np.argwhere(a @ a.T >= least).tolist()} <= found


# ---- byte BPE and token files

@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as p
    import tiktoken

    with open(bpe.default_vocabulary()[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_are_those_of_the_library(spark, odd, reference):
    odd_texts = [(1000 + i, t) for i, t in enumerate(["<|endoftext|> 's 'S we'll", "  x\r\n\r\n  y ", "a" * 5000, "1234567890" * 30, "ＦＵＬＬ Ⅷ ½ ٣", "́́e", "़ा हिन्दी ภาษาไทย"])]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(odd_texts, "doc_id long, text string"))
    rows = bpe.encode(docs, *bpe.default_vocabulary(), decoded=True).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.bytes) == (r.text or "").encode()
    out = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs, *bpe.default_vocabulary()), *bpe.default_vocabulary())).collect()}
    for r in rows:
        d = out[r.doc_id]
        assert d.n_tokens == len(r.ids) and d.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and d.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_encode_carries_other_columns(odd, empty):
    out = bpe.encode(odd, *bpe.default_vocabulary())
    assert out.columns == ["doc_id", "lang", "source", "u", "label", "ids"] and out.count() == odd.count()
    assert bpe.digests(bpe.encode(empty, *bpe.default_vocabulary(), decoded=True)).count() == 0


def test_minimal_perfect_hash():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.MinimalPerfectHash(keys)
    slots = [h.slot(k) for k in keys]
    assert sorted(slots) == list(range(3000)) and slots == h.slot_of.tolist()


def test_token_counts_of_files(odd, empty, reference):
    path, pattern = bpe.default_vocabulary()
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd, path, pattern, queries.SEPARATOR).collect()}
    assert got == {i: len(reference.encode_ordinary(t or "")) for i, t, *_ in odd_documents()}
    assert token_counts.token_counts(empty, path, pattern, queries.SEPARATOR).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for f in range(4):
        lengths = rng.integers(0, 20, 30).tolist()
        ids = [x for n in lengths for x in [*rng.integers(0, 9, n).tolist(), 9]]
        if f == 1:
            ids += [1, 2, 3]  # a document without its end
            lengths.append(3)
        if f == 2:
            ids, lengths = [], []
        (tmp_path / f"f{f}").write_bytes(np.array(ids, "<u2").tobytes())
        want |= {(f"f{f}", i): n for i, n in enumerate(lengths)}
    token_counts.GROUP, before = 4, token_counts.GROUP
    got = {(r.file, r.ordinal): r.n_tokens for r in token_counts.scan_token_files(spark, f"file://{tmp_path}", 9, block=block).collect()}
    token_counts.GROUP = before
    assert got == want


def test_texts_that_are_no_utf8(spark, reference):
    docs = spark.range(1).selectExpr("1L as doc_id", "cast(unhex('61FF62C320') as string) as text")
    text = b"a\xffb\xc3 ".decode("utf-8", "replace")
    (r,) = bpe.encode(docs, *bpe.default_vocabulary(), decoded=True).collect()
    assert r.ids == reference.encode_ordinary(text) and bytes(r.bytes) == text.encode()
    path, pattern = bpe.default_vocabulary()
    assert [x.n_tokens for x in token_counts.token_counts(docs, path, pattern, queries.SEPARATOR).collect()] == [len(r.ids)]
    for f in (minhash.near_groups, exact_dedup.exact_groups, license_scan.license_findings, secret_scan.secrets, substring_dedup.shared_passages, mixing.mixed):
        f(docs.withColumn("source", F.lit(None).cast("string"))).collect()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none).count() == 1


def test_ids_that_no_file_can_hold_are_refused(spark, odd):
    path, pattern = bpe.default_vocabulary()
    for separator, width in ((70000, 2), (3, 2), (queries.SEPARATOR, 1), (-1, 2)):
        with pytest.raises(ValueError):
            token_counts.write_token_files(odd, "file:///nowhere", path, pattern, separator, width)


# ---- licenses and secrets

def test_license_spans(spark, odd, empty):
    mit = license_scan.TEMPLATES["MIT permission"]
    words = mit.split()
    rows = [(1, "x " * 90 + mit.upper() + " y" * 50), (2, text_of(3, 900) + "\nReleased under the MIT License.\n" + text_of(4, 10)), (3, " ".join(w if i % 40 else "changed" for i, w in enumerate(words))), (4, " ".join(words[: len(words) // 2])), (5, "Licensed*** under*** the*** Apache*** License,*** Version*** 2.0***"), (6, None), (7, ""), (8, "under the MIT"), (9, "Released under the MIT License. " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.license_findings(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT permission"), (2, "MIT notice"), (3, "MIT permission"), (5, "Apache-2.0 notice"), (9, "MIT notice")}
    text = dict(rows)
    for r in got:
        if r.doc_id == 2:
            assert text[2].encode()[r.start : r.end] == b"Released under the MIT License"
        if r.doc_id == 1:
            assert text[1].encode()[r.start : r.end].decode() == mit.upper().rstrip(".") and r.containment == 1.0
    assert license_scan.license_findings(odd).count() == 0 and license_scan.license_findings(empty).count() == 0


def bare(text):
    """Words as the scan defines them, by plain string handling."""
    out = []
    for w in re.split(r"[\x20\x09-\x0d]+", text):
        w = re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+", "", w)
        w = re.sub(r"[^0-9A-Za-z\x80-\U0010ffff]+$", "", w)
        if w:
            out.append(re.sub("[A-Z]", lambda m: m[0].lower(), w))
    return out


def brute_licenses(text, templates):
    """Templates of which some stretch as long as the template holds the share of distinct shingles."""
    words, found = bare(text), set()
    for name, t in templates.items():
        tw = bare(t)
        k = min(5, len(tw))
        want = {tuple(tw[i : i + k]) for i in range(len(tw) - k + 1)}
        own = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        n = len(tw) - k + 1
        if any(len(want.intersection(own[i : i + n])) >= license_scan.CONTAINED * len(want) for i in range(max(1, len(own) - n + 1))):
            found.add(name)
    return found


def test_license_scan_misses_nothing_that_brute_force_finds():
    """Templates at every offset, a few words changed; what is found besides must hold the shingles in a window."""
    templates = license_scan.Templates(license_scan.TEMPLATES)
    r = random.Random(5)
    hits = 0
    for text in license_scan.TEMPLATES.values():
        for _ in range(6):
            words = [w if r.random() > 0.02 else "other" for w in text.split()]
            full = text_of(r.randrange(10**6), r.randrange(60)) + " " + " ".join(words) + " " + text_of(r.randrange(10**6), 30)
            data = np.frombuffer(full.encode(), np.uint8)
            got = {x[1] for x in templates.findings(data, np.array([0, len(data)]))}
            want = brute_licenses(full, license_scan.TEMPLATES)
            assert want <= got
            hits += len(want)
    assert hits > 60


def test_license_bands_retrieve_as_often_as_they_should():
    """Of windows that hold four fifths of a template, all but few in 20,000 share a band (there is no other way to a template)."""
    r, missed, tried = random.Random(8), 0, 0
    for name, text in license_scan.TEMPLATES.items():
        one = license_scan.Templates({name: text})
        words = text.split()
        for _ in range(60):
            cut = r.randrange(len(words))
            own = [w if len(words) < 12 or abs(i - cut) > 0.02 * len(words) else "other" for i, w in enumerate(words)]
            full = text_of(r.randrange(10**6), r.randrange(200)) + " " + " ".join(own) + " " + text_of(r.randrange(10**6), 200)
            if name in brute_licenses(full, {name: text}):
                data = np.frombuffer(full.encode(), np.uint8)
                tried += 1
                missed += not one.findings(data, np.array([0, len(data)]))
    assert tried > 600 and missed == 0


def test_license_scan_of_rows_together_and_apart(spark):
    """Rows of a chunk, short ones and empty ones among them, give what each gives alone; no templates, no findings."""
    r = random.Random(4)
    texts = ["", "one", text_of(1, 7)] + [text_of(i, r.randrange(90)) + " " + r.choice(list(license_scan.TEMPLATES.values())) + " " + text_of(i, r.randrange(9)) for i in range(30)]
    r.shuffle(texts)
    known = license_scan.Templates(license_scan.TEMPLATES)
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    got = known.findings(np.frombuffer(b"".join(raw), np.uint8), off)
    want = [(i, *x[1:]) for i, t in enumerate(raw) for x in known.findings(np.frombuffer(t, np.uint8), np.array([0, len(t)]))]
    assert sorted(got) == sorted(want) and len({x[0] for x in got}) == 30
    docs = spark.createDataFrame([(None, license_scan.TEMPLATES["MIT notice"], "x")], "doc_id long, text string, license string")
    assert license_scan.license_findings(docs).first()["license"] == "MIT notice"
    assert license_scan.license_findings(docs, {}).count() == 0


def test_secrets(spark, odd, empty):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'see token = "{key}" there'), (2, f"commit {key} of the branch"), (3, "call 4929123412341234 or 10.200.30.40 now"), (4, 'password = "your-password-123"'), (5, "AKIA" + "QWERTZUIOP234567 is it"), (6, None), (7, "mail to some.body12345@mail.example.com"), (8, f'api_key: "{key}" and api_key: "{key}"'), (9, "x" * 100_000 + f' secret = "{key}"')]
    got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.is_secret} == {1, 5, 8, 9}
    assert {r.doc_id for r in got} >= {1, 2, 3, 4, 5, 7, 8, 9} and len([r for r in got if r.doc_id == 8]) == 1
    for r in got:
        assert dict(rows)[r.doc_id][r.start - 1 :].startswith(r.value)
    assert secret_scan.secrets(odd, path="source").filter("is_secret").count() == 0 and secret_scan.secrets(empty).count() == 0


def test_secrets_by_occurrence(spark):
    """Places and neighbours are those of the occurrence that looks most like a secret, whatever comes before."""
    key = "Zk3" + hashlib.sha1(b"q").hexdigest()[:33]
    rows = [
        (1, 'password = "correcthorsebatterystaple"'),
        (2, f"an example, a sample: {key} is a placeholder of the test. " + "word " * 30 + f'aws_key = "{key}" and'),
        (3, 'see xyzAbCdEfGh12345678Zq then token = "AbCdEfGh12345678Zq" end'),
        (4, "API_KEY=9f8e7d6c5b4a39281706f5e4d3c2b1a0"),
        (5, 'password = "hunter2"'),
        (6, 'the password: required, the token is invalid'),
        (7, 'pwd="Tr0ub4dor&3x!"'),
        (8, "é漢 \U0001f600 " + f'secret: "{key}"'),
    ]
    got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit(1))).collect()
    text = dict(rows)
    by = {}
    for r in got:
        assert text[r.doc_id][r.start - 1 :].startswith(r.value)
        by.setdefault(r.doc_id, {})[r.value] = r
    assert {"correcthorsebatterystaple", "hunter2", "Tr0ub4dor&3x!"} <= {v for x in by.values() for v in x}
    assert by[2][key].start == text[2].index(f'"{key}') + 2 and by[2][key].is_secret
    assert by[3]["AbCdEfGh12345678Zq"].start == text[3].index('"AbCd') + 2
    assert set(by[4]) == {"9f8e7d6c5b4a39281706f5e4d3c2b1a0"}
    assert {i for i in by if any(r.is_secret for r in by[i].values())} >= {1, 2, 3, 4, 7, 8} and not any(r.is_secret for r in by.get(6, {}).values())


def test_secret_candidates_are_those_of_brute_force(spark):
    r = random.Random(7)
    bits = ["token = ", 'password="', '"', " ", "\n", "abc", "x1", "9", "==", ":", "a-b_c.d/", "Zq8" * 5, "0123456789abcdef", "key: ", "é", "user@mail.com", ","]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.choice([5, 40, 700])))) for i in range(60)]
    name, key = secret_scan.NAME, secret_scan.KEY
    sign = re.compile(rf"(?i:{name})[\"']?\s{{0,2}}(?::=|=>|[=:])\s{{0,2}}[\"'`]?")
    value, run = re.compile(r"[^\s\"'`,;]{6,}"), re.compile(rf"[A-Za-z_+/~.\-]*[0-9]{key}*=*")
    want = set()
    for i, t in rows:
        at = 0
        while at < len(t):
            named = any(sign.fullmatch(t, b, at) for b in range(max(0, at - 40), at))
            m = value.match(t, at) if named else None
            if not m and (not at or not re.match(key, t[at - 1])):
                m = run.match(t, at)
            if not m:
                at += 1
                continue
            raw = m[0]
            bare = re.sub(r"[.\-/~)>\]}]+$", "", raw)
            lead = len(re.match(r"[.\-/+~]*", bare)[0])
            bare = bare[lead:]
            if len(bare) >= 12 and re.search("[0-9]", bare) or named and len(bare) >= 6 and not lead:
                want.add((i, bare, m.start() + lead + 1))
            at = m.end()
    got = {(r.doc_id, r.value, r.start) for r in secret_scan.found_in(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x for x in want ^ got if len(x[1]) >= 12 and re.search("[0-9]", x[1])} == set() and len(want) > 100
    assert len(want ^ got) <= 0.02 * len(want)  # a name may lie further back than the neighbours that are kept


def test_secret_forest_on_held_out_findings(spark):
    language = secret_scan.Language(table(spark, "/root/testdata/sf0.01", "documents"))
    every = secret_scan.labelled_findings(spark, 3000).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(5)))
    model = secret_scan.forest(every.filter("part <> 0").drop("part"), language)
    from pyspark.ml.feature import VectorAssembler

    rows = model.transform(VectorAssembler(inputCols=secret_scan.NUMBERS, outputCol="features").transform(secret_scan.described(every.filter("part = 0"), language)))
    assert rows.filter("prediction = label").count() >= 0.97 * rows.count()


def test_secret_forest_on_findings_of_other_making(spark):
    """Findings written by hand after documentation of services and code, not by the rules that made the training rows."""
    h = lambda s, n: hashlib.sha512(s.encode()).hexdigest()[:n]
    secret = [
        ("config.py", f'STRIPE_API_KEY = "sk_live_{h("a", 24)}"'), ("", f"export GITHUB_TOKEN=ghp_{h('b', 36)}"), ("deploy.yml", f"  db_password: s3cr3t-{h('c', 10)}"), ("", f"curl -H 'Authorization: Bearer {h('d', 64)}'"),
        ("app.js", f"const apiKey = 'AIza{h('e', 35)}';"), ("notes.txt", f"my password: qX7{h('f', 9)}"), ("", f'{{"access_key": "AKIA{h("g", 16).upper()}", "n": 1}}'), (".env", f"SLACK_TOKEN=xoxb-{'1' * 3}{h('h', 9)}-{h('i', 24)}"), ("", f"secret={h('j', 32)}&x=1"), ("main.tf", f'  client_secret = "{h("k", 20)}Qz{h("l", 10)}"'),
    ]
    other = [
        ("", f"commit {h('m', 40)} fixes it"), ("", "released on 2024-03-11T10:22:31 as version-2024.03.11"), ("", "call 0049-170-123456789 or mail to john.smith1984@mail.example.com"), ("", f"sha256:{h('n', 64)}  file.tar.gz"), ("", "https://www.site.com/articles/2020/05/17/page12345.html"),
        ("", "invoice number 20240311-000123456"), ("", "from 192.168.100.200 to 10.200.130.140"), ("", "the key: chapter twelve, the password: forgotten"), ("tests/a.py", 'password = "example-password-1"'), ("", "ISBN 978-3-16-148410-0 and part no. AB-1234567890"), ("", f"request id {h('o', 8)}-{h('p', 4)}-{h('q', 4)}-{h('r', 4)}-{h('s', 12)} failed"),
    ]
    rows = [(i, p, t) for i, (p, t) in enumerate(secret + other)]
    got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, source string, text string"), path="source", labelled=None).filter("is_secret").select("doc_id").distinct().collect()
    flagged = {r.doc_id for r in got}
    right, wrong = len([i for i in flagged if i < len(secret)]), [rows[i] for i in flagged if i >= len(secret)]
    print("recall", right / len(secret), "precision", right / max(1, len(flagged)), wrong, [rows[i] for i in range(len(secret)) if i not in flagged])
    assert right >= 0.9 * len(secret) and len(wrong) <= 1


# ---- toxicity

def viterbi_by_hand(word, model):
    from itertools import product

    best = (-np.inf, "")
    for path in product(*toxicity.lattice(word)):
        plain = "".join(c for c, _ in path)
        best = max(best, (sum(c for _, c in path) + plain_score(plain, model), plain))
    return best[0]


def plain_score(plain, model):
    codes = [0, 0, *[ord(c) - 96 if "a" <= c <= "z" else 27 for c in plain], 0]
    return sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(toxicity.CLASSES), (toxicity.CLASSES, toxicity.CLASSES)))
    words = ["1d10t", "l-o-s-e-r", "m0r0nnnn", "$cum", "a.b", "éé1", "###", "x", "st*p!d"]
    for w, out in zip(words, toxicity.restored(words, model), strict=True):
        plain = plain_score(out, model)
        # the path's own cost, recovered as the best cost among paths that give this word
        from itertools import product

        cost = max(sum(c for _, c in p) for p in product(*toxicity.lattice(w)) if "".join(c for c, _ in p) == out)
        assert abs(plain + cost - viterbi_by_hand(w, model)) < 1e-9
    assert toxicity.restored([], model) == []


def test_disguised_words_are_scored_like_plain_ones(spark):
    r = random.Random(1)
    calm = ["house", "river", "table", "window", "garden", "stone", "letter", "music", "paper", "winter"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(calm) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[r.randrange(30)] = r.choice(["idiot", "loser"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    probe = [(1000, "river idiot stone"), (1001, "river 1d1ot stone"), (1002, "river i.d.i.o.t stone"), (1003, "river i d i o t stone"), (1004, "river looooser stone"), (1005, "river river stone"), (1006, None), (1007, "")]
    docs, known = spark.createDataFrame(rows + probe, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert [got[i].predicted for i in range(1000, 1008)] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert len(got) == len(rows) + len(probe) and all(0 <= x.score <= 1 for x in got.values())
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("clash")), known)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_mixed_disguises_are_scored_like_plain_words(spark):
    r = random.Random(1)
    calm = ["house", "river", "table", "window", "garden", "stone", "letter", "music", "paper", "winter", "such", "a"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(calm) for _ in range(30)]
        if i % 4 == 0:
            words[r.randrange(30)] = r.choice(["idiot", "loser", "ass"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    bad = ["such a l o s e r stone", "river I l o s e r", "river i d 1 0 t stone", "river i - d - i - o - t stone", "river iiddiioott stone", "river @$$ stone", "river l o s e r i d i o t stone"]
    good = ["river !!! stone", "such a river", "river - a - stone"]
    probe = [(1000 + i, x) for i, x in enumerate(bad + good)]
    docs, known = spark.createDataFrame(rows + probe, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, known).collect()}
    assert [got[i] for i, _ in probe] == [1] * len(bad) + [0] * len(good)


def test_long_words_are_decoded_in_pieces_like_whole_ones():
    rng, r = np.random.default_rng(3), random.Random(1)
    model = np.log(rng.dirichlet(np.ones(toxicity.CLASSES) * 0.3, (toxicity.CLASSES, toxicity.CLASSES)))
    for letters in ("abcdefghijklmnopqrstuvwxyz0134578@$!aaeeiioo", "01345678@$!"):
        for n in (toxicity.LONG + 1, 2500):
            word = "".join(r.choice(letters) for _ in range(n))
            whole = toxicity._viterbi([toxicity.Piece(toxicity.lattice(word))], n, model)
            assert toxicity.restored([word, "x1"], model)[:1] == whole and (len(toxicity.pieces(word)) > 1 or n < 1000)


def test_a_word_of_two_million_characters(spark):
    import base64

    blob = base64.b64encode(random.Random(2).randbytes(1_500_000)).decode()
    docs = spark.createDataFrame([(1, "river " + blob), (None, "x 1d1ot")], "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame([(2, 1)], "doc_id long, toxic int")).collect()
    assert {(r.doc_id, r.held_out) for r in got} == {(1, False), (None, False)}


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(odd, none).collect()} == {0}
    some = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, some).count() == odd.count()
    assert toxicity.toxicity(empty, none).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    true = sum(r.predicted and r.toxic for r in rows)
    assert true >= 0.9 * sum(r.toxic for r in rows) and true >= 0.95 * sum(r.predicted for r in rows)


# ---- substring dedup

def test_chains_are_the_best_ones():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pts = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (25, 2))})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        score = []
        for i in range(len(pts)):
            best = max((score[j] - substring_dedup.SKIP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]), default=0)
            score.append(substring_dedup.MATCH + max(0, best))
        x0, y0, x1, y1 = substring_dedup.chains(x, y)[0]
        ends = [i for i in range(len(pts)) if score[i] == max(score)]
        assert (x1, y1) in [pts[i] for i in ends] and x0 <= x1 and y0 <= y1


def test_matched_words():
    a = list(range(100))
    assert substring_dedup.matched_words(a, a) == 100
    assert substring_dedup.matched_words(a, [*a[:50], -1, -2, *a[50:]]) == 100
    assert substring_dedup.matched_words(a, [*a[:50], *a[55:]]) == 95
    assert substring_dedup.matched_words(a, [x if x % 10 else -x for x in a]) == 91
    assert substring_dedup.matched_words(a, [-x - 1 for x in a]) == 0


def test_shared_passages(spark, odd, empty):
    def fresh(seed, n):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(10**9)}" for _ in range(n))

    passage, fuzzy = fresh(1, 70), fresh(2, 300)
    rows = [(1, fresh(3, 200) + " " + passage + " " + fresh(4, 100)), (2, fresh(5, 50) + " " + passage.upper() + "\n" + fresh(6, 10)), (3, passage), (4, fresh(7, 500)), (5, fuzzy + " " + fresh(8, 40)), (6, fresh(9, 80) + " " + edited(fuzzy, 25, 1)), (7, fresh(4, 30)), (8, fresh(10, 200)), (9, fresh(10, 200)), (10, " ".join(passage.split()[:30]) + fresh(11, 60)), (11, None), (12, ""), (13, "a b")]
    rows += [(100 + i, fresh(1000 + i, 60) + " " + passage) for i in range(40)]
    rows += [(50, fresh(20, 30) + " was" * 9 + " " + fresh(21, 30)), (51, fresh(22, 30) + " was" * 70 + " " + fresh(23, 30)), (52, fresh(24, 10) + " was" * 64)]
    rows += [(60, fresh(30, 30) + " of the" * 4 + " " + fresh(31, 30)), (61, fresh(32, 30) + " of the" * 40 + " " + fresh(33, 30)), (62, fresh(34, 10) + " of the" * 300)]
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.other_id) for r in got}
    holders = {1, 2, 3, *range(100, 140)}
    assert pairs >= {(2, 1), (3, 1), (6, 5), (9, 8), (52, 51), (62, 61)} | {(100 + i, 1) for i in range(40)}
    assert all({a, b} <= holders or (a, b) in {(6, 5), (9, 8), (52, 51), (62, 61)} for a, b in pairs)  # seeds at a passage's edge may have a later hub
    by = {r.doc_id: r for r in sorted(got, key=lambda r: -r.other_id)}
    assert (by[2].start, by[2].end, by[2].other_start, by[2].other_end, by[2].identity) == (50, 120, 200, 270, 1.0)
    assert (by[9].start, by[9].end) == (0, 200) and by[6].end - by[6].start >= 290 and 0.9 < by[6].identity < 1
    assert substring_dedup.shared_passages(empty).count() == 0
    long = [r for r in got if r.doc_id == 62]  # 600 words, of which its hub holds 80 at most: rows that cover them all
    assert {x for r in long for x in range(r.start, r.end)} == set(range(10, 610)) and len(long) <= 13
    found = {r.doc_id for r in substring_dedup.shared_passages(odd).collect()}
    assert 25 in found and 28 in found  # the upper-case copy and the one with other white space


def test_exact_repeats_whose_seeds_begin_in_a_shorter_stretch(spark):
    def fresh(seed, n):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(10**9)}" for _ in range(n))

    line, passage = fresh(1, 15) + " ", fresh(2, 90).split()
    rows = [(1, fresh(3, 20) + " " + line * 2 + fresh(4, 20)), (2, fresh(5, 30) + " " + line * 10 + fresh(6, 25)), (3, fresh(7, 12) + " " + line * 10 + fresh(8, 40))]
    rows += [(10 + i, fresh(20 + i, 30) + " " + " ".join(passage[a : a + 40]) + " " + fresh(30 + i, 30)) for i, a in enumerate((0, 25, 50))]
    rows += [(14 + i, fresh(40 + i, 30) + " " + " ".join(passage) + " " + fresh(50 + i, 30)) for i in range(4)]
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(3, 2), (15, 14), (16, 14), (17, 14)}
    longest = {r.doc_id: r for r in sorted(got, key=lambda r: r.end - r.start)}
    for r in longest.values():
        assert (r.start, r.end, r.other_start, r.other_end, r.identity) == ((12, 162, 30, 180, 1.0) if r.doc_id == 3 else (30, 120, 30, 120, 1.0))


def test_fuzzy_passages_are_found(spark):
    r = random.Random(9)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(0, 240, 2):
        passage, every = fresh((66, 80, 100)[i // 2 % 3]), (6, 8, 10)[i // 6 % 3]
        if i % 4:  # words replaced
            other = [w if j % every else "x" + w for j, w in enumerate(passage)]
        else:  # words put in and left out
            other = [y for j, w in enumerate(passage) for y in (([w, "x" + w], [])[j // every % 2] if j % every == 0 else [w])]
        rows += [(i, " ".join(fresh(60) + passage + fresh(50))), (i + 1, " ".join(fresh(45) + other + fresh(70)))]
    got = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(i + 1, i) for i in range(0, 240, 2)} and len(got) >= 0.95 * 120


@pytest.mark.parametrize("period", [1, 2, 3, 5, 15, 40])
def test_stretches_of_any_period_are_found_whole(spark, period):
    r = random.Random(period)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line = fresh(period)
    turn = lambda n: (line * n)[:n]
    rows = [(1, fresh(10) + turn(60) + fresh(20)), (2, fresh(20) + turn(120) + fresh(20)), (3, fresh(35) + turn(120) + fresh(5)), (4, fresh(30) + line + fresh(30))]
    of = lambda rows: substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    got = of(rows)
    assert {(r.doc_id, r.other_id) for r in got} <= {(2, 1), (3, 1), (3, 2)} and {r.doc_id for r in got} == {2, 3}
    covered = {i: {x for r in got if r.doc_id == i for x in range(r.start, r.end)} for i in (2, 3)}
    assert covered[3] == set(range(35, 155)) and covered[2] >= set(range(20, 80))
    assert [(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end) for r in of(rows[1:])] == [(3, 2, 35, 155, 20, 140)]


def test_passages_within_a_document(spark):
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = fresh(80)
    rows = [(1, fresh(10) + passage + fresh(30) + passage + fresh(5)), (2, fresh(200)), (3, fresh(5) + ["so"] * 300)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert substring_dedup.shared_passages(docs).count() == 0
    got = [tuple(x) for x in substring_dedup.shared_passages(docs, within=True).collect()]
    assert [x for x in got if x[0] == 1] == [(1, 1, 120, 200, 10, 90, 80, 1.0)]
    assert {x[:2] for x in got} <= {(1, 1), (3, 3)} and all(x[5] <= x[2] for x in got)


def brute_repeats(texts, n):
    """Documents of which some run of ``n`` words stands in a document of a smaller id."""
    seen, out = {}, set()
    for i in sorted(texts):
        w = texts[i].lower().split()
        runs = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        if any(x in seen for x in runs):
            out.add(i)
        for x in runs:
            seen.setdefault(x, i)
    return out


def test_every_exact_repeat_of_real_documents_is_found(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_repeats({r.doc_id: r.text or "" for r in docs.collect()}, substring_dedup.LEAST_WORDS)
    got = {r.doc_id for r in substring_dedup.shared_passages(docs).select("doc_id").distinct().collect()}
    assert want and want <= got


@pytest.mark.parametrize("holders", [1, 20])
def test_near_passages_whose_seeds_begin_elsewhere(spark, holders):
    """Pieces of a passage stand in earlier documents, ``holders`` each; the two that hold it with differences are found."""
    r = random.Random(holders)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = fresh(120)
    other = [w if j % 30 != 29 else "x" + w for j, w in enumerate(passage)]
    pieces = [(a, a + 30) for a in range(0, 120, 15)]
    rows = [(i, fresh(30) + passage[a:b] + fresh(30)) for i, (a, b) in enumerate(pieces * holders)]
    rows += [(1000, fresh(20) + passage + fresh(30)), (1001, fresh(40) + other + fresh(20))]
    got = substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.other_id) for x in got] == [(1001, 1000)] and got[0].matched >= 110


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15])
def test_recall_of_edited_passages(spark, share):
    """Passages of 70 to 200 words with words replaced, put in or left out at random: one row each, nearly all found."""
    r = random.Random(int(share * 100))
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(0, 300, 2):
        passage, other = fresh(r.randrange(70, 200)), []
        for w in passage:
            kind = r.choice("ridk") if r.random() < share else "k"
            other += {"r": ["x" + w], "i": ["x" + w, w], "d": [], "k": [w]}[kind]
        both = substring_dedup.matched_words(passage, other)
        if both >= 50 and both >= 0.8 * max(len(passage), len(other)):
            want.add((i + 1, i))
        rows += [(i, " ".join(fresh(60) + passage + fresh(50))), (i + 1, " ".join(fresh(45) + other + fresh(70)))]
    got = [(x.doc_id, x.other_id) for x in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(got) & want) >= 0.95 * len(want) and len(want) > 140
    print("recall", share, len(set(got) & want) / len(want), "rows a pair", len(got) / len(set(got)))
    assert len(got) <= 1.1 * len(set(got))


# ---- mixing

def brute_mix(rows, seed, weights, total):
    """Copies of each document, by walking whole passes."""
    def number(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)

    out = {}
    for source, w in weights.items():
        own = [(i, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, t, s in rows if (s or "") == source]
        tokens = sum(n for _, n in own)
        shift = number(f"{seed} order|{source}")

        def place(i, shift=shift):
            u = number(f"{seed}|{i}")
            return [*[((u >> s & 63) * 37 + (shift >> 6 * k)) % 64 for k, s in enumerate((54, 48, 42))], u, i]

        own.sort(key=lambda x: place(x[0]))
        if not tokens:
            out |= {i: 1 for i, _ in own}
            continue
        goal = int(w * total + 0.5)
        passes, left = divmod(goal, tokens)
        for i, n in own:
            left -= n
            out[i] = passes + (left >= 0)
    return out


def test_mix_is_that_of_whole_walks(spark):
    r = random.Random(2)
    rows = [(i, text_of(i, r.randrange(0, 60)), r.choice(["a"] * 8 + ["b"] * 2 + ["c", None])) for i in range(600)] + [(900, None, "empty"), (901, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    size = {}
    for _, t, s in rows:
        size[s or ""] = size.get(s or "", 0) + len((t or "").split())
    total = sum(size.values())
    shares = {s: n / total for s, n in size.items() if n}

    def weights(alpha):
        z = sum(p**alpha for p in shares.values())
        return {s: p**alpha / z for s, p in shares.items()}

    def entropy(alpha):
        return -sum(w * np.log(w) for w in weights(alpha).values())

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= mixing.ENTROPY * np.log(len(shares)) else (lo, mid)
    w = weights(lo) | {"empty": 0.0}
    assert {i: x.copies for i, x in got.items()} == brute_mix(rows, 1, w, total)
    assert all(abs(x.weight - w[x.source]) < 1e-6 for x in got.values())
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and {r.doc_id: r["n"] for r in taken.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {i: x.copies for i, x in got.items() if x.copies}


def test_mix_by_repetition(spark, odd, empty):
    rows = [(i, "w " * 10, "big" if i < 900 else "small") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs, entropy=None, repeats=3.0)
    per = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.col("copies")).alias("n")).collect()}
    assert abs(per["small"] - 300) <= 1 and abs(per["big"] - 700) <= 1
    assert out.filter("source = 'small'").agg(F.max("copies")).first()[0] <= 3
    assert mixing.mixed(odd).count() == odd.count() and mixing.take_mix(odd).columns == odd.columns
    assert mixing.mixed(empty).count() == 0 and mixing.take_mix(empty).count() == 0


# ---- queries and the pipeline

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(same_rows, name):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, reference):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encoding"]
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    left = {i: t for i, t in rows.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        first.setdefault(norm(left[i]), i)
    left = {i: left[i] for i in first.values()}
    _, comp = brute_near([(i, t) for i, t in left.items()], 5, 80)
    left = {i: t for i, t in left.items() if comp[i] == i}
    stages = docs
    for name, f in p.STAGES[:3]:
        stages = f(spark, stages, SF)
        assert stages.columns == docs.columns, name
    assert {r.doc_id for r in stages.collect()} == set(left)
    copies = {r.doc_id: r.copies for r in mixing.mixed(stages).collect()}
    out = p.run(spark, SF).collect()
    want = sorted((i, len(ids := reference.encode_ordinary(left[i] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((left[i] or "").encode()).hexdigest()) for i, n in copies.items() for _ in range(n))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
