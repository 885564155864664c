"""Operators of textquarry.llm: hard rows, brute force, round trips."""
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.llm import bpe, chat, classifier, common, fingerprints, hashing, jaccard, langid, line_dedup, mixing, quality_rules, suffix_dedup
from textquarry.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(6000))
PROSE = "\n".join(" ".join(f"line{i}w{j}" for j in range(12)) for i in range(30))
NEAR = PROSE.replace("line7w3", "changed")


def rows():
    texts = ["", None, "   \n\t ", "one two three four", PROSE, PROSE, NEAR, LONG, "<|endoftext|> it's  a \\ test\n\n", "aaaa " * 300, "été 日本語 😀 " * 40]
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]
    return out + [out[4], (None, "null id text", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def clash(df):
    """Extra columns whose names operators use inside or return."""
    names = ["ids", "score", "h", "k", "n", "lines", "cuts", "replica", "fingerprint", "lang_pred", "th", "_n", "spans", "bucket"]
    return df.withColumns({n: F.lit("mine") for n in names})


def test_bpe_equals_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    got = bpe.decode(bpe.encode(clash(docs), tokenizer_path()), tokenizer_path()).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.digests(empty, tokenizer_path()).count() == 0


def test_bpe_long_pretokens():
    """Long pre-tokens equal the library's, in time linear in their length."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    enc = bpe.Encoder(bpe.Vocabulary(tokenizer_path()))
    rng = np.random.default_rng(2)
    for text in ("a" * 5000, "=" * 4000 + "-" * 333, "abcab" * 900, "".join(rng.choice(list("etaoinshrdlu"), 20000)), "".join(thue_morse())):
        assert enc.batch([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    cp = np.frombuffer("".join(thue_morse() + thue_morse()).encode("utf-32-le"), np.uint32)
    first, back = bpe._alike(cp, np.arange(0, 4096, 1024), np.arange(1024, 4097, 1024))
    assert len(first) == 2 and back[0] == back[2] != back[1] == back[3]


def test_fingerprints(docs, empty):
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.edited(clash(docs)).collect()}
    plain = sorted(((i, t or "") for i, t, *_ in rows()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    for (i, t), (_, nxt) in zip(plain, plain[1:] + plain[:1], strict=True):
        if i in (None, 4, 5, 0):  # rows of one id have an order of their own, and so has what follows them
            continue
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i, len(t)].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    assert got[4, len(PROSE)].fingerprint == got[5, len(PROSE)].fingerprint
    assert fingerprints.edited(empty).count() == 0
    assert fingerprints.fingerprints(clash(docs)).count() == len(rows())


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        a = [f"w{x}" for x in rng.integers(0, 60, 200)]
        b = a[: int(rng.integers(20, 180))] + [f"v{x}" for x in rng.integers(0, 60, 60)]
        count = lambda w: {g: sum(1 for i in range(len(w) - 4) if tuple(w[i : i + 5]) == g) for g in {tuple(w[i : i + 5]) for i in range(len(w) - 4)}}
        x, y = count(a), count(b)
        keys = x.keys() | y.keys()
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
        errors.append(fingerprints.likeness(fingerprints.signature(" ".join(a).encode()), fingerprints.signature(" ".join(b).encode())) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_jaccard_join(docs, empty):
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_class_links) for r in jaccard.linked_documents(clash(docs)).collect() if r.doc_id in (3, 4, 5, 6, 0))
    assert got == [(0, 0, 0, 0), (3, 3, 0, 0), (4, 4, 3, 1), (4, 4, 3, 1), (5, 4, 3, 1), (6, 4, 3, 0 + 1)]
    kept = jaccard.one_of_each(clash(docs))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 8, 9, 10]
    assert jaccard.linked_documents(empty).count() == 0


def test_one_of_each_with_shared_and_null_ids(spark):
    """Components that share their smallest doc_id, or have only null ones, each keep one row."""
    text = lambda p, new: " ".join(new if i == 40 else f"{p}{i}" for i in range(200))
    d = [(5, text("a", "x")), (7, text("a", "y")), (5, text("b", "x")), (9, text("b", "y")), (None, text("c", "x")), (None, text("c", "y"))]
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, None, None, None) for i, t in d], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("5", "a"), ("5", "b"), ("None", "c")]


def exact_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_links(texts, threshold):
    """n_links of every text, by comparing all pairs word by word."""
    sets = exact_sets(texts)
    return [sum(j != i and bool(a) and len(a & b) >= threshold * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


@pytest.mark.parametrize(("threshold", "depth"), [(0.8, 1), (0.8, 2), (0.8, 3), (0.5, 2), (0.5, 3)])
def test_links_equal_brute_force(spark, monkeypatch, threshold, depth):
    """Per row, in groups of near copies larger than a block, with leaves at each depth; no row has a surplus or a lost link."""
    if depth > 1:  # the blocks of the last depth then hold few sets, so that most pairs must meet deep down
        monkeypatch.setattr(jaccard, "SMALL", 16)
    monkeypatch.setattr(jaccard, "DEPTH", depth)
    rng = np.random.default_rng(depth)
    base, other = PROSE.split(), [f"o{i}" for i in range(200)]
    texts = []
    for i in range(240):
        w = list(base if i % 2 else other)
        for at in rng.integers(0, len(w), int(rng.integers(1, 8 if threshold > 0.6 else 14))):
            w[at] = f"new{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    texts += texts[:20] + ["", " \n", "one two", "one two"]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.n_links for r in jaccard.join(d, threshold).collect()}
    want = brute_links(texts, threshold)
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * sum(want) > 2000


def test_components_of_stars_and_chains(spark, monkeypatch):
    """A hub with most of the nodes, a long chain and loose pairs: the smallest node of each component."""
    plain = common.join_hot
    monkeypatch.setattr(jaccard, "join_hot", lambda *a, **k: plain(*a, **{**k, "least": 10}))
    edges = [(500, i) for i in range(501, 800)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001), (2003, 2002)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 500 for i in range(500, 800)}, **{i: 1000 for i in range(1000, 1061)}, 2000: 2000, 2001: 2000, 2002: 2002, 2003: 2002}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_follow_from_threshold():
    assert [jaccard.roots(t) for t in (0.9, 0.8, 0.5, 0.3)] == [10, 16, 39, 79]
    assert jaccard.estimated_recall(100, 0, 5) == 1.0 and jaccard.estimated_recall(100, 50, 10) < 0.5


def test_runs_repeat_until_recall(spark, monkeypatch):
    """With far too few roots the estimate is low, and the join starts again with more."""
    monkeypatch.setattr(jaccard, "roots", lambda threshold: 1)
    used, plain = [], jaccard._asked
    monkeypatch.setattr(jaccard, "_asked", lambda c, t, n: used.append(n) or plain(c, t, n))
    rng = np.random.default_rng(1)
    texts = [" ".join(f"g{g}w{j}" if j != k else f"x{rng.integers(1 << 30)}" for j in range(90)) for g in range(150) for k in (20, 60)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.n_links for r in jaccard.join(d).collect()}
    assert used[0] == 1 and len(used) > 1 and sum(got.values()) >= 0.99 * sum(brute_links(texts, 0.8))


def test_tables_of_whole_groups_stay_small():
    """A batch of many groups is cut into many tables, so that what is compared at once does not follow the batches' size."""
    g = np.sort(np.random.default_rng(2).integers(0, 150, 25_000))
    g[3_000:5_500] = g[3_000]
    g.sort()
    whole = pa.table({"g": g, "x": np.arange(len(g))})
    for size in (10_000, 700, 60):
        got = list(jaccard._whole_groups(whole.to_batches(size), 1_000))
        assert pa.concat_tables(got).equals(whole)
        keys = [set(t.column("g").to_pylist()) for t in got]
        assert all(not x & y for x, y in zip(keys, keys[1:], strict=False))
        assert all(t.num_rows <= 1_000 or len(k) == 1 for t, k in zip(got, keys, strict=True))
    few = list(jaccard._whole_groups(whole.to_batches(10_000), 1_000, most=whole.nbytes // 100))
    assert pa.concat_tables(few).equals(whole) and all(t.num_rows <= 250 or len(set(t.column("g").to_pylist())) == 1 for t in few)


def test_overlaps_by_group():
    """Sizes of intersections, in groups of one block and of two, of many pairs and of few."""
    rng = np.random.default_rng(3)
    own = {i: np.unique(rng.integers(0, 9_000, int(rng.integers(1, 900)))) for i in range(90)}
    g = np.repeat([5, 6, 7], [40, 40, 10])
    side = np.concatenate([np.full(40, 2), rng.integers(0, 2, 40), np.full(10, 2)])
    a, b = np.triu_indices(90, 1)
    ok = (g[a] == g[b]) & ((side[a] == 2) | (side[a] != side[b])) & ((g[a] < 7) | (b == 89))
    a, b = a[ok], b[ok]
    got = jaccard.overlaps_by_group(own, g, side, a, b)
    assert got.tolist() == [len(np.intersect1d(own[i], own[j])) for i, j in zip(a, b, strict=True)] and len(set(g[a])) == 3


def test_exact_shingles_whatever_the_hash(monkeypatch):
    """Texts share a number where they share five words in a row, also if all hashes collide."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3, int(n))) for n in [*rng.integers(1, 60, 30), 5, 4, 1]] + ["", " \n", "w1 w2", "w1  w2"]
    want = exact_sets(texts)
    for _ in range(2):
        got = [set(x.tolist()) for x in hashing.exact_shingles([t.encode() for t in texts], 5)]
        assert [[len(a & b) for b in got] for a in got] == [[len(a & b) for b in want] for a in want]
        monkeypatch.setattr(hashing, "place", lambda word: np.zeros(len(word[0]), np.uint64))
    assert hashing.exact_shingles([], 5) == [] and [len(x) for x in hashing.exact_shingles([b"", b" "], 5)] == [0, 0]


def test_sip_words():
    """One digest for each word, the same wherever the word stands: SipHash-2-4 by its own definition, and mix()."""

    def sip(data, key=b"0123456789123456"):
        turn = lambda x, b: (x << b | x >> (64 - b)) & full
        full, k0, k1 = (1 << 64) - 1, int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little")
        v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

        def rounds(n):
            for _ in range(n):
                v[0] = (v[0] + v[1]) & full
                v[1] = turn(v[1], 13) ^ v[0]
                v[0] = turn(v[0], 32)
                v[2] = (v[2] + v[3]) & full
                v[3] = turn(v[3], 16) ^ v[2]
                v[0] = (v[0] + v[3]) & full
                v[3] = turn(v[3], 21) ^ v[0]
                v[2] = (v[2] + v[1]) & full
                v[1] = turn(v[1], 17) ^ v[2]
                v[2] = turn(v[2], 32)

        whole = data + bytes(7 - len(data) % 8) + bytes([len(data) & 255])
        for i in range(0, len(whole), 8):
            m = int.from_bytes(whole[i : i + 8], "little")
            v[3] ^= m
            rounds(2)
            v[0] ^= m
        v[2] ^= 255
        rounds(4)
        return v[0] ^ v[1] ^ v[2] ^ v[3]

    raw = " one\ttwo\u00a0three\none \u00e9t\u00e9 12345678 \0 ".encode() + b"x" * 300
    assert hashing.sip_words(raw).tolist() == hashing.mix(np.array([sip(w) for w in raw.split()], np.uint64)).tolist()
    assert hashing.sip_words(b"").dtype == np.uint64 and not len(hashing.sip_words(b" \n"))
    x = np.random.default_rng(5).integers(0, 50, 90)
    assert all(hashing.distinct(x[:n]).tolist() == np.unique(x[:n]).tolist() for n in (0, 1, 2, 90))


def thue_morse(n=10):
    s = [0]
    for _ in range(n):
        s += [1 - x for x in s]
    return "".join("ab"[x] for x in s), "".join("ba"[x] for x in s)


def test_strings_that_collide_modulo_powers_of_two(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2**64, whatever the base."""
    tokenizers = pytest.importorskip("tokenizers")
    a, b = thue_morse()
    d = spark.createDataFrame([(0, a, None, None, None), (1, b, None, None, None), (2, f"{a} {b}", None, None, None)], SCHEMA).coalesce(1)
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    for r in bpe.round_trip(d, tokenizer_path()).collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text
    got = {r.doc_id: r for r in jaccard.linked_documents(d).collect()}
    assert got[0].copy_id == 0 and got[1].copy_id == got[1].class_id == 1 and {r.n_links for r in got.values()} == {0}
    assert len({r.fingerprint for r in fingerprints.fingerprints(d).collect()}) == 3
    raw = [(r.doc_id, r.text.encode()) for r in d.collect()]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.removals(d).collect()}
    assert got == brute_removals(raw)


def brute_removals(raw):
    """n_removed and kept_sha256 by doc_id, from all strings of 400 bytes."""
    seen: dict[bytes, int] = {}
    for _, t in raw:
        for s in range(len(t) - 399):
            seen[t[s : s + 400]] = seen.get(t[s : s + 400], 0) + 1
    out = {}
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_quality_rules(spark, docs, labels, empty):
    got = {r.doc_id: r for r in quality_rules.verdicts(docs, labels).collect() if r.doc_id is not None}
    for i, t, *_ in rows():
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        seen = Counter(grams)
        cover = {j + k for j, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
    assert not got[1].kept and got[4].kept
    assert quality_rules.verdicts(empty, labels).count() == 0
    tail = spark.createDataFrame([(200, 3), (2000, 5), (50, 0), (10, 9)], "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect()
    from math import comb

    for r in tail:
        exact = sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == 1.0 if r.k >= 0.05 * r.n else abs(r.p - exact) < 1e-9 * max(exact, 1e-6) + 1e-12


STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def judged(n_symbols):
    return [(100, 500, x, 0, 0, False) for x in n_symbols]


def test_cutoffs_reject_and_bounds_forbid(spark):
    """With 400 good labels a cutoff is proven and rejects; with 40, or where the good ones look like the bad, none is.
    Names of extra columns clash."""
    good = [("many", x) for x in judged([0] * 400)] + [("few", x) for x in judged([0] * 40)] + [("alike", x) for x in judged([0, 250] * 200)]
    bad = [(lang, x) for lang in ("many", "few", "alike", None) for x in judged([250])]
    rows = [(i, lang, *x) for i, (lang, x) in enumerate(good + bad)]
    stats = clash(spark.createDataFrame(rows, STATS)).withColumns({"steps": F.lit("mine"), "step": F.lit("mine"), "i": F.lit("mine")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(good))], "doc_id long, quality int, toxic int")
    safe = quality_rules.cutoffs(stats, labels)
    got = {r.lang: r for r in safe.collect()}
    assert got["many"].steps == len(quality_rules.path()) and got["many"].symbols_per_word == 0.05
    assert got["few"].steps == 0 and got["few"].symbols_per_word is None and got["alike"].symbols_per_word is None
    out = {r.doc_id: r for r in quality_rules.judge(stats, safe).collect()}
    assert [out[len(good) + i].kept for i in range(4)] == [False, True, True, True]
    assert all(out[i].kept and out[i].n == "mine" for i in range(len(good)))


def test_risk_is_controlled(spark):
    """Of many simulated strata, at most the level's share (and chance) gets steps that reject too many good documents."""
    rng = np.random.default_rng(4)
    steps, n, strata = len(quality_rules.path()), 250, 200
    risk_at = quality_rules.RISK + 0.002  # from here on the steps reject a little too many
    rows = []
    for lang in range(strata):
        x = np.where(rng.random(n) < risk_at, 250, 0)
        rows += [(len(rows) + i, str(lang), *v) for i, v in enumerate(judged(x.tolist()))]
    stats = spark.createDataFrame(rows, STATS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    got = quality_rules.cutoffs(stats, labels, delta=quality_rules.DELTA * strata).collect()
    wrong = sum(r.symbols_per_word is not None for r in got)
    assert len(got) == strata and wrong <= strata * quality_rules.DELTA + 3 * (strata * quality_rules.DELTA) ** 0.5


def test_line_dedup(spark, docs, empty):
    out = line_dedup.dedup(clash(docs)).collect()
    assert len(out) == len(rows())
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[4].text == PROSE and by[4].n_removed_lines == 0
    assert by[5].n_removed_lines > 15 and by[1].text is None and by[0].text == "" and by[8].n_removed_lines == 0
    assert by[6].n_removed_lines > 5 and "changed" in by[6].text
    assert line_dedup.dedup(empty).count() == 0


def test_passages(spark, docs, empty):
    """A pasted passage goes whole wherever it starts; the first occurrence of every line stays."""
    run = [" ".join(f"run{i}w{j}" for j in range(14)) for i in range(4)]
    own = lambda i, k: [f"own {i} line {x}" for x in range(k)]
    texts = ["\n".join([*own(i, i), *run[i % 2 :], "", *own(i + 100, 3)]) for i in range(12)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in line_dedup.passages(clash(d)).collect()}
    assert got[0].text == texts[0] and got[0].n_removed_lines == 0
    assert all(got[i].text == "\n".join([*own(i, i), "", *own(i + 100, 3)]) and got[i].n_removed_lines == 4 - i % 2 for i in range(1, 12))
    out = line_dedup.passages(clash(docs)).collect()
    assert len(out) == len(rows()) and {x for _, t, *_ in rows() if t for x in t.split("\n")} == {x for r in out if r.text for x in r.text.split("\n")}
    assert line_dedup.passages(empty).count() == 0


def test_mixing(spark, docs, empty):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(d, {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200
    assert mixing.mix(d).collect() == mixing.mix(d.repartition(5)).collect()
    assert mixing.mix(clash(docs)).select("n").distinct().count() <= 1 and mixing.mix(empty).count() == 0


def test_classifier(docs, labels, empty):
    got = classifier.qualities(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert classifier.qualities(empty, labels).count() == 0
    assert {r.score for r in classifier.qualities(docs, labels.limit(0)).collect()} == {0.5}


def test_word_vectors_cover_unlabelled_texts(spark, docs, labels):
    """A word that only unlabelled texts have gets a context."""
    more = spark.createDataFrame([(100, "zebra quagga okapi " * 9, None, None, 0)], SCHEMA)
    at = int(classifier.buckets(*classifier.utf8(classifier.pa.array(["quagga"])))[0][0])
    a, b = (classifier.learn(d, labels)["table"][at] for d in (docs, docs.unionByName(more)))
    assert not np.allclose(a, b)


def test_suffix_dedup(spark, docs, empty):
    got = {r.doc_id: r for r in suffix_dedup.removals(clash(docs)).collect() if r.doc_id is not None}
    want = brute_removals([(i, (t or "").encode()) for i, t, *_ in rows()])
    assert all((got[i].n_removed, got[i].kept_sha256) == want[i] for i in got)
    assert suffix_dedup.removals(empty).count() == 0


def test_split_of_crowded_anchors(spark, monkeypatch):
    """Finer ranges of starts give the same result."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    core = word(450)
    d = spark.createDataFrame([(i, word(int(rng.integers(0, 300))) + core[i % 3 : 450 - i % 5] + word(200), None, None, None) for i in range(12)], SCHEMA)
    want = sorted(suffix_dedup.removals(d).collect())
    monkeypatch.setattr(suffix_dedup, "SPLITS", ((1, 1), (4, 8), (1 << 62, 201)))
    assert sorted(suffix_dedup.removals(d).collect()) == want


def test_strings_that_share_a_fingerprint(spark, docs, monkeypatch):
    """With only 16 different fingerprints, the family still finds what brute force finds, and nothing else."""
    strong = hashing.spans_mod
    weak = lambda *a: strong(*a) % np.uint64(16)
    rng = np.random.default_rng(7)
    texts = [bytes(rng.choice(np.frombuffer(b"ab", np.uint8), 420)) for _ in range(40)]
    for hashed in (strong, weak):
        monkeypatch.setattr(hashing, "spans_mod", hashed)
        monkeypatch.setattr(hashing, "mix", hashing.mix if hashed is strong else (lambda x: x % np.uint64(16)))
        levels = suffix_dedup.Family()
        segs = [*texts, texts[3][5:] + b"x" * 5, texts[8][:410], texts[9][1:]]
        anchor = np.array([210] * 40 + [205, 210, 209])
        for lo in range(0, len(segs), 7):
            n = len(segs[lo : lo + 7])
            levels.add(segs[lo : lo + 7], np.zeros(n, np.int64), anchor[lo : lo + 7], np.zeros(n, np.int64), np.full(n, 200))
        found = {i for i in range(len(segs)) if levels.high[i] >= 0}
        assert found == {3, 8, 9, 40, 41, 42}
        assert (levels.low[3], levels.high[3], levels.low[40], levels.high[40], levels.high[8], levels.low[42]) == (10, 20, 5, 15, 10, 9)


def test_families_end_with_their_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    cores = [word(450) for _ in range(30)]
    d = spark.createDataFrame([(i, word(int(rng.integers(0, 300))) + cores[i % 30][i % 3 : 450 - i % 5] + word(200), None, None, None) for i in range(90)], SCHEMA)
    monkeypatch.setattr(suffix_dedup, "ROOM", 1)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.removals(d).collect()}
    assert got == brute_removals([(r.doc_id, r.text.encode()) for r in d.collect()])


def test_hot_keys_are_dealt(spark, monkeypatch):
    """A key that most rows have is dealt to several tasks, with the rows of a plain join."""
    big = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    small = common.cut(big.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("key <> '9'"))
    for how in ("inner", "left"):
        got = common.join_hot(big, small, "key", "n", how, least=100)
        assert sorted(map(tuple, got.select("id", "key", "n", "top").fillna(-1).collect())) == sorted(map(tuple, big.join(small, "key", how).select("id", "key", "n", "top").fillna(-1).collect()))
        assert got.columns == ["id", "key", "n", "top"]


def test_chat(spark):
    turns = [(1, 2, "assistant", "c <b> \\l"), (1, 0, "user", None), (1, 1, "user", "x </turn>\n<turn>"), (1, 3, "assistant", ""), (None, 0, "system", "s"), (2, 0, None, "t")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse(chat.format_conversations(d)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("user", "x </turn>\n<turn>"), ("assistant", "c <b> \\l"), ("assistant", "")]
    assert got[1].loss_texts == ["c <b> \\l", ""] and got[1].formatted.count("<turn>") == 2
    assert [tuple(t) for t in got[2].turns] == [("", "t")] and got[None].loss_texts == []
    assert {r.conv_id for r in chat.digests(d.limit(0)).collect()} == {-7}


def test_language_id(docs, empty):
    got = langid.identify(clash(docs).withColumn("lang", F.when(F.col("text").contains("line"), "xx").otherwise("yy"))).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[5].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got) and langid.identify(empty).count() == 0
