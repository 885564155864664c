"""Learned operators and the pipeline against plain Python, and hard rows that test_operators.py leaves out."""
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import LONG, NEAR, PROSE, SCHEMA, clash, exact_sets, rows
from textquarry.llm import chat, classifier, langid, line_dedup, mixing
from textquarry.llm.queries import tokenizer_path

ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away from the big bad wolf of the woods"
GERMAN = "der schnelle braune fuchs springt ueber den faulen hund und dann laeuft er weg von dem boesen wolf im wald"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def spoken():
    rng = np.random.default_rng(8)
    out = []
    for i in range(120):
        lang, source = ("en", ENGLISH) if i % 2 else ("de", GERMAN)
        words = rng.choice(source.split(), int(rng.integers(1, 60)))
        out.append((i, " ".join(words) + "!" * (i % 3), lang, "s", 0))
    return out + [(200, "", "en", "s", 0), (201, None, "de", "s", 0), (202, "123 ?!", "de", "s", 0), (203, "Zażółć gęślą", None, "s", 0)]


def bundle(text):
    """The sum of bound trigram vectors, one trigram at a time."""
    symbols = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
    if not any(c.isalpha() for c in symbols):
        return None
    vec = {c: langid.letter_vectors(np.array([ord(c)], np.uint32))[0].astype(float) for c in set(symbols)}
    total = sum(np.roll(vec[a], 2) * np.roll(vec[b], 1) * vec[c] for a, b, c in zip(symbols, symbols[1:], symbols[2:]))
    return total / np.linalg.norm(total)


def test_language_id_equals_brute_force(spark):
    data = spoken()
    protos: dict[str, np.ndarray] = {}
    import zlib

    for i, t, lang, *_ in data:
        v = bundle(t)
        if zlib.crc32(str(i).encode()) % 5 and lang and v is not None:
            protos[lang] = protos.get(lang, 0) + v
    names = sorted(protos)
    matrix = np.array([protos[n] / np.linalg.norm(protos[n]) for n in names])
    got = {r.doc_id: r for r in langid.identify(clash(spark.createDataFrame(data, SCHEMA))).collect()}
    for i, t, *_ in data:
        v = bundle(t)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if v is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            cos = matrix @ v
            assert got[i].lang_pred == names[int(cos.argmax())] and abs(got[i].score - max(cos.max(), 0)) < 1e-4


def test_language_ties_go_to_the_smaller_name(spark):
    d = spark.createDataFrame([(i, ENGLISH, "zz" if i % 2 else "aa", None, 0) for i in range(40)], SCHEMA)
    assert {r.lang_pred for r in langid.identify(d).collect()} == {"aa"}


def test_quality_equals_brute_force(spark):
    """Word vectors, pooled features and the scores of the fitted network, token by token."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(ENGLISH.split(), 30)) if i % 2 else " ".join(f"{w}$$${rng.integers(9)}" for w in rng.choice(GERMAN.split(), 30)) for i in range(80)]
    texts += ["", " \n ", "été 12,5"]
    d = clash(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA).repartition(3))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    tokens = [[m.group() for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|([^\x00-\x20A-Za-z0-9\x80-\xff])\1*", t.encode())] for t in texts]
    bucket = lambda w: int(classifier.buckets(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    place, sign = classifier.index_vectors()
    index = np.zeros((classifier.BUCKETS, classifier.DIM))
    for b in {bucket(w) for t in tokens for w in t}:
        for p, s in zip(place[b], sign[b], strict=True):
            index[b, p] += s
    table = np.zeros((classifier.BUCKETS, classifier.DIM))
    for t in tokens:
        b = [bucket(w) for w in t]
        for i in range(len(b)):
            for j in range(max(0, i - classifier.REACH), min(len(b), i + classifier.REACH + 1)):
                if j != i:
                    table[b[i]] += index[b[j]]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    for b in range(classifier.BUCKETS):
        for s in range(classifier.SIGNS):
            table[b, place[b, s]] += sign[b, s] / classifier.SIGNS**0.5
    model = classifier.learn(d, labels)
    assert np.allclose(model["table"], table, atol=1e-5)

    def pool(t):
        v = np.array([table[bucket(w)] for w in t]).reshape(-1, classifier.DIM)
        return np.concatenate([v.mean(0), v.std(0)]) if len(v) else np.zeros(2 * classifier.DIM)

    x = np.array([pool(t) for t in tokens])
    got = {r.doc_id: r.score for r in classifier.score(d, model).collect()}
    want = classifier.probability(model["net"], x.copy())
    assert max(abs(got[i] - want[i]) for i in range(len(texts))) < 1e-3
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in range(80)]) > 0.95
    again = {r.doc_id: r.score for r in classifier.score(d.repartition(7), classifier.learn(d.repartition(5), labels)).collect()}
    assert again == got


def test_quality_of_hard_rows(spark, docs):
    """A labelled doc_id with two texts, a very long text, clashing names: the same scores whatever the order of rows."""
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (8, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    twice = docs.unionByName(spark.createDataFrame([(4, "other text of four", "en", "a", 0), (7, LONG * 3, "en", "a", 0)], SCHEMA))
    a, b = (sorted(map(str, classifier.qualities(x, labels).collect())) for x in (clash(twice), twice.repartition(6, "text")))
    assert a == b and len(a) == len(rows()) + 2


def test_mixing_of_hard_rows(spark, docs):
    """Null sources, one very long text, tied and repeated rows: repeats depend on doc_id alone, text stays whole."""
    d = docs.unionByName(spark.createDataFrame([(50, LONG * 4, None, None, 0), (50, LONG * 4, None, None, 0), (51, "x", None, "only", 0)], SCHEMA))
    out = mixing.mix(clash(d)).collect()
    assert {r.text for r in out} <= {r.text for r in d.collect()} and all(r.replica >= 1 for r in out)
    assert {sum(r.doc_id == 50 and r.replica == k for r in out) for k in (1, 2, 3)} <= {0, 2}
    rates = {r.source: r for r in mixing.rates(d).collect()}
    assert abs(sum(r.share for r in rates.values()) - 1) < 1e-9 and None in rates
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.replica, r.shuffle_key) for r in again) == sorted((str(r.doc_id), r.replica, r.shuffle_key) for r in out)


def test_chat_of_hard_rows(spark):
    """Clashing names, a very long text, more turns than a block, tied and repeated turns, a -7 of the table's own."""
    turns = [(1, i, "assistant" if i % 3 else "user", f"text {i} <b> \\") for i in range(700)]
    turns += [(2, 0, "user", LONG * 5), (2, 0, "user", "tied"), (2, 0, "user", "tied"), (2, 0, "assistant", "tied"), (-7, 5, "assistant", "own")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("mine") for n in ("s", "p", "n", "blocks", "ends", "formatted", "loss_mask", "turns", "loss_texts")})
    got = {r.conv_id: r for r in chat.parse(chat.format_conversations(d)).collect()}
    assert [tuple(t) for t in got[1].turns] == [t[2:] for t in turns[:700]]
    assert got[1].loss_texts == [t[3] for t in turns[:700] if t[2] == "assistant"]
    assert [tuple(t) for t in got[2].turns] == sorted([t[2:] for t in turns[700:704]])
    digest = {r.conv_id: r for r in chat.digests(d).collect()}
    assert digest[-7].n_turns == 3 and digest[-7].loss_chars == 3 + len("\\### Assistant: </turn> ok")
    assert digest[1].loss_sha256 == hashlib.sha256("".join(got[1].loss_texts).encode()).hexdigest()


# the pipeline


def brute_pipeline(data):
    """Rows of run() as (doc_id, lang, source, ids, decoded digest), for unique ids that are not null."""
    from tokenizers import Tokenizer

    data = [r for r in data if r[1] and any(c.isalpha() for c in r[1])]
    wordy = lambda x: re.search(r"[^\x20\x09-\x0d]", x)
    seen, kept = set(), []
    for r in sorted(data, key=lambda r: r[0]):
        lines = r[1].split("\n")
        at = [i for i, x in enumerate(lines) if wordy(x)]
        number = [int(hashlib.md5(lines[i].encode()).hexdigest()[:7], 16) for i in at]
        at = [i for i, h, before in zip(at, number, [0, *number]) if (h + line_dedup.BASES[1] * before) % line_dedup.PRIME % line_dedup.SPARE]  # the borders of chunks
        gone = set()
        for a, b in zip(at, at[1:]):
            body = "\n".join(lines[a : b + 1])
            if body in seen:
                gone |= set(range(a, b + 1))
            seen.add(body)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or wordy(text):
            kept.append((r[0], text, *r[2:]))
    sets, group = exact_sets([r[1] for r in kept]), list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group] if b < a else [a if g == b else g for g in group]
    kept = [r for i, r in enumerate(kept) if group[i] == i]
    size: dict = {}
    for r in kept:
        size[r[3]] = size.get(r[3], 0) + len(r[1])
    parts = {s: n**mixing.ALPHA if n else 0 for s, n in size.items()}
    t, out = Tokenizer.from_file(tokenizer_path()), []
    for r in kept:
        rate = sum(size.values()) * parts[r[3]] / sum(parts.values()) / size[r[3]]
        draws = max(math.ceil(rate / mixing.STEP), 1)
        for _ in range(sum(poisson(rate / draws, f"{mixing.SEED}|{r[0]}|{j}") for j in range(draws))):
            ids = t.encode(r[1], add_special_tokens=False).ids
            out.append((r[0], r[2], r[3], tuple(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def poisson(mean, seed):
    u = (int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    n, p, total = 0, math.exp(-mean), math.exp(-mean)
    while total < u:
        n += 1
        p *= mean / n
        total += p
    return n


def written(spark, path, data, **more):
    d = spark.createDataFrame(data, SCHEMA)
    d.withColumns(more).write.parquet(str(path / "documents.parquet"))
    return str(path)


def piped(spark, sf_dir):
    import corpus_pipeline

    return sorted(((r.doc_id, r.lang, r.source, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=str)


def test_pipeline_equals_brute_force(spark, tmp_path):
    shared = "\n".join(" ".join(f"shared{i}x{j}" for j in range(9)) for i in range(5))
    data = [*spoken(), (300, PROSE, "en", "a", 0), (301, PROSE, "en", "b", 0), (302, NEAR, "en", "b", 0), (303, LONG, "en", None, 0)]
    data += [(310 + i, f"own {i} text\n{shared}\nend of {i}", None, ["a", "b"][i % 2], 0) for i in range(6)]
    data += [(320 + i, ENGLISH.replace("fox", f"fox{i}") + " " + GERMAN, "en", "big", 0) for i in range(8)]
    data += [(330, "<|endoftext|> été \\ 日本語 😀\n\n  x", "fr", "c", 0)]
    assert piped(spark, written(spark, tmp_path, data)) == brute_pipeline(data)


@pytest.mark.parametrize("kind", ["none", "empty texts", "nulls and repeats", "clashing names"])
def test_pipeline_of_hard_tables(spark, tmp_path, kind):
    if kind == "none":
        assert piped(spark, written(spark, tmp_path, [])) == []
    elif kind == "empty texts":
        assert piped(spark, written(spark, tmp_path, [(1, "", "en", "a", 0), (2, None, "en", "a", 0), (3, " \n", None, None, 0)])) == []
    elif kind == "nulls and repeats":
        got = piped(spark, written(spark, tmp_path, rows()))
        assert got and {r[0] for r in got} <= {r[0] for r in rows()} and 5 not in {r[0] for r in got}
    else:
        data = [r for r in spoken() if r[0] < 60]
        more = {n: F.lit("mine") for n in ("ids", "score", "th", "lines", "gone", "replica", "lang_pred", "set", "root")}
        assert piped(spark, written(spark, tmp_path, data, **more)) == brute_pipeline(data)
