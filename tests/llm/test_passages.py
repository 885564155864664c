"""op4's passages against SQL and plain Python, with digests that collide, and op6's plan."""
import hashlib
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from textquarry.llm import line_dedup, mixing

DATA = "/root/testdata/sf0.001/documents.parquet"


def plain(docs, spare):
    """{(doc_id, text): kept lines} of (doc_id, text) rows."""
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:7], 16)
    seen, found = {}, []
    for doc, text in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, int(hashlib.md5(d[1].encode()).hexdigest()[:15], 16))):
        lines, before, last = text.split("\n"), 0, None
        for i, line in enumerate(lines):
            if not line.strip(" \t\n\x0b\x0c\r"):
                continue
            if not spare or (h(line) + line_dedup.BASES[1] * before) % line_dedup.PRIME % spare:
                if last is not None:
                    body = "\n".join(lines[last : i + 1])
                    found.append((doc, text, last, i, body))
                    seen.setdefault(body, (doc, text, last))
                last = i
            before = h(line)
    gone = {}
    for doc, text, a, b, body in found:
        if seen[body] != (doc, text, a):
            gone.setdefault((doc, text), set()).update(range(a, b + 1))
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())) for d, t in docs}


@pytest.mark.parametrize(("spare", "digits"), [(None, 2), (line_dedup.SPARE, 32), (line_dedup.SPARE, 2)])
def test_digests_only_choose(spark, spare, digits):
    """Digests of two hex digits collide all the time (a planted twin of every chunk): the bytes decide, and nothing changes."""
    d = spark.read.parquet(DATA).select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()] + [(None, "a b\nc d\ne f\ng h"), (None, "x\na b\nc d\ne f\ng h"), (7, None), (8, ""), (9, "tie\none\ntwo\nthree"), (9, "tie\none\ntwo\nthree"), (10, "tie\none\ntwo\nthree")]
    out = line_dedup.passages(spark.createDataFrame(rows, d.schema), spare, lambda c: F.substring(F.md5(c), 1, digits))
    got = sorted(map(str, [(r.doc_id, r.text) for r in out.collect()]))
    kept = plain(rows, spare)
    assert got == sorted(str((i, kept[i, t])) for i, t in rows)
    assert sum(kept[r] != r[1] for r in rows) > 10


@pytest.mark.parametrize("spare", [None, line_dedup.SPARE])
def test_sql(spark, spare):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}')")
    want = con.execute(f"select doc_id, n_lines, n_removed_lines, kept_sha256 from ({line_dedup.passages_sql(spare)})").fetchall()
    out = line_dedup.passages(spark.read.parquet(DATA).select("doc_id", "text"), spare)
    got = out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_numbers_are_drawn_once(spark):
    """No md5 within the lambda over the table of the Poisson distribution."""
    with redirect_stdout(io.StringIO()) as out:
        mixing.mixture(spark.read.parquet(DATA)).explain("formatted")
    for line in out.getvalue().splitlines():
        if "lambdafunction" in line and "filter(" in line:
            assert "md5" not in line.split("filter(", 1)[1].split("aggregate")[0]
