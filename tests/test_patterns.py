"""Patterns mean in Java what they mean in RE2, the engine of the SQL."""
import pytest
from pyspark.sql import functions as F

from textquarry.functions import scores as S
from textquarry.plans import catalog

duckdb = pytest.importorskip("duckdb")

TEXTS = [
    "tioné the", "étion the", "tion the", "ational the", "tion\rthe", "tion  the", "tion\u0085the", "tion\x0bthe", "tion ́the", "tion", "", None, "DER éder derü der_ der", "1é.2 é1.22 ü12.3a 1.2",
    "éif x = 1\rY = 2", "éTODO TODOü TODO1", "éprint (1)", "X A = 1\nÉB = 2", "édef f(x)", "if\x0bx if x", "ſkK sk", "password\x0b='a'", "éa@b.de, a@b.deé", "_a-b c", "a\nschn worthless\né",
]
PATTERNS = [
    "tion\\b.*the", "(?i)\\bder\\b", "\\bif\\s+", "\\bTODO\\b", "\\b\\d{1,3}\\.\\d{1,3}\\b", "(?m)^([A-Z_]+)\\s*=", "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b", "tion.the",
    "(?i)\\bsk", "(?i)É", "\\Ba", "\\b", "[\\s]the", "\\bx?d", "\\be+", "[^\\S]", "\\\\b", "\\p{L}\\b", "a\\b-\\bb",
]


def test_patterns_as_in_the_sql(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, t string")
    got = d.select("doc_id", *[F.col("t").rlike(S.re2(p)).alias(f"m{i}") for i, p in enumerate(PATTERNS)], *[S.count_of(F.col("t"), p).alias(f"n{i}") for i, p in enumerate(PATTERNS)]).orderBy("doc_id").collect()
    con = duckdb.connect()
    for row in got:
        for i, p in enumerate(PATTERNS):
            want = con.execute("SELECT regexp_matches(?::VARCHAR, ?), len(regexp_extract_all(?::VARCHAR, ?))", [TEXTS[row.doc_id], p, TEXTS[row.doc_id], p]).fetchone()
            assert (row[f"m{i}"], row[f"n{i}"]) == want, (TEXTS[row.doc_id], p)


@pytest.mark.parametrize("name", ["grep_lines", "grep_count", "grep_context", "complexity", "maintainability", "code_issues", "quality_scores", "detect_language", "entity_texts"])
def test_queries_on_accents_and_line_ends(spark, tmp_path, name):
    texts = [*TEXTS, "\n".join(t for t in TEXTS if t)]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts) if t is not None or name.startswith("grep")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and want
