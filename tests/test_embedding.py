"""Hash embeddings are worked out once for what they embed."""
import hashlib

from pyspark.sql import functions as F

from textquarry.operators import arrow, learning


def test_a_digest_is_worked_out_once_a_text(spark):
    """A text that is new whenever it is asked for tells how often it was: all repeats of the digest are of one text."""
    v = spark.range(1).select(learning.hash_embedding(F.uuid(), 80).alias("v")).first().v
    assert len(v) == 80 and v[:32] == v[32:64] and v[:16] == v[64:]
    digest = hashlib.sha256("größe".encode()).digest()
    got = spark.createDataFrame([("größe",), (None,)], "t string").select(learning.hash_embedding(F.col("t"), 40).alias("v")).collect()
    assert got[0].v == [digest[i % 32] / 255 for i in range(40)] and got[1].v == [None] * 40


def test_code_is_embedded_once_a_chunk(spark):
    d = spark.createDataFrame([(i, 1, 4, f"x = {i}") for i in range(40)], "doc_id long, start_line int, end_line int, content string")
    found = arrow.search_code(d, "x = 7", 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
    assert found.columns == [*d.columns, "score"] and (found.first().doc_id, found.first().score) == (7, 1.0)
