"""Queries that must look at the whole input."""
from pyspark.sql import functions as F

from textquarry.operators import conversations
from textquarry.plans import catalog


def test_labels_and_tokens_of_long_texts(spark, tmp_path):
    """mask_labels finds a marker wherever it stands; tokenize_pad_full cuts at 4096 only."""
    texts = [" ".join(["a"] * 100 + ["the"] + ["b"] * 30), " ".join(["a"] * 41), " ".join(f"w{i}" for i in range(5000)), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id: r.n_kept for r in catalog.QUERIES["mask_labels"](spark, str(tmp_path)).collect()}
    assert kept == {0: 30, 1: 13, 2: 1500, 3: 0, 4: 0}  # without a marker, what follows the first 70 %
    got = {r.doc_id: r.tokens.split(" ") for r in catalog.QUERIES["tokenize_pad_full"](spark, str(tmp_path)).collect()}
    assert got[2] == texts[2].split()[:4096] and got[0] == texts[0].split() + ["<pad>"] * (4096 - 131) and set(got[4]) == {"<pad>"}


def test_valid_tool_calls(spark):
    """FLT-15: every call counts, not the first only."""
    good = ['[]', '[{"function": {"name": "f"}}]', '[{"function": {"name": null}}, {"function": {"name": "g", "arguments": {}}}]']
    bad = [None, "", "[", "null", '{"function": {"name": "f"}}', '"f"', '[{"function": {"name": "f"}}, {"function": {}}]', '[{"function": {"name": "f"}}, "g"]', '[{"name": "f"}]', "[null]"]
    d = spark.createDataFrame([(c,) for c in good + bad], "calls string")
    got = [r.ok for r in d.select(conversations.valid_tool_calls(F.col("calls")).alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)
