"""What the operators share."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import common


@pytest.mark.parametrize("slots", [1, 3, 500])
def test_sums_on_two_levels(spark, slots):
    """Vectors of 40 partitions per key, one key in nearly all rows; the same sums whatever the slots."""
    vec = lambda i: np.array([i, -2.0 * i, i % 7])
    rows = [("hot" if i % 10 else f"k{i % 3}", bytearray(vec(i).tobytes())) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, total binary").repartition(40)
    got = {r["name"]: np.frombuffer(bytes(r.total), np.float64) for r in common.summed(df, "name", slots).collect()}
    for k in {n for n, _ in rows}:
        assert np.array_equal(got[k], sum(vec(i) for i in range(400) if rows[i][0] == k))
    assert common.summed(df.limit(0), "name", slots).collect() == []


def test_join_hot_deals_a_hot_key(spark):
    big = spark.range(6000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(7).alias("k"), "id")
    small = common.cut(big.groupBy("k").agg(F.count("*").alias("n")))
    out = common.join_hot(big, small, "k", "n", least=50)
    assert sorted(map(tuple, out.select("k", "id", "n").collect())) == sorted(map(tuple, big.join(small, "k").select("k", "id", "n").collect()))
