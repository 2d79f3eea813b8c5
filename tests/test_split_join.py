"""The join that splits hot keys: the plain join's rows, whatever is hot, and no task with more than its share."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.joins import hot_keys, split_join


def sides(spark):
    """Half of the left rows hold one key and a quarter none; the right side repeats keys and has NULL ones."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 4 == 1, None).otherwise(F.col("id") % 50)
    left = spark.range(0, 4000, 1, 8).select(key.cast("bigint").alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(i % 40, f"r{i}") for i in range(60)] + [(None, "none"), (None, "again")], "k bigint, w string")
    return left, right


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_rows_of_the_plain_join(spark, how, null_safe, max_bytes):
    left, right = sides(spark)
    a, b = left.alias("a"), right.alias("b")
    cond = F.col("a.k").eqNullSafe(F.col("b.k")) if null_safe else F.col("a.k") == F.col("b.k")
    plain = a.join(b, cond, how).select("a.k", "v", "w")
    assert rows(split_join(left, right, ["k"], how, null_safe, max_bytes=max_bytes)) == rows(plain)


def test_hot_keys_are_few_and_none_may_be_hot(spark):
    left, right = sides(spark)
    assert {r.k for r in hot_keys(left, ["k"], 8).collect()} == {7, None}
    assert hot_keys(left.limit(0), ["k"]).count() == 0
    even = spark.range(1000).select((F.col("id") % 200).alias("k"), F.col("id").alias("v"))
    assert hot_keys(even, ["k"], 64).count() == 0
    assert split_join(even, right, ["k"]).count() == even.join(right, "k", "left").count()
    assert split_join(left.limit(0), right, ["k"]).count() == 0
    with pytest.raises(ValueError, match="unknown join"):
        split_join(left, right, ["k"], "full")


def test_no_task_holds_more_than_its_share_of_the_hot_key(spark):
    left, right = sides(spark)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        one = right.where("k = 7").limit(1)
        share = lambda df: max(r["count"] for r in df.where("k = 7").groupBy(F.spark_partition_id()).count().collect())
        assert share(left.join(one, "k")) == 2040  # the plain join puts the key into one task
        assert share(split_join(left, one, ["k"], "inner", salts=64, max_bytes=0)) < 800
        assert share(split_join(left, one, ["k"], "inner")) <= 260  # rows stay in the eight parts they came in
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
