import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators.folds import (
    cut_points,
    expanding_split,
    holdout_split,
    kfold_split,
    random_folds,
    select_split,
    time_folds,
    time_order,
)


@pytest.fixture(scope="module")
def commits(spark):
    day = dt.datetime(2020, 1, 1)
    # A third of all commits share one date; every commit occurs twice, the second time later.
    rows = [(f"c{i:04d}", day + dt.timedelta(days=0 if i % 3 == 0 else i)) for i in range(300)]
    rows += [(c, d + dt.timedelta(days=1000)) for c, d in rows]
    return spark.createDataFrame(rows, "commit string, date timestamp").repartition(5)


def expected_order():
    day = dt.datetime(2020, 1, 1)
    rows = [(day + dt.timedelta(days=0 if i % 3 == 0 else i), f"c{i:04d}") for i in range(300)]
    return [c for _, c in sorted(rows)]


def test_cut_points_follow_the_truncated_step():
    assert cut_points(12, 12) == [int(i * (1 / 12) * 12) for i in range(12)]
    assert cut_points(15000, 12)[1:3] == [1250, 2500]
    # The floating-point step differs from integer division here.
    assert any(cut_points(n, 12)[i] != i * n // 12 for n in range(12, 200) for i in range(12))


def test_time_order_uses_first_date_and_breaks_ties_by_commit(commits):
    got = [r["commit"] for r in time_order(commits).orderBy("position").collect()]
    assert got == expected_order()


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_order_does_not_depend_on_partitioning(spark, commits, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = [r["commit"] for r in time_order(commits).orderBy("position").collect()]
        folds = {r["commit"]: r["partition"] for r in random_folds(commits).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == expected_order()
    assert folds == {r["commit"]: r["partition"] for r in random_folds(commits).collect()}


def test_holdout_sizes_and_order(commits):
    split = holdout_split(time_order(commits))
    sizes = {r["set"]: r["n"] for r in split.groupBy("set").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 240, "val": 30, "test": 30}
    assert select_split(split, "train", "val").count() == 270


def test_time_folds_are_disjoint_complete_and_ordered(commits):
    parts = time_folds(time_order(commits)).collect()
    assert len(parts) == 300
    order = sorted(parts, key=lambda r: r["position"])
    assert [r["time_partition"] for r in order] == sorted(r["time_partition"] for r in order)
    assert {r["time_partition"] for r in order} == set(range(12))


def test_random_folds_cover_all_commits_evenly(commits):
    folds = random_folds(commits).groupBy("partition").count().collect()
    assert {r["partition"] for r in folds} == set(range(10))
    assert all(r["count"] == 30 for r in folds)


def test_expanding_split_never_trains_on_later_commits(commits):
    split = expanding_split(time_folds(time_order(commits)))
    ends = split.groupBy("fold").pivot("role", ["train", "val", "test"]).agg(
        F.struct(F.min("position").alias("lo"), F.max("position").alias("hi"))
    )
    for r in ends.collect():
        assert r["train"]["hi"] < r["val"]["lo"] <= r["val"]["hi"] < r["test"]["lo"]
    assert ends.count() == 10


def test_kfold_split_tests_each_commit_once(commits):
    split = kfold_split(random_folds(commits))
    assert split.filter("role = 'test'").groupBy("commit").count().filter("count <> 1").count() == 0
    assert split.count() == 3000


def test_totals_of_parts_sort_no_rows(spark, commits):
    from riskloom.operators.folds import part_totals
    from riskloom.plans.forecast import _expanding, _kfold, _time_folds

    parts = time_folds(time_order(commits))
    got = {tuple(r) for r in part_totals(parts, "time_partition", 12, first=(F.min, "commit"), last=(F.max, "position")).collect()}
    by = parts.groupBy("time_partition").agg(F.count("*"), F.min("commit"), F.max("position"))
    assert got == {tuple(r) for r in by.collect()}
    few = part_totals(parts.where("time_partition IN (0, 3)"), "time_partition", 12)
    assert [r["time_partition"] for r in few.collect()] == [0, 3]  # a part without rows gives none
    for query in (_expanding, _kfold, _time_folds):
        plan = query(spark, "/root/testdata/sf0.001")
        read = plan._jdf.queryExecution().optimizedPlan().toString()
        # Before: rows went through the folds, and grouping sorted them; now one aggregate without keys reads them.
        assert "Aggregate [array(" in read


def test_commits_are_dealt_out_before_they_are_merged(spark, monkeypatch):
    from riskloom.operators import ranks

    rows = spark.range(4000).select((F.col("id") % 3000).cast("string").alias("commit"), (F.col("id") % 7).alias("date"))
    expected = [sorted(map(tuple, f(rows).collect())) for f in (time_order, random_folds)]
    monkeypatch.setattr(ranks, "RANGE_ROWS", 100)
    for dealt, columns in ((ranks.dealt(rows, "commit"), 1), (ranks.dealt(rows, "commit", "date"), 2)):
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(dealt.columns) == columns and sum(sizes) == 4000 and max(sizes) < 300  # before: as many as the scan's task
    assert [sorted(map(tuple, f(rows).collect())) for f in (time_order, random_folds)] == expected
