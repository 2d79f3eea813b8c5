import math

import numpy as np
import pytest

from riskloom.operators.compare import cohen_d, compare_runs, mann_whitney, stack_runs, wilcoxon


def runs(spark, a, b):
    rows = [("s", "A", i, float(v)) for i, v in enumerate(a)] + [("s", "B", i, float(v)) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, "scenario string, side string, i int, value double")


def test_rank_sum_exact_small_sample(spark):
    r = mann_whitney(runs(spark, [1, 2, 3], [4, 5, 6]), ["scenario"], alternative="less").first()
    # U of B over A is 9 of 9: one of twenty orderings.
    assert r["u"] == 0 and r["p"] == pytest.approx(1 / 20)
    r = mann_whitney(runs(spark, [1, 2, 3], [4, 5, 6]), ["scenario"], alternative="two-sided").first()
    assert r["p"] == pytest.approx(2 / 20)


def test_rank_sum_default_asks_against_the_observed_direction(spark):
    r = mann_whitney(runs(spark, [1, 2, 3], [4, 5, 6]), ["scenario"]).first()
    assert r["alternative"] == "greater" and r["p"] == pytest.approx(1.0)


def test_rank_sum_normal_approximation_with_ties(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 10, 40), rng.integers(1, 12, 30)
    r = mann_whitney(runs(spark, a, b), ["scenario"], alternative="two-sided").first()
    u = sum(1.0 if x > y else 0.5 if x == y else 0 for x in a for y in b)
    assert r["u"] == u
    _, t = np.unique(np.concatenate([a, b]), return_counts=True)
    n = 70
    s = math.sqrt(40 * 30 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    z = (max(u, 1200 - u) - 600 - 0.5) / s
    assert r["z"] == pytest.approx(z) and r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_rank_sum_counts_complement(spark):
    a, b = [3, 1, 4, 1, 5], [9, 2, 6, 5]
    u1 = mann_whitney(runs(spark, a, b), ["scenario"]).first()["u"]
    u2 = mann_whitney(runs(spark, b, a), ["scenario"]).first()["u"]
    assert u1 + u2 == len(a) * len(b)


def test_signed_rank_exact(spark):
    r = wilcoxon(runs(spark, [5, 7, 9], [4, 5, 6]), ["scenario"], ["i"]).first()
    assert (r["n"], r["zeros"], r["w"]) == (3, 0, 0) and r["p"] == pytest.approx(0.25)


def test_signed_rank_drops_zeros_and_corrects_ties(spark):
    a = [1, 2, 3, 4, 5, 6, 7, 8]
    b = [1, 1, 4, 2, 4, 8, 4, 4]
    r = wilcoxon(runs(spark, a, b), ["scenario"], ["i"]).first()
    # Differences 0 1 -1 2 1 -2 3 4: sizes 1 1 1 2 2 3 4, ranks 2 2 2 4.5 4.5 6 7.
    assert (r["n"], r["zeros"], r["w"]) == (7, 1, 6.5)
    var = (7 * 8 * 15 - ((27 - 3) + (8 - 2)) / 2) / 24
    z = (6.5 - 14) / math.sqrt(var)
    assert r["z"] == pytest.approx(z) and r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_signed_rank_samples_the_larger_side(spark):
    r = wilcoxon(runs(spark, range(100), range(200, 220)), ["scenario"], ["i"]).first()
    again = wilcoxon(runs(spark, range(100), range(200, 220)).repartition(3), ["scenario"], ["i"]).first()
    assert r["n"] + r["zeros"] == 20 and r == again


def test_effect_size(spark):
    a, b = [1.0, 2, 3, 4], [2.0, 4, 6]
    r = cohen_d(runs(spark, a, b), ["scenario"]).first()
    pooled = math.sqrt((3 * np.var(a, ddof=1) + 2 * np.var(b, ddof=1)) / 5)
    assert r["cohen_d"] == pytest.approx(abs(np.mean(a) - np.mean(b)) / pooled)


def test_compare_runs_reports_scenarios_and_overall(spark):
    rng = np.random.default_rng(5)
    def table(shift):
        rows = [(s, f, float(rng.integers(0, 50) + shift), float(rng.random())) for s in ("x", "y") for f in range(10)]
        return spark.createDataFrame(rows, "scenario string, fold int, mcc double, f1 double")
    a, b = table(0), table(5)
    got = {(r["scenario"], r["metric"]): r for r in compare_runs(a, b, ["fold"], names=("old", "new")).collect()}
    assert set(got) == {(s, m) for s in ("x", "y", "overall") for m in ("mcc", "f1")}
    assert got[("overall", "mcc")]["n_a"] == 20 and got[("x", "f1")]["a"] == "old"
    assert all(0 <= r["mw_p"] <= 1 and 0 <= r["wilcoxon_p"] <= 1 for r in got.values())
    only = compare_runs(a, b, ["fold"], scenarios=["x"], metrics=["mcc"])
    assert {r["scenario"] for r in only.collect()} == {"x", "overall"}
    assert stack_runs(a, b, ["mcc"], ["fold"]).count() == 80


def test_rank_sum_p_has_no_jump_in_size(spark):
    small = mann_whitney(runs(spark, [1, 2, 3], range(10, 1010)), ["scenario"], alternative="greater").first()
    large = mann_whitney(runs(spark, [1, 2, 3], range(10, 1011)), ["scenario"], alternative="greater").first()
    assert small["p"] == pytest.approx(large["p"], rel=1e-6)
    normal = mann_whitney(runs(spark, [1, 2, 3], range(10, 1010)), ["scenario"], alternative="less", method="asymptotic").first()
    exact = mann_whitney(runs(spark, [1, 2, 3], range(10, 1010)), ["scenario"], alternative="less").first()
    ways = 1003 * 1002 * 1001 / 6
    assert exact["p"] == pytest.approx(1 / ways) and normal["p"] != pytest.approx(exact["p"])


def test_empty_and_tiny_sides_give_null(spark):
    for a, b in (([1, 2], []), ([], [3.0]), ([1], [2]), ([5], [])):
        r = mann_whitney(runs(spark, a, b), ["scenario"]).first()
        assert (r["p"] is None) == (not a or not b) and r["n_a"] == len(a)
    one = runs(spark, [1.0], [2.0]).drop("side").withColumnRenamed("value", "mcc")
    out = compare_runs(one.where("mcc = 1"), one.where("mcc = 3"), ["i"], metrics=["mcc"]).collect()
    assert {r["scenario"] for r in out} == {"s", "overall"} and all(r["mw_p"] is None for r in out)
