import pytest
from pyspark.sql import functions as F

from riskloom.operators.aggregates import best_per_group, count_distinct, first_per_group, most_common, spread, worst_per_group
from riskloom.operators.joins import left_null_safe, pair_tasks, strict_lookup, suffix_join
from riskloom.operators.reshape import (
    blank_changes,
    cast_columns,
    match,
    melt_results,
    parse_dates,
    split_context,
    union_all,
    unpivot_results,
)
from riskloom.operators.results import average_folds, best_iteration, compare_vector, optimal_classifiers, transfer_folds, transfer_table, umbrella_levels

NAN = float("nan")


def test_best_skips_nan_and_null_and_keeps_the_first_tie(spark):
    rows = [("g", "p1", 0.5, 1.0), ("g", "p0", 0.5, 2.0), ("g", "p9", NAN, 3.0), ("h", "p1", NAN, 4.0), ("g", "p8", None, 5.0), ("i", "p2", -1.0, 6.0)]
    df = spark.createDataFrame(rows, "k string, parameters string, mcc double, f1 double")
    got = {r["k"]: r["parameters"] for r in best_per_group(df, ["k"], ["parameters"]).collect()}
    assert got == {"g": "p0", "i": "p2"}
    low = {r["k"]: r["f1"] for r in worst_per_group(df, ["k"], ["parameters"]).collect()}
    assert low == {"g": 2.0, "i": 6.0}
    s = {r["k"]: (r["mcc_spread"], r["f1_spread"]) for r in spread(df, ["k"], ["parameters"]).collect()}
    assert s["g"] == (0.0, 0.0)


def test_small_aggregates(spark):
    df = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("a", None, 3), ("b", "z", 4)], "k string, v string, n int")
    assert {r["k"]: r["v"] for r in most_common(df.filter("v is not null"), ["k"], "v").collect()} == {"a": "x", "b": "z"}
    assert {r["k"]: r["n_distinct"] for r in count_distinct(df, "v", ["k"]).collect()} == {"a": 2, "b": 1}
    assert {r["k"]: r["n"] for r in first_per_group(df, ["k"], ["n"]).collect()} == {"a": 1, "b": 4}
    assert best_iteration(df.withColumn("m", F.lit(1.0)), ["k"], "m", "n").count() == 2


def results_frame(spark):
    rows = []
    for problem, base in (("binary", 0.1), ("multiclass", 0.3)):
        for alg in ("lr", "rf"):
            for p in ("1", "2"):
                for fold in ("0", "1", "holdout"):
                    for s in ("none", "over+_1", "over+_5"):
                        mcc = base + (0.2 if (alg, p) == ("rf", "2") else 0.0) + (0.05 if p == "1" else 0) + (9 if fold == "holdout" else 0)
                        rows.append((problem, fold, "code", "hc", "bow", alg, p, s, mcc, mcc / 2))
    return spark.createDataFrame(
        rows, "problem string, partition string, feature_type string, feature_scope string, token string, classifier string, parameters string, resampling string, mcc double, f1 double"
    )


def test_average_folds_leaves_out_holdout_and_adds_the_umbrella(spark):
    out = average_folds(results_frame(spark), ["mcc", "f1"])
    assert out.count() == 2 * 2 * 4 and out.agg(F.max("mcc")).first()[0] < 1
    top = out.filter("resampling = 'over+' and classifier = 'rf' and problem = 'binary'").first()
    assert top["mcc"] == pytest.approx((0.15 + 0.3) / 2) and top["partition"] == 0.5


def test_umbrella_levels(spark):
    found = umbrella_levels(results_frame(spark)).collect()
    assert {(r["problem"], r["classifier"]) for r in found} == {(p, c) for p in ("binary", "multiclass", "overall") for c in ("lr", "rf", "all")}
    two = spark.createDataFrame([("binary", "lr", "none", 0.2), ("binary", "lr", "over+_1", 0.8)], "problem string, classifier string, resampling string, mcc double")
    got = {r["resampling"]: (round(r["mcc"], 6), r["n"]) for r in umbrella_levels(two).where("problem = 'overall' AND classifier = 'all'").collect()}
    assert got == {"none": (0.2, 1), "over+_1": (0.8, 1), "over+": (0.8, 1), "all": (0.5, 2)}


def test_configurations_without_a_partner_stay(spark):
    wide = spark.createDataFrame(
        [("Binary", "a", "s", "w", "0.5", "0.4"), ("Multiclass", "a", "s", "w", "0.2", "0.3"), ("Multiclass", "b", "s", "w", "0.1", "0.6")],
        "task string, feature_type string, feature_scope string, token string, LR string, `Siamese CNN` string",
    )
    found = {(r["task"], r["feature_type"]): (r["classifier_ml"], r["classifier_dl"], r["ml_same"], r["all_same"]) for r in optimal_classifiers(wide).collect()}
    assert found == {
        ("Binary", "a"): ("LR", "Siamese CNN", "Yes", "No"), ("Multiclass", "a"): ("LR", "Siamese CNN", "Yes", "No"),
        ("Multiclass", "b"): ("LR", "Siamese CNN", "No", "No"),
    }
    moved = {(r["feature_type"], r["family"]): (r["classifier"], r["max_mcc"], r["transfer_mcc"]) for r in transfer_table(wide).collect()}
    assert moved["a", "all"] == ("LR", 0.3, 0.2) and moved["b", "all"] == (None, 0.6, None) and len(moved) == 6


def test_transfer(spark):
    out = {r["classifier"]: r for r in transfer_folds(results_frame(spark), ["mcc", "f1"]).collect()}
    assert set(out) == {"lr", "rf", "all_(rf)"}
    assert out["all_(rf)"]["parameters"] == "2" and out["all_(rf)"]["mcc_difference"] == pytest.approx(0)
    assert out["all_(rf)"]["multiclass_mcc_spread"] == pytest.approx(0.2)


def test_unpivot(spark):
    wide = spark.createDataFrame([(0, "val", "3", 0.9, 0.8, 1.5, 0.7, 0.6)], "run int, set string, fold string, accuracy double, mcc double, pred_time double, cvss2_conf_acc double, cvss2_conf_mcc double")
    rows = {r["scenario"]: (r["acc"], r["mcc"]) for r in unpivot_results(wide.drop("pred_time")).collect()}
    assert rows == {"multitask": (0.9, 0.8), "cvss2_conf": (0.7, 0.6)}
    with pytest.raises(ValueError):
        unpivot_results(wide.withColumnRenamed("cvss2_conf_acc", "cvss2_conf_odd"))


def test_melt_drops_dashes_and_best(spark):
    df = spark.createDataFrame([("t", "0.5", "-", "0.9")], "task string, LR string, CNN string, `DL best` string")
    assert [tuple(r) for r in melt_results(df, ["task"]).collect()] == [("t", "LR", 0.5)]


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "n int, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v int")
    assert {r["n"]: r["v"] for r in left_null_safe(a, b, ["k"]).collect()} == {1: 10, 2: 20}


def test_strict_lookup_fails_on_a_missing_key(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x", 1)], "k string, v int")
    assert strict_lookup(a.filter("k = 'x'"), b, "k").collect()[0]["v"] == 1
    with pytest.raises(Exception, match="no features for y"):
        strict_lookup(a, b, "k").collect()


def test_joins_of_results(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert suffix_join(a, a.filter("k = 'x'"), ["k"]).orderBy("k").collect()[1]["v_r"] is None
    t = spark.createDataFrame([("bin", "c", 1), ("mc", "c", 2), ("mc", "d", 3)], "task string, cfg string, m int")
    assert {(r["task"], r["m_other"]) for r in pair_tasks(t, "task", ["cfg"], ["m"]).collect()} == {("bin", 2), ("mc", 1)}
    with pytest.raises(Exception, match="several rows"):
        pair_tasks(t.unionByName(t), "task", ["cfg"], ["m"]).collect()


def test_small_projections(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05", "1.5", "a,b,c", "", None), ("soon", "-", "z", "p", "")], "date string, m string, t string, prev_data string, cur_data string")
    assert [r["date_rejected"] for r in parse_dates(df).collect()] == [False, True]
    assert [r["m"] for r in cast_columns(df, {"m": "double"}).collect()] == [1.5, None]
    assert [(r["d"], r["c"]) for r in split_context(df, "t", "d", "c").collect()] == [("a", "b,c"), ("z", "")]
    assert blank_changes(df).count() == 1
    assert match(df, m="-").count() == 1 and match(df).count() == 2 and match(df, m=["-", "1.5"]).count() == 2
    assert union_all(df.select("m"), df.select("t")).columns == ["m", "t"]


def test_vector_comparison_counts_missing_tasks_as_zero(spark):
    v = "AV:N/AC:L/Au:N/C:P/I:P/A:P"
    pred = spark.createDataFrame([("c", v, v), ("c", v, v.replace("AC:L", "AC:H"))], "cfg string, truth string, pred string")
    whole = spark.createDataFrame([("c", 0.5, 0.25)], "cfg string, f1 double, mcc double")
    single = spark.createDataFrame([("c", "cvss2_auth", 0.9, 0.8)], "cfg string, task string, f1 double, mcc double")
    out = {r["task"]: r for r in compare_vector(pred, ["cfg"], whole, single).collect()}
    assert len(out) == 7 and out["cvss2_auth"]["f1_task"] == 0.9 and out["cvss2_conf"]["f1_task"] == 0
    assert out["cvss2_accesscomp"]["f1_individual"] == pytest.approx(1 / 3) and out["cvss2_auth"]["f1"] == 0.5
