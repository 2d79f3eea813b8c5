import math

import numpy as np
import pytest

from riskloom.operators.metrics import auc_macro, auc_ovr, overall_scores, score, score_tasks, wide_report


def brute(pairs):
    labels = sorted({x for p in pairs for x in p})
    n = len(pairs)
    m = np.array([[sum(1 for a, b in pairs if a == t and b == p) for p in labels] for t in labels], dtype=float)
    tp, t, p = m.diagonal(), m.sum(1), m.sum(0)
    prec = np.array([a / b if b else 0 for a, b in zip(tp, p)])
    rec = np.array([a / b if b else 0 for a, b in zip(tp, t)])
    f1 = np.array([2 * a / (b + c) if b + c else 0 for a, b, c in zip(tp, p, t)])
    den = math.sqrt((n * n - (p * p).sum()) * (n * n - (t * t).sum()))
    mcc = (tp.sum() * n - (t * p).sum()) / den if den else 0.0
    return {
        "accuracy": tp.sum() / n, "precision": prec.mean(), "recall": rec.mean(), "f1": f1.mean(),
        "gmean": math.sqrt(prec.mean() * rec.mean()), "mcc": mcc,
    }


@pytest.mark.parametrize("seed", range(4))
def test_macro_metrics_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(str(a), str(b)) for a, b in zip(rng.integers(0, 4, 200), rng.integers(1, 6, 200))]
    got = score(spark.createDataFrame(pairs, "truth string, pred string")).first().asDict()
    want = brute(pairs)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_one_class_has_no_correlation(spark):
    df = spark.createDataFrame([("a", "a")] * 3, "truth string, pred string")
    r = score(df).first()
    assert r["mcc"] == 0 and r["f1"] == 1


def test_groups_keep_their_own_labels(spark):
    rows = [("g", "a", "a"), ("g", "b", "a"), ("h", "x", "y")]
    got = {r["k"]: r["f1"] for r in score(spark.createDataFrame(rows, "k string, truth string, pred string"), ["k"]).collect()}
    assert got == {"g": pytest.approx(1 / 3), "h": 0}


def test_averages(spark):
    rows = [("1", "1")] * 6 + [("1", "0")] * 2 + [("0", "1")] * 1 + [("0", "0")] * 3
    df = spark.createDataFrame(rows, "truth string, pred string")
    b = score(df, average="binary").first()
    assert b["precision"] == pytest.approx(6 / 7) and b["recall"] == pytest.approx(6 / 8)
    w = score(df, average="weighted").first()
    assert w["recall"] == pytest.approx(9 / 12)
    assert score(df, average="micro").first()["f1"] == pytest.approx(9 / 12)
    with pytest.raises(ValueError):
        score(df, average="median")
    with pytest.raises(ValueError):
        score(df, metrics=["nope"])


def test_tasks_and_reports(spark):
    df = spark.createDataFrame([("r", "a", "a", "x", "y"), ("r", "b", "b", "y", "y")], "run string, t1 string, t1_pred string, t2 string, t2_pred string")
    per = score_tasks(df, ["t1", "t2"], ["run"])
    acc = {r["task"]: r["accuracy"] for r in per.collect()}
    assert acc == {"t1": 1.0, "t2": 0.5}
    assert overall_scores(per, ["run"]).first()["accuracy"] == 0.75
    assert overall_scores(per, ["run"], {"t1": 3.0}).first()["accuracy"] == pytest.approx((3 + 0.5) / 4)
    wide = wide_report(per, ["t1", "t2"], ["run"]).first()
    assert wide["t2_acc"] == 0.5 and wide["accuracy"] == 0.75 and "f1-score" in wide.asDict()


def test_auc_equals_pairwise_definition(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 7, 80)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
    df = spark.createDataFrame([("c", int(a), float(b)) for a, b in zip(y, s)], "label string, y int, s double")
    per = auc_ovr(df, [], "label", "y", "s")
    assert per.first()["auc"] == pytest.approx(want)
    missing = per.unionByName(auc_ovr(df.filter("y = 1").selectExpr("'d' as label", "y", "s"), [], "label", "y", "s"))
    assert auc_macro(missing, []).first()["auc"] == 0
