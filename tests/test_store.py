"""The experiment store: class scores, AUC by pairs, kept models, and a killed grid that goes on."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.models import fit_job, fit_predict
from riskloom.plans import experiments as E
from riskloom.plans.experiments import finished, result_rows, select_then_test, validate_grid
from riskloom.session import scratch_path
from riskloom.sources.models import load_pipeline


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(180):
        y = i % 3
        x = rng.normal(size=3) + np.eye(3)[y] * 1.5
        rows.append((i, x.tolist(), str(y), 0, ("train", "val", "test")[i // 3 % 3]))
    return spark.createDataFrame(rows, "id bigint, x array<double>, label string, fold int, role string").repartition(3)


def pairs(rows):
    """Area under the curve by all pairs: rows are (positive, score)."""
    up, down = ([s for p, s in rows if p == side] for side in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(up, down)) / (len(up) * len(down))


JOBS = [
    ("knn", ("7", "distance", "1")), ("knn", ("5", "uniform", "2")), ("majority", ()), ("uniform", ("1",)), ("kmeans", ("4",)),
    ("lr", ("1",)), ("svm", ("1",)),
]


@pytest.mark.parametrize("alg, parameters", JOBS)
def test_predictions_and_scores_of_one_pass(spark, data, alg, parameters):
    train, test = data.where("role = 'train'"), data.where("role = 'test'")
    pred, scores = fit_job(alg, parameters, train, "id", "x").predict(test)
    named = {r.id: r.pred for r in pred.collect()}
    assert len(named) == test.count()
    if alg != "kmeans":  # its first centres depend on the order of the rows
        assert named == {r.id: r.pred for r in fit_predict(alg, parameters, train, test, "id", "x").collect()}
    got = {}
    for r in scores.collect():
        got.setdefault(r.id, {})[r["class"]] = (r.score, r.positive)
    truth = {r.id: r.label for r in test.collect()}
    assert set(got) == set(truth)
    for key, cells in got.items():
        assert set(cells) == {"0", "1", "2"} and [c for c, (_, p) in cells.items() if p] == [truth[key]]
        best = max(s for s, _ in cells.values())
        if alg != "uniform":
            assert cells[named[key]][0] == pytest.approx(best)
        if alg in ("knn", "lr"):
            assert sum(s for s, _ in cells.values()) == pytest.approx(1)


def test_a_grid_in_a_store(spark, data, monkeypatch):
    grid = {"knn": [("5", "uniform", "2"), ("9", "distance", "2")], "majority": [()], "lr": [("1",)]}
    store = scratch_path(spark, "store")
    once = []
    real = E.fit_job

    def killed(alg, parameters, *rest):
        once.append((alg, parameters))
        if alg == "lr":
            raise RuntimeError("executor lost")
        return real(alg, parameters, *rest)

    monkeypatch.setattr(E, "fit_job", killed)
    with pytest.raises(RuntimeError, match="executor lost"):
        validate_grid(data, ["label"], "id", "x", grid, ("none",), store=store, threads=1)
    before = {r.job: (r.train_time, r.pred_time) for r in finished(spark, store).collect()}
    assert len(before) == 3 and len(once) == 4
    again = []
    monkeypatch.setattr(E, "fit_job", lambda alg, *rest: (again.append(alg), real(alg, *rest))[1])
    scores = validate_grid(data, ["label"], "id", "x", grid, ("none",), store=store)
    rows = {(r.classifier, r.parameters): r for r in scores.collect()}
    assert again == ["lr"] and len(rows) == 4  # only what was not finished
    after = {r.job: (r.train_time, r.pred_time) for r in finished(spark, store).collect()}
    assert {k: after[k] for k in before} == before and len(after) == 4
    # AUC of the stored scores by all pairs, for each class.
    held = spark.read.parquet(f"{store}/scores").collect()
    by = {}
    for r in held:
        by.setdefault(r.job, {}).setdefault(r["class"], []).append((r.positive, r.score))
    for r in finished(spark, store).collect():
        area = float(np.mean([pairs(c) for c in by[r.job].values()]))
        assert rows[r.classifier, r.parameters].auc == pytest.approx(area)
    assert rows["majority", ""].auc == 0.5 and rows["lr", "1"].auc > 0.8
    # The fitted model is kept and gives the stored predictions.
    [job] = [r.job for r in finished(spark, store).collect() if r.classifier == "lr"]
    model = load_pipeline(f"{store}/models/{job}")
    from riskloom.operators.models import batch_predict

    stored = {r.id: r.pred for r in spark.read.parquet(f"{store}/predictions/job={job}").collect()}
    assert stored == {r.id: r.pred for r in batch_predict(model, data.where("role = 'val'"), "id", "x").collect()}
    # Selection, test and the columns of the results table.
    tested = select_then_test(data, scores, "id", "x", store=store)
    assert {(r.classifier, r.fold) for r in tested.collect()} == {("knn", 0), ("majority", 0), ("lr", 0)}
    assert finished(spark, store).groupBy("role").count().collect().__len__() == 2
    columns = result_rows(tested, "code", "hunk", "bow").columns
    assert len(columns) == 17 and columns[:8] == ["problem", "partition", "feature_type", "feature_scope", "token", "classifier", "parameters", "resampling"]
    assert tested.where(F.col("train_time") <= 0).count() == 0


def test_neighbours_are_searched_once_for_all_jobs_of_a_fold(spark, data, monkeypatch):
    both = data.union(data.withColumn("fold", F.lit(1)))
    grid = {"knn": [("5", "uniform", "2"), ("9", "distance", "2"), ("9", "uniform", "2"), ("3", "distance", "1")]}
    asked, real = [], E.nearest

    def counted(queries, train, k, *rest, metric, **names):
        asked.append((k, metric))
        return real(queries, train, k, *rest, metric=metric, **names)

    monkeypatch.setattr(E, "nearest", counted)
    store = scratch_path(spark, "store")
    validate_grid(both, ["label"], "id", "x", grid, ("none",), store=store).collect()
    assert sorted(asked) == [(3, "l1"), (3, "l1"), (9, "l2"), (9, "l2")]  # before: once a job
    train, test = data.where("role = 'train'"), data.where("role = 'val'")
    for line in finished(spark, store).collect():
        kept = spark.read.parquet(f"{store}/scores/job={line.job}").collect()
        own = fit_job("knn", line.parameters.split("-"), train, "id", "x").predict(test)[1].collect()
        assert {(r.id, r["class"]): r.score for r in kept} == pytest.approx({(r.id, r["class"]): r.score for r in own})


def test_own_estimator_and_own_extractor(spark, data):
    """Any Spark ML classifier, and any function that makes the features."""
    from pyspark.ml.classification import NaiveBayes

    train, test = data.where("role = 'train'"), data.where("role = 'test'")
    own = fit_predict(NaiveBayes(modelType="gaussian"), (), train, test, "id", "x")
    assert own.where("truth = pred").count() > 0.6 * test.count()
    grid = {"knn": [("5", "uniform", "2")]}
    make = lambda df: df.withColumn("made", F.transform("x", lambda v: v * 2))
    made = validate_grid(data, ["label"], "id", "made", grid, ("none",), extract=make).drop("train_time", "pred_time")
    plain = validate_grid(data, ["label"], "id", "x", grid, ("none",)).drop("train_time", "pred_time")
    assert made.collect() == plain.collect()


def test_all_manual_features(spark):
    from riskloom.operators.reshape import CHANGE_METRICS, MANUAL_FEATURES, manual_features

    row = spark.range(1).select(F.lit("c").alias("commit"), *[F.lit(i).alias(n) for i, n in enumerate(MANUAL_FEATURES)])
    out = manual_features(row)
    assert len(CHANGE_METRICS) == 11 and len(out.columns) == 69 and out.first()["while"] == 67.0
