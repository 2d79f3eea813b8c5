"""The joint model: gradient against differences, joint heads against majorities, weights, odd labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import multitask as M
from riskloom.operators.metrics import score_tasks


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    shape = M.Shape(4, 3, [1, 3, 4])
    x, theta = rng.normal(size=(12, 4)), rng.normal(size=shape.size)
    y = np.stack([rng.integers(-1, n, 12) for n in (2, 3, 4)], axis=1)
    weights = [1.0, 0.3, 0.7]
    _, gradient = M.loss_and_gradient(theta, shape, x, y, weights)
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        up, down = (M.loss_and_gradient(theta + s, shape, x, y, weights)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-5
    # By rows: the sums of parts are the sums of all.
    parts = [M.loss_and_gradient(theta, shape, x[s], y[s], weights) for s in (slice(0, 5), slice(5, 12), slice(0, 0))]
    assert np.allclose(sum(p[1] for p in parts), gradient)


def test_loss_is_the_cross_entropy():
    shape = M.Shape(1, 1, [1, 3])
    theta = np.zeros(shape.size)
    loss, _ = M.loss_and_gradient(theta, shape, np.ones((2, 1)), np.array([[0, 2], [1, -1]]), [1.0, 0.5])
    assert abs(loss - (2 * np.log(2) + 0.5 * np.log(3))) < 1e-12


def test_minimise_finds_the_minimum_of_a_bowl():
    a = np.diag([1.0, 10.0, 100.0])
    goal = np.array([1.0, -2.0, 3.0])
    got = M.minimise(lambda v: ((v - goal) @ a @ (v - goal), 2 * a @ (v - goal)), np.zeros(3), 100, 1e-14)
    assert np.allclose(got, goal, atol=1e-4)


def rows(spark, n=900, seed=1):
    """Seven tasks that depend on products and signs of features, so that no linear model has them all."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    labels = [
        (x[:, 0] > 0).astype(int), (x[:, 0] * x[:, 1] > 0).astype(int), np.digitize(x[:, 2], [-0.5, 0.5]), (x[:, 3] + x[:, 4] > 1).astype(int),
        np.digitize(x[:, 0] + x[:, 2], [-1, 0, 1]), (np.abs(x[:, 1]) > 0.7).astype(int), 2 * (x[:, 0] > 0) + (x[:, 3] > 0),
    ]
    out = [(i, x[i].tolist(), *[f"c{v[i]}" for v in labels]) for i in range(n)]
    return spark.createDataFrame(out, "id bigint, x array<double>, " + ", ".join(f"t{i} string" for i in range(7))).repartition(6)


TASKS = [f"t{i}" for i in range(7)]


def test_seven_heads_from_one_fit_beat_majorities(spark):
    data = rows(spark)
    train, test = data.where("id % 3 > 0"), data.where("id % 3 = 0")
    model = M.shared_fit(train, TASKS, "x", hidden=16)
    assert model.shape.logits == [1, 1, 3, 1, 4, 1, 4]
    got = {r.task: r for r in score_tasks(M.shared_predict(model, test, "id", "x"), TASKS).collect()}
    for t in TASKS:
        most = train.groupBy(t).count().orderBy(F.desc("count")).first()[0]
        majority = test.where(F.col(t) == most).count() / test.count()
        assert got[t].accuracy > majority + 0.05 and got[t].mcc > 0.5, (t, got[t])
    again = M.shared_fit(train.repartition(3), TASKS, "x", hidden=16, steps=3)
    first = M.shared_fit(train, TASKS, "x", hidden=16, steps=3)
    assert np.allclose(again.theta, first.theta, atol=1e-6)  # the same on any partitioning


def test_weights_favour_a_task(spark):
    data = rows(spark, 300)
    opposed = data.select("id", "x", "t0", F.when(F.col("t0") == "c0", "c1").otherwise("c0").alias("not"))
    noisy = opposed.withColumn("rare", F.when(F.col("id") % 7 == 0, "a").otherwise("b"))
    kept = {"features": "x", "hidden": 1, "penalty": 0.01}
    even = M.shared_fit(noisy, ["t0", "rare"], **kept)
    tilted = M.shared_fit(noisy, ["t0", "rare"], weights={"t0": 0.01, "rare": 1.0}, **kept)
    accuracy = lambda m: score_tasks(M.shared_predict(m, noisy, "id", "x"), ["t0"]).first().accuracy
    assert accuracy(even) > accuracy(tilted)


def test_missing_labels_single_classes_and_no_rows(spark):
    data = rows(spark, 200).withColumns({"one": F.lit("same"), "none": F.lit(None).cast("string"), "t1": F.when(F.col("id") % 2 == 0, F.col("t1"))})
    train = data.where("id < 150 AND t2 <> 'c2'")
    model = M.shared_fit(train, ["t0", "t1", "t2", "one", "none"], "x", hidden=8, steps=20)
    got = M.shared_predict(model, data, "id", "x").collect()
    assert len(got) == 200
    assert {r.one_pred for r in got} == {"same"} and {r.none_pred for r in got} == {None}
    assert {r.t2_pred for r in got} <= {"c0", "c1"} and {r.t1_pred for r in got} <= {"c0", "c1"}
    assert M.shared_predict(model, data.limit(0), "id", "x").count() == 0
    alone = M.shared_fit(train, ["one"], "x")
    assert {r.one_pred for r in M.shared_predict(alone, data, "id", "x").collect()} == {"same"}
    with pytest.raises(ValueError, match="no training rows"):
        M.shared_fit(train.limit(0), ["t0"], "x")
