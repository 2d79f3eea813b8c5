"""Classifiers as Spark ML estimators, and predictions as tables.

Every model ends in the same table: id, truth, pred (labels as text). Metrics read only that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.draws import draw_long
from riskloom.functions.vectors import as_vector
from riskloom.operators.aggregates import most_common
from riskloom.operators.neighbours import knn_vote, nearest
from riskloom.session import broadcast_if_small, materialise

# The parameter sets of the six classifiers.
PARAMETERS = {
    "lr": [(c,) for c in ("0.01", "0.1", "1", "10", "100")],
    "svm": [(c,) for c in ("0.1", "1", "10", "100", "1000", "10000")],
    "knn": [(k, w, p) for k in ("11", "31", "51") for w in ("uniform", "distance") for p in ("1", "2")],
    "rf": [(n, m) for n in ("100", "300", "500") for m in ("100", "200", "300")],
    "xgb": [(n, m) for n in ("100", "300", "500") for m in ("100", "200", "300")],
    "lgbm": [(n, m) for n in ("100", "300", "500") for m in ("100", "200", "300")],
}

# Cluster counts of the k-means baseline, and runs of the uniform baseline.
CLUSTERS = [*range(2, 11), *range(15, 51, 5)]
BASELINES = {"kmeans": [(str(n),) for n in CLUSTERS], "uniform": [(str(r),) for r in range(10)]}

SEED = 42

# No limit in practice: solvers stop by their tolerance.
UNLIMITED = 10_000
# Fixed value: iterations of one k-means run.
KMEANS_ITERATIONS = 300


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the RBF kernel ``exp(-gamma |x - y|^2)``.

    Weights are drawn from the seed inside the tasks, so nothing is broadcast.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    features = Param(Params._dummy(), "features", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the weights", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=1.0, features=256, seed=SEED):
        super().__init__()
        self._setDefault(gamma=1.0, features=256, seed=SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, width, seed = (self.getOrDefault(p) for p in (self.gamma, self.features, self.seed))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(batches: pd.Series) -> pd.Series:
            if not len(batches):
                return pd.Series([], dtype=object)
            x = np.stack([np.asarray(v, dtype="float64") for v in batches])
            rng = np.random.default_rng(seed)
            w = rng.normal(scale=math.sqrt(2 * gamma), size=(x.shape[1], width))
            b = rng.uniform(0, 2 * math.pi, size=width)
            return pd.Series(list(np.sqrt(2.0 / width) * np.cos(x @ w + b)))

        source, out = self.getInputCol(), self.getOutputCol()
        values = F.col(source)
        if isinstance(df.schema[source].dataType, VectorUDT):
            values = vector_to_array(source)
        return df.withColumn(out, array_to_vector(project(values)))


def scale_gamma(train: DataFrame, features: str) -> float:
    """One over (width times variance of all feature values)."""
    vectors = as_vector(train.select(features), features)
    # Sums and squared sums per feature; sparse vectors stay sparse.
    got = vectors.agg(Summarizer.metrics("count", "sum", "normL2").summary(F.col(features)).alias("s")).first()["s"]
    values = got["count"] * got["sum"].size
    mean = got["sum"].toArray().sum() / values
    variance = (got["normL2"].toArray() ** 2).sum() / values - mean**2
    return float(1.0 / (got["sum"].size * variance)) if variance > 0 else 1.0


def _depth(leaves: str) -> int:
    """Depth at which a full tree has at least the given leaves."""
    return math.ceil(math.log2(int(leaves)))


def classifier(
    alg: str, parameters: Sequence[str], rows: int, classes: int, layers: int = 0,
    features: str = "features", label: str = "_y", iterations: int | None = None,
) -> Estimator:
    """Spark ML estimator of a named algorithm.

    Logistic regression is multinomial for several classes; SVM and boosted trees are fitted one class
    against the rest. ``iterations`` limits the solvers; by default they run until they have converged
    (``UNLIMITED`` is only a guard), the perceptron 100 times.
    """
    columns = {"featuresCol": features, "labelCol": label}
    if alg == "lr":
        # C weighs the summed loss; Spark weighs the penalty of the mean loss.
        return LogisticRegression(regParam=1.0 / (float(parameters[0]) * rows), standardization=False, tol=1e-3, maxIter=iterations or UNLIMITED, family="auto", **columns)
    elif alg == "svm":
        one = LinearSVC(regParam=1.0 / (float(parameters[0]) * rows), standardization=False, tol=1e-3, maxIter=iterations or UNLIMITED, **columns)
    elif alg == "rf":
        return RandomForestClassifier(numTrees=int(parameters[0]), maxDepth=_depth(parameters[1]), seed=SEED, **columns)
    elif alg in ("xgb", "lgbm"):
        step = 0.3 if alg == "xgb" else 0.1
        one = GBTClassifier(maxIter=int(parameters[0]), maxDepth=_depth(parameters[1]), stepSize=step, seed=SEED, **columns)
    elif alg == "mlp":
        width = [int(p) for p in parameters]
        return MultilayerPerceptronClassifier(layers=[layers, *width, classes], seed=SEED, maxIter=iterations or 100, **columns)
    else:
        raise ValueError(f"unknown algorithm: {alg}")
    if classes > 2:
        one = OneVsRest(classifier=one, parallelism=4, **columns)
    return one


def fit(alg: str | Estimator, parameters: Sequence[str], train: DataFrame, features: str = "features", label: str = "label") -> PipelineModel:
    """Fit label index, classifier and label names as one pipeline. Classes are the training labels.

    ``alg`` is a name, or any Spark ML classifier with its settings made; ``parameters`` are then unused.
    """
    data = as_vector(train.withColumn(label, F.col(label).cast("string")), features)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(data)
    if len(index.labels) < 2:
        raise ValueError("training rows hold fewer than two classes")
    rows, width = data.count(), data.select(features).first()[0].size
    indexed = index.transform(data).select(features, "_y")
    stages = []
    if alg == "svm":
        stages = [FourierFeatures(inputCol=features, outputCol="_rff", gamma=scale_gamma(data, features))]
        # Projected once; the solver reads the table in every iteration.
        indexed = materialise(stages[0].transform(indexed), "projected")
        features = "_rff"
    if isinstance(alg, Estimator):
        one = alg.copy({alg.getParam("featuresCol"): features, alg.getParam("labelCol"): "_y"})
    else:
        one = classifier(alg, parameters, rows, len(index.labels), width, features)
    names = IndexToString(inputCol="prediction", outputCol="pred", labels=index.labels)
    return PipelineModel(stages=[*stages, one.fit(indexed.select(features, "_y")), names])


def batch_predict(model: Transformer, df: DataFrame, id: str, features: str = "features", label: str = "label") -> DataFrame:
    """Predictions of a fitted model: id, truth, pred."""
    data = as_vector(df.select(id, features, F.col(label).cast("string").alias("truth")), features)
    return model.transform(data).select(id, "truth", "pred")


def class_scores(model: PipelineModel, df: DataFrame, id: str, features: str = "features", label: str = "label") -> DataFrame:
    """Scores of a fitted model for every class: id, class, positive (0/1), score. ``auc_ovr`` takes them.

    The score is the probability where the model has one, else the raw score.
    """
    names = model.stages[-1].getLabels()
    data = as_vector(df.select(id, features, F.col(label).cast("string").alias("truth")), features)
    out = model.transform(data)
    values = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")
    rows = out.select(id, "truth", F.posexplode(values).alias("_at", "score"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_at") + 1)
    return rows.select(id, name.alias("class"), (F.col("truth") == name).cast("int").alias("positive"), "score")


def external_predict(
    df: DataFrame, make: Callable, column: str, batch_size: int = 256, output: str = "scores"
) -> DataFrame:
    """Class scores of an outside model, loaded once per Python worker and called in batches.

    ``make()`` returns a function from a (rows, features) array to a (rows, classes) array.
    """
    from pyspark.ml.functions import predict_batch_udf

    size = df.select(F.size(column)).first()[0]
    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[size]])
    return df.withColumn(output, udf(F.col(column).cast("array<float>")))


@dataclass
class Fitted:
    """A fitted job of any algorithm.

    ``predict`` takes test rows and gives two tables from one pass over them: predictions (id, truth, pred) and class
    scores (id, class, positive, score) for every training class. ``model`` is what can be saved, if anything.
    """

    predict: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    model: PipelineModel | None = None


def _long_scores(rows: DataFrame, id: str, names: Sequence[str]) -> DataFrame:
    """``rows`` (id, truth, scores: an array in the order of ``names``) with a row for each class."""
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("_at"))
    out = rows.select(id, "truth", F.posexplode("scores").alias("_at", "score")).withColumn("class", name)
    return out.select(id, "class", F.col("truth").eqNullSafe(F.col("class")).cast("int").alias("positive"), "score")


def knn_scores(neighbours: DataFrame, id: str, label: str, names: Sequence[str], weights: str = "uniform") -> DataFrame:
    """Share of the votes of each class: id, scores (an array in the order of ``names``); rules as in ``knn_vote``."""
    zero, weight = F.lit(0.0), F.lit(1.0)
    if weights == "distance":
        zero = F.when(F.col("distance") == 0, 1.0).otherwise(0.0)
        weight = F.when(F.col("distance") > 0, 1.0 / F.col("distance")).otherwise(0.0)
    # As many sums as there are classes.
    of = lambda v, n: F.coalesce(F.sum(F.when(F.col(label) == n, v)), F.lit(0.0))
    sums = neighbours.groupBy(id).agg(
        F.sum(zero).alias("_z"), F.sum(weight).alias("_w"), F.array(*[F.struct(of(zero, n).alias("z"), of(weight, n).alias("w")) for n in names]).alias("_c")
    )
    return sums.select(id, F.transform("_c", lambda c: F.when(F.col("_z") > 0, c["z"] / F.col("_z")).otherwise(c["w"] / F.col("_w"))).alias("scores"))


def fit_job(
    alg: str, parameters: Sequence[str], train: DataFrame, id: str, features: str = "features", label: str = "label",
    search: Callable = nearest,
) -> Fitted:
    """Fit any algorithm; what it learns is computed before this returns, so that it can be timed apart.

    ``search`` finds the neighbours of ``knn``: the exact mode, or ``nearest`` of a candidate index. A row whose
    cells hold no training row takes the commonest training label.
    """
    rows = train.withColumn(label, F.col(label).cast("string"))
    # A row per class.
    names = [r[0] for r in rows.select(label).dropna().distinct().orderBy(label).collect()]
    truth = lambda test: test.select(id, F.col(label).cast("string").alias("truth"))

    def certain(predict: Callable[[DataFrame], DataFrame]) -> Fitted:
        """Score 1 for the predicted class, 0 for the others."""

        def both(test: DataFrame) -> tuple[DataFrame, DataFrame]:
            pred = materialise(predict(test), "predicted")
            hit = F.array(*[(F.col("pred") == n).cast("double") for n in names])
            return pred, _long_scores(pred.select(id, "truth", hit.alias("scores")), id, names)

        return Fitted(both)

    if alg == "knn":
        k, weights, norm = parameters
        held = rows.select(id, features, F.col(label).alias("_label"))
        common = most_common(held, [], "_label").first()

        def voted(test: DataFrame) -> tuple[DataFrame, DataFrame]:
            near = materialise(search(test, held, int(k), id=id, vector=features, metric=f"l{norm}", payload=["_label"]), "near")
            out = truth(test).join(knn_vote(near, id, "_label", weights), id, "left").join(knn_scores(near, id, "_label", names, weights), id, "left")
            none = F.array(*[F.lit(0.0) for _ in names])
            out = out.select(id, "truth", F.coalesce("pred", F.lit(common[0])).alias("pred"), F.coalesce("scores", none).alias("scores"))
            return out.drop("scores"), _long_scores(out, id, names)

        return Fitted(voted)
    if alg == "majority":
        # One row: the commonest training label.
        top = most_common(rows, [], label).first()[0]
        return certain(lambda test: truth(test).withColumn("pred", F.lit(top)))
    if alg == "kmeans":
        predict = fit_kmeans(train, int(parameters[0]), id, features, label)
        return certain(predict)
    if alg == "uniform":
        run = int(parameters[0])
        return certain(lambda test: uniform_baseline(train, test, label, id, run + 1).filter(F.col("run") == run).drop("run"))
    model = fit(alg, parameters, train, features, label)
    labels = model.stages[-1].getLabels()

    def scored(test: DataFrame) -> tuple[DataFrame, DataFrame]:
        data = as_vector(test.select(id, features, F.col(label).cast("string").alias("truth")), features)
        out = model.transform(data)
        values = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")
        out = materialise(out.select(id, "truth", "pred", values.alias("scores")), "predicted")
        return out.drop("scores"), _long_scores(out, id, labels)

    return Fitted(scored, model)


def fit_predict(
    alg: str, parameters: Sequence[str], train: DataFrame, test: DataFrame, id: str,
    features: str = "features", label: str = "label", search: Callable = nearest,
) -> DataFrame:
    """Train on one table and predict another, for any algorithm: id, truth, pred."""
    return fit_job(alg, parameters, train, id, features, label, search).predict(test)[0]


def uniform_baseline(
    train: DataFrame, test: DataFrame, label: str, id: str, runs: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Random predictions over the training labels, repeated: keys, id, truth, pred, run."""
    # One row per class and keys; the distinct labels of a task.
    labels = train.select(*keys, F.col(label).cast("string").alias("_l")).distinct()
    classes = labels.groupBy(*keys).agg(F.array_sort(F.collect_set("_l")).alias("_c"))
    numbered = test.select(*keys, id, F.col(label).cast("string").alias("truth"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    if keys:
        joined = numbered.join(broadcast_if_small(classes), list(keys))
    else:
        joined = numbered.withColumn("_c", F.array(*[F.lit(c) for c in classes.first()["_c"]]))
    pick = (draw_long(id, "run", seed=SEED) % F.size("_c")).cast("int")
    return joined.select(*keys, id, "run", "truth", F.get("_c", pick).alias("pred"))


def fit_kmeans(
    train: DataFrame, clusters: int, id: str, features: str = "features", label: str = "label",
    iterations: int = KMEANS_ITERATIONS, starts: int = 1,
) -> Callable[[DataFrame], DataFrame]:
    """Cluster the training rows, from the best of ``starts`` starts; predict the commonest label of the nearest cluster.

    A cluster without training rows falls back to the commonest label of all. The result takes test rows.
    """
    data = materialise(as_vector(train.select(features, F.col(label).cast("string").alias(label)), features), "kmeans")
    fitted = [KMeans(k=clusters, seed=s, maxIter=iterations, featuresCol=features, predictionCol="_cluster").fit(data) for s in range(starts)]
    model = min(fitted, key=lambda m: m.summary.trainingCost)
    # One row per cluster, so bounded by the argument.
    named = F.broadcast(materialise(most_common(model.transform(data), ["_cluster"], label).withColumnRenamed(label, "pred"), "clusters"))
    everywhere = most_common(data, [], label).first()[0]

    def predict(test: DataFrame) -> DataFrame:
        held = as_vector(test.select(id, features, F.col(label).cast("string").alias("truth")), features)
        found = model.transform(held).join(named, "_cluster", "left")
        return found.select(id, "truth", F.coalesce("pred", F.lit(everywhere)).alias("pred"))

    return predict


def majority_kmeans(
    train: DataFrame, test: DataFrame, clusters: int, id: str, features: str = "features", label: str = "label",
    iterations: int = KMEANS_ITERATIONS, starts: int = 1,
) -> DataFrame:
    """``fit_kmeans`` on one table and its predictions for another: id, truth, pred."""
    return fit_kmeans(train, clusters, id, features, label, iterations, starts)(test)


def multitask_fit(
    train: DataFrame, test: DataFrame, tasks: Sequence[str], id: str, features: str = "features",
    alg: str = "lr", parameters: Sequence[str] = ("1",),
) -> DataFrame:
    """One classifier per task over shared features, which are prepared once.

    Result: id and ``<task>``, ``<task>_pred`` per task. Two classes give a binary model, more a
    multiclass one; a task with one training class predicts it.
    """
    shared = materialise(as_vector(train.select(id, features, *tasks), features), "shared")
    held = materialise(as_vector(test.select(id, features, *tasks), features), "held")
    out = held.select(id, *[F.col(t).cast("string").alias(t) for t in tasks])
    for task in tasks:
        rows = shared.filter(F.col(task).isNotNull())
        few = rows.select(task).distinct().limit(2).count() < 2
        pred = fit_predict("majority" if few else alg, () if few else parameters, rows, held, id, features, task)
        out = out.join(pred.select(id, F.col("pred").alias(f"{task}_pred")), id)
    return out
