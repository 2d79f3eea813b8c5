"""Whole experiments: validate a grid, select, test, and compare models across problems."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.labels import binarise
from riskloom.operators.metrics import METRICS, auc_macro, auc_ovr, score
from riskloom.operators.models import PARAMETERS, fit_job, fit_predict
from riskloom.operators.neighbours import nearest
from riskloom.operators.resample import LADDER, LADDER_ALL, oversample_random, oversample_smote
from riskloom.operators.aggregates import best_per_group, smallest_class
from riskloom.operators.results import fold_means
from riskloom.session import materialise, scratch_path
from riskloom.sources.models import save_model
from riskloom.sources.schemas import RESULTS

SETTINGS = ["problem", "fold", "classifier", "parameters", "resampling"]


def resample(train: DataFrame, method: str, label: str, id: str, features: str) -> DataFrame:
    """``none``, ``over`` (random copies) or ``over+_k`` (rows between neighbours)."""
    if method == "none":
        return train
    if method == "over":
        return oversample_random(train, label, id)
    return oversample_smote(train, label, id, features, int(method.rpartition("_")[2]))


def samplings(train: DataFrame, label: str, asked: Sequence[str]) -> list[str]:
    """Resampling methods that the training labels allow; ``over+`` stands for its ladder."""
    out = [s for s in asked if s != "over+"]
    if "over+" in asked:
        smallest = smallest_class(train, label).first()["smallest"]
        ks = next((ks for top, ks in LADDER if smallest <= top), LADDER_ALL)
        out += [f"over+_{k}" for k in ks]
    return out


def job_key(job: dict, role: str) -> str:
    """Name of a job in a store: the same settings give the same name."""
    return "j" + hashlib.md5("|".join([role, *[str(job[s]) for s in SETTINGS]]).encode()).hexdigest()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of a store with its jobs' folders; empty if there are none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, job string")
    return spark.read.schema(f"{schema}, job string").parquet(path)


MANIFEST = "role string, problem string, fold int, classifier string, parameters string, resampling string, train_time double, pred_time double"


def finished(spark: SparkSession, store: str) -> DataFrame:
    """Manifest of a store: one row per finished job, with its settings and times."""
    return _read(spark, f"{store}/manifest", MANIFEST)


def results(spark: SparkSession, store: str, role: str, jobs: Sequence[str] | None = None) -> DataFrame:
    """Metrics of the finished jobs of a role, AUC included, with settings and times; one job over the stored tables.

    Predictions and class scores are read from the store, so nothing is fitted again.
    """
    done = finished(spark, store).filter(F.col("role") == role)
    if jobs is not None:
        # As many names as the grid has jobs.
        done = done.join(F.broadcast(spark.createDataFrame([(j,) for j in jobs], "job string")), "job", "left_semi")
    done = materialise(done, "manifest")
    kept = lambda df: df.join(F.broadcast(done.select("job")), "job", "left_semi")  # noqa: E731  a row per job
    metrics = score(kept(_read(spark, f"{store}/predictions", "truth string, pred string")), ["job"])
    scores = kept(_read(spark, f"{store}/scores", "class string, positive int, score double"))
    areas = auc_macro(auc_ovr(scores, ["job"], "class", "positive", "score"), ["job"])
    rows = done.join(metrics, "job").join(areas, "job", "left")
    return rows.select(*SETTINGS, *METRICS, F.coalesce("auc", F.lit(0.0)).alias("auc"), "train_time", "pred_time")


def result_rows(scores: DataFrame, feature_type: str = "-", feature_scope: str = "-", token: str = "-") -> DataFrame:
    """Scores of a grid in the columns of the results table."""
    dims = {"partition": F.col("fold").cast("string"), "feature_type": F.lit(feature_type), "feature_scope": F.lit(feature_scope), "token": F.lit(token)}
    return scores.withColumns(dims).select(*StructType.fromDDL(RESULTS).names)


class _Search:
    """Neighbours for all ``knn`` jobs on the same rows: each metric is searched once, for the most that a job asks.

    The first job that comes starts the search, and the others wait for it.
    """

    def __init__(self, most: dict[str, int]):
        self.most, self.found = most, {}
        self.locks = {metric: threading.Lock() for metric in most}

    def __call__(self, queries: DataFrame, train: DataFrame, k: int, *, metric: str, **names) -> DataFrame:
        with self.locks[metric]:
            if metric not in self.found:
                self.found[metric] = materialise(nearest(queries, train, self.most[metric], metric=metric, **names), "neighbours")
        return self.found[metric].filter(F.col("rank") <= k)


def _searches(jobs: Sequence[dict]) -> dict[tuple, _Search]:
    """A search for the ``knn`` jobs of each problem, fold and sampling."""
    most: dict[tuple, dict[str, int]] = {}
    for j in jobs:
        if j["classifier"] == "knn":
            k, _, norm = j["parameters"].split("-")
            ks = most.setdefault((j["problem"], j["fold"], j["resampling"]), {})
            ks[f"l{norm}"] = max(int(k), ks.get(f"l{norm}", 0))
    return {key: _Search(ks) for key, ks in most.items()}


def _run(
    jobs: list[dict], data: DataFrame, store: str, id: str, features: str, role: str, threads: int, keep_models: bool
) -> DataFrame:
    """Fit every job that the store has not finished, keep what it predicts, and score all of them at once.

    A job leaves predictions and class scores in folders of its own, its model if it is a saved one, and last its line
    in the manifest: a run that was killed starts again at the jobs without one, whose folders are overwritten.
    Each fit is a Spark job of its own; a few run at the same time so that the cluster stays busy. Fitting and
    predicting are timed apart; jobs that share a search of neighbours each count the time until it is there.
    """
    spark = data.sparkSession
    # One row per job of the grid.
    done = {r["job"] for r in finished(spark, store).select("job").collect()}
    names = [job_key(j, role) for j in jobs]
    pending = [(n, j) for n, j in zip(names, jobs, strict=True) if n not in done]
    trains: dict[tuple, DataFrame] = {}
    for _, j in pending:
        key = (j["problem"], j["fold"], j["resampling"])
        if key not in trains:
            rows = data.filter((F.col("fold") == j["fold"]) & (F.col("role") == "train")).drop("fold", "role")
            trains[key] = materialise(resample(rows, j["resampling"], j["problem"], id, features), "resampled")

    searches = _searches([j for _, j in pending])

    def one(named: tuple[str, dict]) -> None:
        name, j = named
        held = data.filter((F.col("fold") == j["fold"]) & (F.col("role") == role))
        key = (j["problem"], j["fold"], j["resampling"])
        started = time.time()
        fitted = fit_job(j["classifier"], j["parameters"].split("-"), trains[key], id, features, j["problem"], searches.get(key, nearest))
        ready = time.time()
        pred, scores = fitted.predict(held)
        pred.write.mode("overwrite").parquet(f"{store}/predictions/job={name}")
        predicted = time.time()
        scores.write.mode("overwrite").parquet(f"{store}/scores/job={name}")
        if keep_models and fitted.model is not None:
            save_model(fitted.model, f"{store}/models/{name}")
        line = (role, *[j[s] for s in SETTINGS], ready - started, predicted - ready)
        cells = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(line, StructType.fromDDL(MANIFEST), strict=True)]
        spark.range(1).coalesce(1).select(*cells).write.mode("overwrite").parquet(f"{store}/manifest/job={name}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, pending))
    return results(spark, store, role, names)


def validate_grid(
    data: DataFrame, problems: Sequence[str], id: str, features: str = "features",
    grid: dict[str, Sequence[Sequence[str]]] | None = None, resampling: Sequence[str] = ("none", "over", "over+"),
    threads: int = 4, role: str = "val", store: str | None = None, keep_models: bool = True,
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Score every parameter set, algorithm and sampling on one role of every fold.

    ``data`` holds id, features, one label column per problem, ``fold`` and ``role``. Predictions, class scores,
    models and a manifest are kept under ``store`` (a folder all executors can reach; a scratch folder if none is
    given), and one metrics job over them scores the whole grid. Called again with the same store, only jobs
    that it has not finished are run. ``extract`` makes the feature column from the rows first, once for all jobs.
    """
    data = materialise(extract(data) if extract else data, "experiment")
    folds = [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]
    jobs = []
    for problem in problems:
        for fold in folds:
            train = data.filter((F.col("fold") == fold) & (F.col("role") == "train"))
            for method in samplings(train, problem, resampling):
                for alg, sets in (grid or PARAMETERS).items():
                    jobs += [
                        {"problem": problem, "fold": fold, "classifier": alg, "parameters": "-".join(p), "resampling": method}
                        for p in sets
                    ]
    return _run(jobs, data, store or scratch_path(data.sparkSession, "store"), id, features, role, threads, keep_models)


def select_then_test(
    data: DataFrame, validated: DataFrame, id: str, features: str = "features", threads: int = 4,
    store: str | None = None, keep_models: bool = True,
) -> DataFrame:
    """Refit the best validated parameters of every configuration on train only; score on test."""
    data = materialise(data, "experiment")
    by = ["problem", "fold", "classifier", "resampling"]
    # One row per configuration, as many as the grid has.
    best = best_per_group(validated, by, ["parameters"]).select(*SETTINGS).collect()
    folder = store or scratch_path(data.sparkSession, "store")
    return _run([r.asDict() for r in best], data, folder, id, features, "test", threads, keep_models)


def evaluate_one_task(
    data: DataFrame, label: str, id: str, algorithms: dict[str, Sequence[str]], features: str = "features"
) -> DataFrame:
    """Score one model of all classes (with ``-``) as a binary and as a multiclass model.

    Per fold and algorithm the combined model is compared with a model trained for the narrower
    problem: all rows with binary labels, and only rows with a class. Differences are averaged
    over folds. Binary scores use F1 of class 1, multiclass scores the weighted F1.
    """
    data = materialise(data.withColumn("_two", binarise(label).cast("string")), "onetask")
    folds = [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]
    tables = []
    for fold in folds:
        rows = data.filter(F.col("fold") == fold)
        train, test = (rows.filter(F.col("role") == r).drop("fold", "role") for r in ("train", "test"))
        known, known_test = train.filter(F.col(label) != "-"), test.filter(F.col(label) != "-")
        for alg, params in algorithms.items():
            both = materialise(fit_predict(alg, params, train, test, id, features, label), "combined")
            two = both.select(id, *[binarise(c).cast("string").alias(c) for c in ("truth", "pred")])
            many = both.filter(F.col("truth") != "-")
            sides = {
                ("binary", "one"): two,
                ("binary", "own"): fit_predict(alg, params, train, test, id, features, "_two"),
                ("multiclass", "one"): many,
                ("multiclass", "own"): fit_predict(alg, params, known, known_test, id, features, label),
            }
            for (comparison, kind), pred in sides.items():
                tables.append(
                    pred.select("truth", "pred").withColumns(
                        {"comparison": F.lit(comparison), "kind": F.lit(kind), "fold": F.lit(fold), "classifier": F.lit(alg)}
                    )
                )
    everything = tables[0]
    for t in tables[1:]:
        everything = everything.unionByName(t)
    everything = materialise(everything, "onetaskpred")
    keys = ["comparison", "kind", "fold", "classifier"]
    binary = score(everything.filter("comparison = 'binary'"), keys, average="binary", metrics=["f1", "mcc"])
    multi = score(everything.filter("comparison = 'multiclass'"), keys, average="weighted", metrics=["f1", "mcc"])
    both = binary.unionByName(multi)
    one = both.filter("kind = 'one'").drop("kind")
    own = both.filter("kind = 'own'").select("comparison", "fold", "classifier", F.col("f1").alias("_f"), F.col("mcc").alias("_m"))
    joined = one.join(own, ["comparison", "fold", "classifier"]).select(
        "comparison", "classifier", "f1", (F.col("f1") - F.col("_f")).alias("f1_diff"), "mcc", (F.col("mcc") - F.col("_m")).alias("mcc_diff")
    )
    return fold_means(joined, ["comparison", "classifier"], ["f1", "f1_diff", "mcc", "mcc_diff"])


def metric_record(scores: DataFrame, columns: Sequence[str] = (*METRICS, "auc", "train_time", "pred_time")) -> DataFrame:
    """Scores as one JSON text per row, for export."""
    kept = [c for c in columns if c in scores.columns]
    return scores.withColumn("results", F.to_json(F.struct(*kept))).drop(*kept)
