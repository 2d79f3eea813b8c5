"""Analyses of experiment results: fold averages, selection, transfer, and vector comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.cvss import vector_parts
from riskloom.operators.aggregates import best_per_group, worst_per_group
from riskloom.operators.metrics import score
from riskloom.operators.reshape import melt_results
from riskloom.session import materialise

# Columns of the result table.
CONFIG = ["feature_type", "feature_scope", "token"]
DIMENSIONS = ["problem", *CONFIG, "resampling", "classifier"]
MEASURES = ["accuracy", "precision", "recall", "gmean", "auc", "f1", "mcc", "train_time", "pred_time"]

# Classical classifier columns of the combined report.
ML_CLASSIFIERS = ["LR", "KNN", "SVM", "RF", "LGBM", "XGB"]
# Network columns of the combined report. The perceptron's column goes by a person's name;
# callers who have it pass their own families.
DL_CLASSIFIERS = ["Sequential CNN", "Sequential RNN", "Siamese CNN", "Siamese (MLP)"]


def _mean(column: str):
    """Mean without NULL and NaN."""
    return F.avg(F.when(~F.isnan(column), F.col(column)))


def umbrella(df: DataFrame) -> DataFrame:
    """Each row once under its own sampling, and rows sampled with any k also under ``over+``."""
    s = F.col("resampling")
    levels = F.when(s.rlike(r"^over\+_"), F.array(s, F.lit("over+"))).otherwise(F.array(s))
    return df.withColumn("resampling", F.explode(levels))


def average_folds(
    results: DataFrame, measures: Sequence[str] = MEASURES, by: Sequence[str] = DIMENSIONS, levels: bool = True
) -> DataFrame:
    """Mean of every measure per configuration, without the holdout; parameters are averaged over.

    One aggregation covers every combination of dimensions. With ``levels`` the sampling
    ``over+`` stands for all its k.
    """
    folds = results.filter(F.col("partition") != "holdout")
    if levels:
        folds = umbrella(folds)
    means = [_mean(m).alias(m) for m in measures]
    return folds.groupBy(*by).agg(F.avg(F.col("partition").try_cast("double")).alias("partition"), *means)


def fold_means(results: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Plain means per group."""
    return results.groupBy(*by).agg(*[_mean(m).alias(m) for m in measures])


def umbrella_levels(results: DataFrame, measure: str = "mcc") -> DataFrame:
    """Mean by problem, classifier and sampling, with totals over each of them.

    A row counts once in every mean: under its own sampling, under ``over+`` if it was sampled with any k,
    and under ``all``; problems and classifiers are totalled within a sampling level.
    """
    s = F.col("resampling")
    levels = F.when(s.rlike(r"^over\+_"), F.array(s, F.lit("over+"), F.lit("all"))).otherwise(F.array(s, F.lit("all")))
    shown = results.select("problem", "classifier", measure, F.explode(levels).alias("_level"))
    return (
        shown.cube("problem", "classifier", "_level")
        .agg(
            _mean(measure).alias(measure),
            F.count(F.lit(1)).alias("n"),
            F.when(F.grouping("classifier") == 1, "all").otherwise(F.col("classifier")).alias("classifier_level"),
            F.when(F.grouping("problem") == 1, "overall").otherwise(F.col("problem")).alias("problem_level"),
            F.grouping("_level").alias("_total"),
        )
        .where(F.col("_total") == 0)
        .select(
            F.col("problem_level").alias("problem"), F.col("classifier_level").alias("classifier"),
            F.col("_level").alias("resampling"), measure, "n",
        )
    )


def best_parameters(validated: DataFrame, by: Sequence[str], order: Sequence[str] = ("parameters",)) -> DataFrame:
    """The best validated row per configuration; no row means nothing to test."""
    return best_per_group(validated, by, order)


def best_iteration(history: DataFrame, keys: Sequence[str], metric: str, step: str) -> DataFrame:
    """The step with the best validation metric per run; the earliest on ties."""
    return best_per_group(history, keys, [step], metric)


def transfer_folds(
    results: DataFrame, measures: Sequence[str] = ("accuracy", "precision", "recall", "gmean", "f1", "mcc"),
    source: str = "binary", target: str = "multiclass",
) -> DataFrame:
    """The best configuration of one problem applied to another.

    Per feature set and classifier (and for all classifiers together, as ``all_(name)``): the
    target's result at the source's best parameters, its distance to the target's own best, and
    the best-to-worst spread of both problems.
    """
    folds = results.filter(F.col("partition") != "holdout")
    by = ["problem", *CONFIG, "classifier", "parameters"]
    means = materialise(average_folds(folds, measures, by, levels=False), "means")
    level = F.explode(F.array(F.col("classifier"), F.lit("all"))).alias("group")
    means = means.select("*", level)
    keys = [*CONFIG, "group"]
    ties = ["classifier", "parameters"]

    def ends(problem: str, tag: str) -> DataFrame:
        rows = means.filter(F.col("problem") == problem)
        best = best_per_group(rows, keys, ties).select(
            *keys,
            F.col("classifier").alias(f"{tag}_classifier"), F.col("parameters").alias(f"{tag}_parameters"),
            F.col("f1").alias(f"{tag}_f1"), F.col("mcc").alias(f"{tag}_mcc"),
        )
        worst = worst_per_group(rows, keys, ties).select(
            *keys, F.col("f1").alias(f"{tag}_f1_low"), F.col("mcc").alias(f"{tag}_mcc_low")
        )
        return best.join(worst, keys)

    pair = ends(source, "s").join(ends(target, "t"), keys)
    hit = means.filter(F.col("problem") == target).withColumnsRenamed(
        {"classifier": "s_classifier", "parameters": "s_parameters"}
    )
    found = pair.join(hit, [*keys, "s_classifier", "s_parameters"])
    name = F.when(F.col("group") == "all", F.format_string("all_(%s)", "s_classifier")).otherwise(
        F.col("s_classifier")
    )
    return found.select(
        "problem", *CONFIG, name.alias("classifier"), F.col("s_parameters").alias("parameters"), "partition", *measures,
        (F.col("f1") - F.col("t_f1")).alias("f1_difference"),
        (F.col("mcc") - F.col("t_mcc")).alias("mcc_difference"),
        (F.col("t_mcc") - F.col("t_mcc_low")).alias(f"{target}_mcc_spread"),
        (F.col("t_f1") - F.col("t_f1_low")).alias(f"{target}_f1_spread"),
        (F.col("s_mcc") - F.col("s_mcc_low")).alias(f"{source}_mcc_spread"),
        (F.col("s_f1") - F.col("s_f1_low")).alias(f"{source}_f1_spread"),
    )


Families = dict[str, Sequence[str] | None]


def _by_family(long: DataFrame, families: Families) -> DataFrame:
    """Each row under its family and under ``all``. A family without members holds the rest."""
    named = [m for members in families.values() if members for m in members]
    classifier = F.col("classifier")
    names = [
        F.when(classifier.isin(*members) if members else ~classifier.isin(*named), F.lit(f))
        for f, members in families.items()
    ]
    labels = F.filter(F.array(*names, F.lit("all")), lambda n: n.isNotNull())
    return long.select("*", F.explode(labels).alias("family"))


def optimal_classifiers(
    wide: DataFrame, ids: Sequence[str] = ("task", "feature_type", "feature_scope", "token"),
    families: Families | None = None,
) -> DataFrame:
    """Best classifier per configuration and family, and whether the other task has the same best."""
    families = families or {"ml": ML_CLASSIFIERS, "dl": DL_CLASSIFIERS}
    long = _by_family(melt_results(wide, ids), families)
    best = best_per_group(long, [*ids, "family"], ["classifier"])
    config = [c for c in ids if c != ids[0]]
    fams = [*families, "all"]
    # One row per configuration: a column pair per family.
    cols = [
        F.max(F.when(F.col("family") == f, F.col(c))).alias(f"{c}_{f}") for f in fams for c in ("classifier", "mcc")
    ]
    merged = materialise(best.groupBy(*ids).agg(*cols), "best")
    other = merged.select(
        *[F.col(c).alias(f"_c_{c}") for c in config], F.col(ids[0]).alias("_task"),
        *[F.col(f"classifier_{f}").alias(f"_o_{f}") for f in fams],
    )
    # Every configuration stays; one that the other task lacks has no best in common with it.
    alike = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in config]
    paired = merged.join(other, reduce(lambda x, y: x & y, alike, F.col(ids[0]) != F.col("_task")), "left")
    same = [
        F.when(F.col(f"classifier_{f}") == F.col(f"_o_{f}"), "Yes").otherwise("No").alias(f"{f}_same") for f in fams
    ]
    return paired.select(*merged.columns, *same)


def transfer_table(
    wide: DataFrame, source: str = "Binary", target: str = "Multiclass",
    ids: Sequence[str] = ("task", "feature_type", "feature_scope", "token"),
    families: Families | None = None,
) -> DataFrame:
    """Per configuration and family: the target's best MCC and its MCC with the source's best classifier."""
    families = families or {"ml": ML_CLASSIFIERS, "dl": DL_CLASSIFIERS}
    long = materialise(_by_family(melt_results(wide, ids), families), "families")
    keys = [*[c for c in ids if c != ids[0]], "family"]
    first = best_per_group(long.filter(F.col(ids[0]) == source), keys, ["classifier"])
    goal = long.filter(F.col(ids[0]) == target)
    top = goal.groupBy(*keys).agg(F.max("mcc").alias("max_mcc"))
    # A configuration that the source or the target lacks keeps its row, with NULL for what is not there.
    moved = first.select(*keys, "classifier").join(goal.select(*keys, "classifier", "mcc"), [*keys, "classifier"], "left")
    return top.join(moved, keys, "left").select(*keys, "classifier", "max_mcc", F.col("mcc").alias("transfer_mcc"))


def compare_vector(
    predictions: DataFrame, config: Sequence[str], vector_results: DataFrame, task_results: DataFrame
) -> DataFrame:
    """Score a predicted vector part by part against the single-task results.

    ``predictions`` holds ``truth`` and ``pred`` vectors per config; ``vector_results`` has f1 and
    mcc per config, ``task_results`` per config and ``task``. A missing single-task result counts 0.
    """
    parts = predictions.select(
        *config,
        F.inline(
            F.zip_with(
                vector_parts("truth"), vector_parts("pred"),
                lambda t, p: F.struct(t["task"].alias("task"), t["part"].alias("truth"), p["part"].alias("pred")),
            )
        ),
    )
    each = score(parts, [*config, "task"], metrics=["f1", "mcc"])
    each = each.withColumnsRenamed({"f1": "f1_individual", "mcc": "mcc_individual"})
    whole = vector_results.select(*config, "f1", "mcc")
    single = task_results.select(*config, "task", F.col("f1").alias("f1_task"), F.col("mcc").alias("mcc_task"))
    out = each.join(whole, list(config), "left").join(single, [*config, "task"], "left")
    return out.withColumns(
        {"f1_task": F.coalesce("f1_task", F.lit(0.0)), "mcc_task": F.coalesce("mcc_task", F.lit(0.0))}
    )
