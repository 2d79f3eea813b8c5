"""Classification metrics, all from one confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranks import average_ranks

METRICS = ("accuracy", "precision", "recall", "f1", "gmean", "mcc")


def confusion(
    predictions: DataFrame, keys: Sequence[str], truth: str = "truth", pred: str = "pred"
) -> DataFrame:
    """Counts by keys, truth and prediction."""
    return (
        predictions.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys and label: support ``t``, predicted ``p``, hits ``tp``, precision, recall, F1.

    Labels are the union of true and predicted ones. A score with nothing to divide by is 0.
    """
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")),
    )
    sums = (
        table.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    )
    return sums.select(
        "*",
        _ratio(F.col("tp"), F.col("p")).alias("precision"),
        _ratio(F.col("tp"), F.col("t")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("p") + F.col("t")).alias("f1"),
    )


def _mcc(c: Column, s: Column, pt: Column, pp: Column, tt: Column) -> Column:
    c, s, pt, pp, tt = (x.cast("double") for x in (c, s, pt, pp, tt))
    left, right = s * s - pp, s * s - tt
    return F.when((left > 0) & (right > 0), (c * s - pt) / (F.sqrt(left) * F.sqrt(right))).otherwise(0.0)


def _squares(a: str, b: str) -> Column:
    # Products of counts pass BIGINT on very large tables, so they are summed as doubles.
    return F.sum(F.col(a).cast("double") * F.col(b).cast("double"))


def score_confusion(table: DataFrame, keys: Sequence[str], average: str = "macro") -> DataFrame:
    """Accuracy, precision, recall, F1, g-mean and multiclass MCC per keys.

    ``average``: ``macro``, ``weighted`` (by support), ``micro``, or ``binary`` (label 1 only).
    The g-mean is the root of precision times recall.
    """
    per_label = class_scores(table, keys)
    if average == "macro":
        p, r, f = F.avg("precision"), F.avg("recall"), F.avg("f1")
    elif average == "weighted":
        p, r, f = (F.sum(F.col(m) * F.col("t")) / F.sum("t") for m in ("precision", "recall", "f1"))
    elif average == "micro":
        p = r = f = F.sum("tp") / F.sum("t")
    elif average == "binary":
        positive = F.col("label").cast("string") == "1"
        p, r, f = (
            F.coalesce(F.max(F.when(positive, F.col(m))), F.lit(0.0))
            for m in ("precision", "recall", "f1")
        )
    else:
        raise ValueError(f"unknown average: {average}")
    out = per_label.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("t")).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        f.alias("f1"),
        _mcc(
            F.sum("tp"), F.sum("t"), _squares("p", "t"), _squares("p", "p"), _squares("t", "t")
        ).alias("mcc"),
    )
    return out.select(
        *keys,
        "accuracy",
        "precision",
        "recall",
        "f1",
        F.sqrt(F.col("precision") * F.col("recall")).alias("gmean"),
        "mcc",
    )


def score(
    predictions: DataFrame,
    keys: Sequence[str] = (),
    truth: str = "truth",
    pred: str = "pred",
    average: str = "macro",
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Named metrics per keys, straight from predictions."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    out = score_confusion(confusion(predictions, keys, truth, pred), keys, average)
    return out.select(*keys, *metrics)


def score_tasks(
    predictions: DataFrame, tasks: Sequence[str], keys: Sequence[str] = (), suffix: str = "_pred"
) -> DataFrame:
    """One row per keys and task, from one column pair per task."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(t).alias("task"),
                F.col(t).cast("string").alias("truth"),
                F.col(t + suffix).cast("string").alias("pred"),
            )
            for t in tasks
        ]
    )
    return score(predictions.select(*keys, F.inline(pairs)), [*keys, "task"])


def overall_scores(per_task: DataFrame, keys: Sequence[str] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """Mean of every metric over the tasks; ``weights`` (normalised) may favour tasks."""
    if not weights:
        return per_task.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])
    w = F.coalesce(F.element_at(F.create_map(*[x for t, v in weights.items() for x in (F.lit(t), F.lit(float(v)))]), F.col("task")), F.lit(1.0))
    return per_task.groupBy(*keys).agg(*[(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in METRICS])


# Short metric names of the wide report, in its column order.
WIDE_NAMES = {"accuracy": "acc", "precision": "prec", "recall": "rec", "f1": "f1", "gmean": "gmean", "mcc": "mcc"}


def wide_report(per_task: DataFrame, tasks: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Export form: overall means plus ``<task>_<metric>`` columns, one row per keys."""
    cells = [
        F.max(F.when(F.col("task") == t, F.col(m))).alias(f"{t}_{WIDE_NAMES[m]}")
        for t in tasks
        for m in METRICS
    ]
    means = [F.avg(m).alias("f1-score" if m == "f1" else m) for m in METRICS]
    return per_task.filter(F.col("task").isin(*tasks)).groupBy(*keys).agg(*means, *cells)


def auc_ovr(scores: DataFrame, keys: Sequence[str], label: str, positive: str, value: str) -> DataFrame:
    """Area under the ROC curve per keys and class, from average-tie ranks.

    ``scores`` is long: one row per keys, class (``label``), observation; ``positive`` is 0/1 and
    ``value`` the score of the class. 0 and ``defined = false`` when one side is empty.
    """
    keys = [*keys, label]
    work = scores.select(
        *keys,
        value,
        F.col(positive).cast("bigint").alias("n1"),
        (1 - F.col(positive)).cast("bigint").alias("n0"),
    )
    ranked = average_ranks(work, value, ["n1", "n0"], keys)
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0")
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    area = (F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0)
    defined = (n1 > 0) & (n0 > 0)
    return sums.select(*keys, F.when(defined, area).otherwise(0.0).alias("auc"), defined.alias("defined"))


def auc_macro(per_class: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the class areas; 0 for the whole group when one class has no area."""
    return per_class.groupBy(*keys).agg(
        F.when(F.bool_and("defined"), F.avg("auc")).otherwise(0.0).alias("auc")
    )
