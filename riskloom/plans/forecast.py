"""Folds and the majority forecast: how well does the commonest class so far do next?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.aggregates import most_common, value_counts
from riskloom.operators.folds import (
    expanding_split,
    holdout_split,
    kfold_split,
    part_totals,
    random_folds,
    select_split,
    time_order,
)
from riskloom.operators.metrics import score_confusion
from riskloom.plans.registry import query
from riskloom.plans.views import CHANGES_SQL, ORDERED_SQL, PARTS_SQL, change_stream, commit_parts, part_sql

SPLIT_SQL = (
    PARTS_SQL
    + """,
roles AS (
  SELECT f.fold, p.commit, p.time_partition,
         CASE WHEN time_partition <= fold THEN 'train' WHEN time_partition = fold + 1 THEN 'val'
              WHEN time_partition = fold + 2 THEN 'test' END AS role
  FROM parts p, (SELECT CAST(i AS INTEGER) AS fold FROM range(10) r(i)) f
  WHERE time_partition <= fold + 2)"""
)


@query("time_order", f"WITH {ORDERED_SQL} SELECT commit, position FROM ordered")
def _time_order(spark: SparkSession, sf: str) -> DataFrame:
    return time_order(change_stream(spark, sf)).select("commit", "position")


@query(
    "time_folds",
    f"""WITH {PARTS_SQL} SELECT time_partition, count(*) AS n, min(position) AS first_position,
    max(position) AS last_position, min(commit) AS min_commit FROM parts GROUP BY ALL""",
)
def _time_folds(spark, sf):
    return part_totals(
        commit_parts(spark, sf), "time_partition", 12,
        first_position=(F.min, "position"), last_position=(F.max, "position"), min_commit=(F.min, "commit"),
    )


@query(
    "holdout_split",
    f"""WITH {ORDERED_SQL} SELECT commit, CASE WHEN position < floor(CAST(0.8 AS DOUBLE) * n) THEN 'train'
    WHEN position < floor(CAST(0.9 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS "set" FROM ordered""",
)
def _holdout(spark, sf):
    return holdout_split(time_order(change_stream(spark, sf))).select("commit", "set")


@query(
    "select_split",
    f"""WITH {ORDERED_SQL} SELECT count(*) AS n, min(date) AS first_date FROM ordered
    WHERE position < floor(CAST(0.9 AS DOUBLE) * n)""",
)
def _select_split(spark, sf):
    split = holdout_split(time_order(change_stream(spark, sf)))
    return select_split(split, "train", "val").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date")
    )


RANDOM_PARTS_SQL = f"""keyed AS (
  SELECT commit, row_number() OVER (ORDER BY md5(commit || '|42'), commit) - 1 AS position,
         count(*) OVER () AS n
  FROM (SELECT DISTINCT commit FROM changes)),
random_parts AS (SELECT commit, {part_sql(10)} AS "partition" FROM keyed)"""
RANDOM_SQL = f"{CHANGES_SQL}, {RANDOM_PARTS_SQL}"


@query("random_folds", f'WITH {RANDOM_SQL} SELECT commit, "partition" FROM random_parts')
def _random_folds(spark, sf):
    return random_folds(change_stream(spark, sf))


def _role_totals(split: DataFrame) -> DataFrame:
    """Counts and first commits per fold and role; folds multiply the totals of parts, not commits."""
    return split.groupBy("fold", "role").agg(F.sum("n").alias("n"), F.min("first_commit").alias("first_commit"))


@query(
    "kfold_split",
    f"""WITH {RANDOM_SQL} SELECT CAST(f.i AS INTEGER) AS fold, CASE WHEN "partition" = f.i THEN 'test' ELSE 'train' END AS role,
    count(*) AS n, min(commit) AS first_commit FROM random_parts, range(10) f(i) GROUP BY ALL""",
)
def _kfold(spark, sf):
    parts = part_totals(random_folds(change_stream(spark, sf)), "partition", 10, first_commit=(F.min, "commit"))
    return _role_totals(kfold_split(parts))


@query(
    "expanding_split",
    f"WITH {SPLIT_SQL} SELECT fold, role, count(*) AS n, min(commit) AS first_commit FROM roles GROUP BY ALL",
)
def _expanding(spark, sf):
    parts = part_totals(commit_parts(spark, sf), "time_partition", 12, first_commit=(F.min, "commit"))
    return _role_totals(expanding_split(parts))


FORECAST_SQL = (
    SPLIT_SQL
    + """,
labelled AS (SELECT fold, role, priority AS label FROM roles JOIN changes USING (commit)),
seen AS (SELECT fold, label, count(*) AS n FROM labelled WHERE role = 'train' GROUP BY ALL),
commonest AS (
  SELECT fold, label AS pred FROM seen
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, label) = 1),
predictions AS (
  SELECT fold, label AS truth, pred FROM labelled JOIN commonest USING (fold) WHERE role = 'test')"""
)


def metrics_sql(source: str, keys: str, average: str = "macro") -> str:
    """CTEs ``counts``, ``labels_of``, ``per_label`` and ``scored`` over a predictions relation."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({k}label)"
    join_keys = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    if average == "macro":
        p, r, f = "avg(prec)", "avg(rec)", "avg(f)"
    elif average == "weighted":
        p, r, f = "sum(prec*t)/sum(t)", "sum(rec*t)/sum(t)", "sum(f*t)/sum(t)"
    elif average == "binary":
        p, r, f = (f"coalesce(max(CASE WHEN label='1' THEN {x} END), 0)" for x in ("prec", "rec", "f"))
    else:
        p = r = f = "sum(tp)/sum(t)"
    return f"""
t_side AS (SELECT {k}truth AS label, count(*) AS t, sum(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS tp FROM {source} GROUP BY ALL),
p_side AS (SELECT {k}pred AS label, count(*) AS p FROM {source} GROUP BY ALL),
per_label AS (
  SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS prec, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS rec,
         CASE WHEN p + t > 0 THEN 2 * tp / (p + t) ELSE 0 END AS f
  FROM (SELECT {k}label, CAST(coalesce(t, 0) AS DOUBLE) AS t, CAST(coalesce(p, 0) AS DOUBLE) AS p,
               CAST(coalesce(tp, 0) AS DOUBLE) AS tp
        FROM t_side FULL OUTER JOIN p_side {using})),
scored AS (
  SELECT {k}sum(tp) / sum(t) AS accuracy, {p} AS "precision", {r} AS recall, {f} AS f1,
    CASE WHEN sum(t)*sum(t) > sum(p*p) AND sum(t)*sum(t) > sum(t*t)
      THEN (sum(tp) * sum(t) - sum(p * t)) / (sqrt(sum(t)*sum(t) - sum(p*p)) * sqrt(sum(t)*sum(t) - sum(t*t)))
      ELSE 0 END AS mcc
  FROM per_label {group})"""


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every double for export and comparison."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def majority_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Score, per fold, the commonest training class as forecast of the test part.

    Commits are counted by (part, label) first, so the folds multiply counts and not rows.
    """
    labels = change_stream(spark, sf).select("commit", F.col("priority").alias("label"))
    counts = value_counts(
        commit_parts(spark, sf).join(labels, "commit"), ["time_partition"], "label"
    )
    split = expanding_split(counts)
    commonest = most_common(split.filter(F.col("role") == "train"), ["fold"], "label", "n")
    # One row per fold: bounded by the list of folds.
    commonest = F.broadcast(commonest.withColumnRenamed("label", "pred"))
    table = split.filter(F.col("role") == "test").join(commonest, "fold")
    table = table.select("fold", F.col("label").alias("truth"), "pred", "n")
    return score_confusion(table, ["fold"])


@query(
    "majority_forecast",
    f"""WITH {FORECAST_SQL}, {metrics_sql('predictions', 'fold')}
    SELECT fold, round(accuracy, 8) AS accuracy, round("precision", 8) AS "precision", round(recall, 8) AS recall,
    round(f1, 8) AS f1, round(sqrt("precision" * recall), 8) AS gmean, round(mcc, 8) AS mcc FROM scored""",
)
def _majority_forecast(spark, sf):
    return rounded(majority_forecast(spark, sf))
