"""Projections, filters and reshaping of result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import JAVA_KEYWORDS

# Metrics a wide result column may end in, and the overall columns' new names.
WIDE_METRICS = ["acc", "rec", "prec", "f1", "gmean", "mcc", "auc"]
OVERALL_NAMES = {
    "accuracy": "multitask_acc",
    "precision": "multitask_prec",
    "recall": "multitask_rec",
    "f1-score": "multitask_f1",
    "gmean": "multitask_gmean",
    "mcc": "multitask_mcc",
    "auc": "multitask_auc",
}


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def pick(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Select and rename: old name -> new name, in the order given."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts that give NULL for malformed text instead of failing."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def parse_dates(df: DataFrame, column: str = "date", fmt: str | None = None) -> DataFrame:
    """Text dates as timestamps; ``date_rejected`` marks text that is no date."""
    text = F.col(column).cast("string")
    ts = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return df.withColumn("date_rejected", text.isNotNull() & ts.isNull()).withColumn(column, ts)


def match(df: DataFrame, **dims) -> DataFrame:
    """Rows equal to every given dimension; a list means any of its values."""
    conds = [
        F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in dims.items()
    ]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def match_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def columns_like(df: DataFrame, part: str, exclude: Sequence[str] = ()) -> list[str]:
    """Column names that contain ``part``."""
    return [c for c in df.columns if part in c and c not in exclude]


def blank_changes(df: DataFrame, prev: str = "prev_data", cur: str = "cur_data") -> DataFrame:
    """Rows whose text is empty on both sides."""
    return df.filter((F.coalesce(prev, F.lit("")) == "") & (F.coalesce(cur, F.lit("")) == ""))


def split_context(df: DataFrame, column: str, data: str, context: str) -> DataFrame:
    """Text cut at the first comma into data and context; no comma gives an empty context."""
    parts = F.split(F.coalesce(column, F.lit("")), ",", 2)
    return df.withColumns(
        {data: F.get(parts, F.lit(0)), context: F.coalesce(F.get(parts, F.lit(1)), F.lit(""))}
    )


def settings_key(*columns: str, sep: str = ",") -> Column:
    """One text key of a model configuration."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])


# The change metrics among the manual features, before the Java keywords.
CHANGE_METRICS = ["STARS", "COMMITS", "NS", "LA", "LD", "LT", "NDEV", "AGE", "NUC", "EXP", "NRF"]
MANUAL_FEATURES = (*CHANGE_METRICS, *JAVA_KEYWORDS)


def manual_features(df: DataFrame, columns: Sequence[str] = MANUAL_FEATURES, key: str = "commit") -> DataFrame:
    """Named metric columns as DOUBLE, with the key; by default all 68 of them."""
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])


def round_columns(df: DataFrame, digits: int = 3, half_even: bool = True) -> DataFrame:
    """Doubles rounded for export."""
    fn = F.bround if half_even else F.round
    return df.select(*[fn(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot_results(
    wide: DataFrame, ids: Sequence[str] = ("run", "set", "fold"), average: bool = False
) -> DataFrame:
    """``<task>_<metric>`` columns to one row per ids and scenario, one column per metric.

    Overall columns become scenario ``multitask``. ``average`` gives the mean per scenario.
    """
    wide = wide.withColumnsRenamed({c: n for c, n in OVERALL_NAMES.items() if c in wide.columns})
    cells: dict[str, dict[str, str]] = {}
    others = []
    for c in wide.columns:
        scenario, _, metric = c.rpartition("_")
        if c in ids:
            continue
        if scenario and metric in WIDE_METRICS:
            cells.setdefault(scenario, {})[metric] = c
        elif scenario and metric != "time":
            raise ValueError(f"column does not end in a metric: {c}")
        else:
            others.append(c)
    metrics = [m for m in WIDE_METRICS if any(m in row for row in cells.values())]
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("scenario"),
                *[
                    (F.col(f"`{row[m]}`") if m in row else F.lit(None)).cast("double").alias(m)
                    for m in metrics
                ],
            )
            for s, row in cells.items()
        ]
    )
    # One projection per row, no shuffle.
    long = wide.select(*ids, *others, F.inline(rows))
    if not average:
        return long
    values = [*metrics, *others]
    return long.groupBy("scenario").agg(*[F.avg(v).alias(v) for v in values])


def melt_results(
    wide: DataFrame, ids: Sequence[str], exclude: str = "best", name: str = "classifier", value: str = "mcc"
) -> DataFrame:
    """Classifier columns to rows; ``-`` cells and columns named like ``exclude`` are left out."""
    columns = [c for c in wide.columns if c not in ids and exclude not in c.lower()]
    text = wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot(list(ids), columns, name, value)
    return long.filter(F.col(value) != "-").withColumn(value, F.col(value).cast("double"))


def align(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Statistic tables side by side, by key."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), frames)
