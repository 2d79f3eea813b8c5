"""Aggregates over labels and experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "n", weight: str | None = None
) -> DataFrame:
    """Rows per keys and value, or the sum of ``weight`` where rows are counted already."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys, value).agg(n.alias(name))


def most_common(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """The commonest value per keys; ties go to the smallest value.

    Counts first, so the choice sees one row per distinct value, and needs no window.
    """
    counted = value_counts(df, keys, value, "_n", weight)
    # min over (-count, value): largest count, then smallest value.
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(value))


def smallest_class(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Size of the smallest and the largest class per keys, and the number of classes."""
    return (
        value_counts(df, keys, label, "_n")
        .groupBy(*keys)
        .agg(F.min("_n").alias("smallest"), F.max("_n").alias("largest"), F.count(F.lit(1)).alias("classes"))
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_distinct(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact distinct count; aggregated twice, so no key needs all its values in one task."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias("n_distinct"))


def _finite(metric: str):
    return F.col(metric).isNotNull() & ~F.isnan(metric)


def best_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], metric: str = "mcc"
) -> DataFrame:
    """The row with the largest metric per keys; ties go to the first in ``order``; NaN is skipped."""
    return _extreme(df, keys, order, metric, -F.col(metric))


def worst_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], metric: str = "mcc"
) -> DataFrame:
    """The row with the smallest metric per keys; ties and NaN as for the best."""
    return _extreme(df, keys, order, metric, F.col(metric))


def _extreme(df, keys, order, metric, sort_value) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(
        F.struct(*[F.col(c) for c in rest]),
        F.struct(sort_value.alias("m"), *[F.col(c) for c in order]),
    )
    out = df.filter(_finite(metric)).groupBy(*keys).agg(pick.alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per keys in a stated order, by aggregation instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    out = df.groupBy(*keys).agg(pick.alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], metric: str = "mcc", also: Sequence[str] = ("f1",)) -> DataFrame:
    """Best minus worst: of ``metric`` itself, and of ``also`` taken at the best and worst rows."""
    keep = F.struct(F.col(metric), *[F.col(c) for c in also])
    ties = [F.col(c) for c in order]
    picked = df.filter(_finite(metric)).groupBy(*keys).agg(
        F.min_by(keep, F.struct((-F.col(metric)).alias("m"), *ties)).alias("hi"),
        F.min_by(keep, F.struct(F.col(metric).alias("m"), *ties)).alias("lo"),
    )
    return picked.select(
        *keys,
        *[(F.col(f"hi.{c}") - F.col(f"lo.{c}")).alias(f"{c}_spread") for c in (metric, *also)],
    )
