"""Time order, folds and splits of a commit stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.draws import draw_key
from riskloom.operators.ranks import dealt, global_position


def cut_points(n: int, k: int) -> list[int]:
    """Start of every part in [0, n), by the truncated floating-point step.

    The rule is ``int(i * (1 / k) * n)``, which differs from integer division for some (k, n);
    the last part always runs to the end.
    """
    step = 1 / k
    return [int((i * step) * n) for i in range(k)]


def part_of(position: Column, cuts: Sequence[int]) -> Column:
    """Index of the part a position falls in."""
    steps = [(position >= F.lit(c)).cast("int") for c in cuts[1:]]
    return reduce(lambda a, b: a + b, steps, F.lit(0)).cast("int")


def time_order(commits: DataFrame, commit: str = "commit", date: str = "date") -> DataFrame:
    """One row per commit: its first date and its position in time; ties go by commit."""
    first = dealt(commits, commit, date).groupBy(commit).agg(F.min(date).alias(date))
    return global_position(first, [date, commit])


def holdout_split(ordered: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Add ``set``: the first commits train, the next validate, the rest test."""
    n = ordered.count()
    first, second = int(train * n), int((train + val) * n)
    pos = F.col("position")
    return ordered.withColumn(
        "set", F.when(pos < first, "train").when(pos < second, "val").otherwise("test")
    )


def time_folds(ordered: DataFrame, k: int = 12, name: str = "time_partition") -> DataFrame:
    """Add the time part (0..k-1): parts hold equal counts of commits in time order."""
    return ordered.withColumn(name, part_of(F.col("position"), cut_points(ordered.count(), k)))


def random_folds(
    commits: DataFrame, k: int = 10, seed: int = 42, commit: str = "commit", name: str = "partition"
) -> DataFrame:
    """One row per commit with a random fold; the order is the md5 draw, then the commit."""
    keyed = dealt(commits, commit).distinct().withColumn("_draw", draw_key(commit, seed=seed))
    ordered = global_position(keyed, ["_draw", commit], "_at")
    return ordered.withColumn(name, part_of(F.col("_at"), cut_points(ordered.count(), k))).drop(
        "_draw", "_at"
    )


def fold_table(spark: SparkSession, folds: Sequence[int]) -> DataFrame:
    """One row per fold; as long as the list of folds given."""
    return spark.createDataFrame([(int(f),) for f in folds], "fold int")


def _assign(df: DataFrame, folds: Sequence[int], role) -> DataFrame:
    """One row per (fold, row) that has a role in the fold, by exploding a short literal array."""
    roles = F.array(*[F.struct(F.lit(int(f)).alias("fold"), role(int(f)).alias("role")) for f in folds])
    kept = F.filter(roles, lambda r: r["role"].isNotNull())
    return df.select("*", F.inline(kept))


def expanding_split(
    df: DataFrame, folds: Sequence[int] = tuple(range(10)), part: str = "time_partition"
) -> DataFrame:
    """Per fold f: parts up to f train, f+1 validates, f+2 tests. Adds ``fold`` and ``role``."""
    p = F.col(part)
    return _assign(
        df,
        folds,
        lambda f: F.when(p <= f, "train").when(p == f + 1, "val").when(p == f + 2, "test"),
    )


def kfold_split(
    df: DataFrame, folds: Sequence[int] = tuple(range(10)), part: str = "partition"
) -> DataFrame:
    """Per fold f: part f tests, the others train. Adds ``fold`` and ``role``."""
    p = F.col(part)
    return _assign(df, folds, lambda f: F.when(p == f, "test").when(p != f, "train"))


def part_totals(df: DataFrame, part: str, k: int, **totals: tuple[Callable[[Column], Column], str]) -> DataFrame:
    """One row per part (0..k-1) that has rows: the part, ``n``, and ``totals``, which maps names to (aggregate, column).

    There is one aggregate without keys, so a task holds one row: grouped
    by part, a minimum of texts would make it sort its rows.
    """

    def cell(p: int) -> Column:
        here = F.col(part) == p
        each = [agg(F.when(here, F.col(c))).alias(name) for name, (agg, c) in totals.items()]
        return F.struct(F.lit(p).alias(part), F.count_if(here).alias("n"), *each)

    return df.agg(F.array(*[cell(p) for p in range(k)]).alias("_parts")).select(F.inline("_parts")).filter("n > 0")


def select_split(df: DataFrame, *names: str, column: str = "set") -> DataFrame:
    """Rows of the named splits, such as ``train`` and ``val`` together."""
    return df.filter(F.col(column).isin(*names))
