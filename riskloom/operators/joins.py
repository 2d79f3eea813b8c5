"""Joins between features, commits, advisories and results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import BROADCAST_BYTES, broadcast_if_small, materialise

# No broadcast hints in the plain joins: both sides may be large. Spark broadcasts a side when its measured
# size is below the threshold, and AQE splits skewed partitions of a sort-merge join. ``split_join`` does it on
# purpose for keys that are known to be hot, NULL among them.


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every left row with its right columns; several matches give several rows."""
    return left.join(right, list(on), "left")


def left_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys match NULL keys."""
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    rest = [F.col(f"r.{c}") for c in right.columns if c not in on]
    return left.alias("l").join(right.alias("r"), cond, "left").select("l.*", *rest)


def inner_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on))


def strict_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails when a key has no match. The check is part of the job itself."""
    found = left.join(right.withColumn("_hit", F.lit(True)), key, "left")
    message = F.concat(F.lit("no features for "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    ok = F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return found.filter(ok).drop("_hit")


def keep_known(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows whose key occurs on the right."""
    return left.join(right, list(on), "left_semi")


def missing_from(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows whose key does not occur on the right."""
    return left.join(right, list(on), "left_anti")


def suffix_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffixes: tuple[str, str] = ("_l", "_r")
) -> DataFrame:
    """Join of two result tables; shared value columns get a suffix per side."""
    both = [c for c in left.columns if c in right.columns and c not in on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, list(on), how)


def pair_tasks(df: DataFrame, task: str, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each row with the row of the same configuration in the other task, as ``<value>_other``.

    A task has one row per configuration; the job fails if it has several, so a row meets as many
    others as there are tasks and never all rows of a large group.
    """
    n = F.count(F.lit(1))
    several = F.raise_error(F.lit("several rows for one task and configuration"))
    single = df.groupBy(*on, F.col(task).alias("_task")).agg(
        F.when(n == 1, True).otherwise(several.cast("boolean")).alias("_ok"),
        *[F.max(v).alias(f"{v}_other") for v in values],
    )
    other = single.filter("_ok").drop("_ok")
    return df.join(other, list(on)).filter(F.col(task) != F.col("_task")).drop("_task")


#: A key with more than one row in ``SHARE`` is hot, so there are fewer than that many; a hot key is dealt to so many tasks.
SHARE, SALTS = 64, 32


def hot_keys(df: DataFrame, on: Sequence[str], share: int = SHARE) -> DataFrame:
    """The keys that hold more than one of ``share`` rows; NULL is a key like others. Counted before the shuffle."""
    counts = materialise(df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "keycounts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.filter(F.col("_n") * share > total).select(*on)


def split_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False,
    share: int = SHARE, salts: int = SALTS, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """A left or inner join whose hot left keys are split on purpose; the rest is an ordinary join.

    Rows of hot keys stay where they are while the right rows of these keys are small by measure. Beyond that they
    are dealt to ``salts`` tasks a key by a written row number, and their right rows are copied to each. Rows with a NULL
    key match each other with ``null_safe``; else they match nothing and take no part in the shuffle. The columns
    are those of ``left`` and the others of ``right``; the result is that of the plain join.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join: {how}")
    on = list(on)
    more = [c for c in right.columns if c not in on]
    names = {c: f"_r_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])

    def same(salted: bool = False):
        match = (lambda c: F.col(c).eqNullSafe(F.col(names[c]))) if null_safe else (lambda c: F.col(c) == F.col(names[c]))
        out = reduce(lambda a, b: a & b, [match(c) for c in on])
        return out & (F.col("_salt") == F.col("_r_salt")) if salted else out

    def joined(a: DataFrame, b: DataFrame, salted: bool = False) -> DataFrame:
        return a.join(b, same(salted), how).select(*left.columns, *more)

    work = left if null_safe else left.filter(known)
    # Fewer keys than ``share``, whatever the table holds.
    hot = F.broadcast(materialise(hot_keys(work, on, share).select(*[F.col(c).alias(f"_h_{c}") for c in on]), "hot"))
    is_hot = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in on])
    is_hot_right = reduce(lambda a, b: a & b, [F.col(names[c]).eqNullSafe(F.col(f"_h_{c}")) for c in on])
    few = materialise(right.join(hot, is_hot_right, "left_semi"), "hotright")
    many = work.join(hot, is_hot, "left_semi")
    copy = broadcast_if_small(few, max_bytes=max_bytes)
    if copy is not few:
        split = joined(many, copy)
    else:
        numbered = materialise(many.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int")), "salted")
        copies = few.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        split = joined(numbered, copies, salted=True)
    out = joined(work.join(hot, is_hot, "left_anti"), right.join(hot, is_hot_right, "left_anti")).unionByName(split)
    if null_safe or how == "inner":
        return out
    none = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in more]
    return out.unionByName(left.filter(~known).select(*left.columns, *none))
