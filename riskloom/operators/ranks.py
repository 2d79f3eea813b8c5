"""Order statistics over whole tables: positions, running totals and average-tie ranks.

A window without a partition key, or over one hot key, puts all its rows in one task. Here rows
are range-partitioned by (keys, order) into chunks, ranked inside each chunk, and shifted by the
totals of the chunks before. Only one row per chunk and key meets in a small window. The ranged
rows are written out first, because range boundaries come from a sample and may differ between
two evaluations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import materialise

# Rows of one range; more rows make more ranges, so that a task sorts no more of them.
RANGE_ROWS = 250_000

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _ranges(df: DataFrame) -> int | None:
    """In how many ranges ``df`` is cut; None for so few rows that it is left to Spark."""
    many = -(-df.count() // RANGE_ROWS)
    return max(many, df.sparkSession.sparkContext.defaultParallelism) if many > 1 else None


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``df``, dealt out by their values to tasks of about ``RANGE_ROWS`` rows if it has many.

    Keys that hardly repeat fill the hash table of a task with its rows, and a scan has few tasks.
    """
    rows, many = df.select(*columns), _ranges(df)
    return rows.repartition(many, *columns) if many else rows


def global_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``."""
    many = _ranges(df)
    ranged = materialise(
        (df.repartitionByRange(many, *order) if many else df.repartitionByRange(*order))
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()),
        "position",
    )
    ranged = ranged.withColumn("_chunk", F.shiftrightunsigned("_id", _LOCAL_BITS))
    # One row per range: the window below sees a row for ``RANGE_ROWS`` rows of the table.
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        ranged.join(F.broadcast(offsets), "_chunk")
        .withColumn(name, (F.col("_offset") + local).cast("bigint"))
        .drop("_chunk", "_id", "_offset")
    )


def running_totals(
    df: DataFrame,
    sums: dict[str, str],
    order: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums per key: ``sums`` maps new column -> summed column.

    ``order`` should be unique within a key; rows equal in it count one after the other in an
    unspecified order.
    """
    many = _ranges(df)
    by = [*keys, *order]
    ranged = materialise(
        (df.repartitionByRange(many, *by) if many else df.repartitionByRange(*by)).withColumn("_chunk", F.spark_partition_id()),
        "running",
    )
    # Keys packed in a struct compare equal when both are NULL, so a plain equality join serves, on
    # the same columns as the window: one shuffle feeds both.
    ranged = ranged.withColumn("_key", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0)))
    chunk_sums = ranged.groupBy("_key", "_chunk").agg(
        *[F.sum(src).alias(f"_s_{dst}") for dst, src in sums.items()]
    )
    before = W.partitionBy("_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunk_sums.select(
        "_key",
        "_chunk",
        *[F.coalesce(F.sum(f"_s_{dst}").over(before), F.lit(0)).alias(f"_o_{dst}") for dst in sums],
    )
    if many:
        # The windows run on as many tasks; a range and its key lie whole in one of them.
        ranged = ranged.repartition(2 * many, "_chunk", "_key")
    inside = (
        W.partitionBy("_chunk", "_key")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = ranged.select("*", *[F.sum(src).over(inside).alias(f"_l_{dst}") for dst, src in sums.items()])
    return local.join(offsets, ["_chunk", "_key"]).select(
        *df.columns, *[(F.col(f"_l_{dst}") + F.col(f"_o_{dst}")).alias(dst) for dst in sums]
    )


def keyed_position(
    df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row within its key, in ``order``."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running_totals(ones, {name: "_one"}, order, keys)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def average_ranks(
    df: DataFrame, value: str, counts: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Distinct values per key with their average-tie rank.

    ``counts`` are 0/1 or weight columns (one per sample) to add up per distinct value. Equal
    values are merged before any ordering, so a value held by many rows is one row here.
    Result: keys, value, the summed counts, ``ties`` and ``rank``.
    """
    keys = list(keys)
    total = F.col(counts[0])
    for c in counts[1:]:
        total = total + F.col(c)
    merged = (
        df.groupBy(*keys, value)
        .agg(*[F.sum(c).alias(c) for c in counts])
        .withColumn("ties", total)
    )
    out = running_totals(merged, {"_hi": "ties"}, [value], keys)
    # Ranks lo..hi are shared by the tied rows; lo = hi - ties + 1.
    return out.withColumn("rank", (2 * F.col("_hi") - F.col("ties") + 1) / F.lit(2.0)).drop("_hi")
