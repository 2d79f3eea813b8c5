"""Oversampling with repeatable draws.

Draws are generated in blocks, merged into copies per source row before any join, and copies are
generated in blocks again, so neither a tiny class nor a huge gap lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.draws import draw_long, draw_unit
from riskloom.functions.vectors import as_array
from riskloom.operators.aggregates import smallest_class
from riskloom.operators.neighbours import nearest
from riskloom.operators.ranks import keyed_position
from riskloom.session import broadcast_if_small, materialise

BLOCK = 10_000

# Neighbour counts tried, by the size of the smallest class.
LADDER = [(1, []), (5, [1]), (10, [1, 5]), (15, [1, 5, 10]), (20, [1, 5, 10, 15])]
LADDER_ALL = [1, 5, 10, 15, 20]


def smote_ladder(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Allowed neighbour counts per keys: one row per keys and k; none for a class of one row."""
    sizes = smallest_class(df, label, keys)
    ks = F.array(*[F.lit(k) for k in LADDER_ALL])
    for top, allowed in reversed(LADDER):
        ks = F.when(F.col("smallest") <= top, F.array(*[F.lit(k) for k in allowed]).cast("array<int>")).otherwise(ks)
    return sizes.select(*keys, "smallest", F.explode(ks).alias("k"))


def _copies(sizes: DataFrame, label: str, seed: int) -> DataFrame:
    """Draws per class and slot: ``sizes`` has label, ``_slots`` and ``_missing``."""
    blocks = sizes.filter(F.col("_missing") > 0).select(
        label, "_slots", "_missing", F.explode(F.sequence(F.lit(0), F.expr(f"(_missing - 1) div {BLOCK}"))).alias("_block")
    )
    start = F.col("_block") * BLOCK
    draws = blocks.repartition(label, "_block").select(
        label, "_slots", F.explode(F.sequence(start + 1, F.least(F.col("_missing"), start + BLOCK))).alias("_i")
    )
    slot = draw_long(label, "_i", seed=seed) % F.col("_slots")
    return draws.groupBy(label, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))


def _repeat(df: DataFrame, count: str, key: Sequence[str], name: str) -> DataFrame:
    """Rows repeated ``count`` times, numbered from 1; large counts spread over tasks in blocks."""
    few = df.filter(F.col(count) <= BLOCK).withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count))))
    many = df.filter(F.col(count) > BLOCK).withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"({count} - 1) div {BLOCK}"))))
    start = F.col("_block") * BLOCK
    many = many.repartition(*key, "_block").withColumn(
        name, F.explode(F.sequence(start + 1, F.least(F.col(count), start + BLOCK)))
    )
    return few.unionByName(many.drop("_block"))


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    sizes = materialise(df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    return sizes.withColumn("_missing", F.lit(largest) - F.col("_size"))


def oversample_random(df: DataFrame, label: str, id: str, seed: int = 42) -> DataFrame:
    """All rows (``copy`` 0) and, per class, rows drawn with replacement up to the largest class."""
    sizes = _class_sizes(df, label).withColumn("_slots", F.col("_size"))
    copies = materialise(_copies(sizes, label, seed), "copies")
    placed = keyed_position(df, [id], [label], "_slot")
    drawn = placed.join(copies, [label, "_slot"])
    more = _repeat(drawn, "_n", [id], "copy").select(*df.columns, "copy")
    return df.withColumn("copy", F.lit(0).cast("bigint")).unionByName(more)


def oversample_smote(
    df: DataFrame, label: str, id: str, vector: str, k: int, seed: int = 42, metric: str = "l2", search: Callable = nearest
) -> DataFrame:
    """All rows (``copy`` 0) and new rows between a row and one of its k neighbours of its class.

    New rows fill every class up to the largest: base row, neighbour and the share of the way are
    repeatable draws. New rows keep the id of their base row; ``neighbour`` and ``copy`` tell them apart.
    ``search`` finds the neighbours: the exact mode, or ``nearest`` of a candidate index. A draw whose rank
    a candidate index did not find starts again from the first, and a row without neighbours found is copied.
    """
    sizes = _class_sizes(df, label)
    short = sizes.filter((F.col("_missing") > 0) & (F.col("_size") <= k)).first()
    if short is not None:
        raise ValueError(f"class {short[label]!r} has {short['_size']} rows, too few for {k} neighbours")
    sizes = sizes.withColumn("_slots", F.col("_size") * k)
    copies = materialise(_copies(sizes, label, seed), "copies").withColumns(
        {"_place": F.expr(f"_slot div {k}"), "rank": (F.col("_slot") % k + 1).cast("int")}
    )
    rows = as_array(df, vector)
    lacking = rows.join(broadcast_if_small(sizes.filter("_missing > 0").select(label)), label, "left_semi")
    train = lacking.withColumn("_nx", F.col(vector))
    pairs = search(lacking, train, k, id=id, vector=vector, metric=metric, group=label, payload=["_nx"], skip_same=True)
    # At most k neighbours per row.
    near = pairs.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "_nx"))).alias("_near"))
    placed = keyed_position(lacking, [id], [label], "_place")
    drawn = placed.join(copies, [label, "_place"]).join(near, id, "left")
    one = F.get("_near", ((F.col("rank") - 1) % F.size("_near")).cast("int"))
    drawn = drawn.withColumns({"neighbour": F.coalesce(one["neighbour"], id), "_nx": F.coalesce(one["_nx"], vector)})
    made = _repeat(drawn, "_n", [id, "rank"], "copy")
    u = draw_unit(label, "_slot", "copy", seed=seed)
    mixed = F.zip_with(vector, "_nx", lambda a, b: a + F.col("_u") * (b - a))
    made = made.withColumn("_u", u).withColumn(vector, mixed)
    old = rows.withColumns({"neighbour": F.lit(None).cast(dict(pairs.dtypes)["neighbour"]), "copy": F.lit(0).cast("bigint")})
    return old.unionByName(made.select(*rows.columns, "neighbour", "copy"))
