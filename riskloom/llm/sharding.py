"""Shards from a weighted hash tree: regions, racks, shards.

A row's key descends the tree. At each node every child draws a number from the hash of (key, path of the
child), divided by the child's weight, and the smallest draw wins, so a child gets a share of rows in
proportion to its weight. A draw depends on nothing but key, path and weight: where weights inside one
subtree change, only rows on their way through its changed nodes can move; rows elsewhere stay. A new shard
in a new region takes rows from everywhere, but only into itself.

``tree_of`` builds the tree for a number of shards: regions of ``RACKS`` racks of ``SHARDS`` shards, filled in
order; a node weighs as much as the shards below it. ``grown`` adds one shard to any tree in a region of its own, so
that whatever the number of shards, rows move only into the new one; a shard put into a standing region would draw
rows into its neighbours too.

The key is doc_id as text; a NULL id is the empty text. Equal ids go to the same shard. Slots count a
shard's rows from 0 in order of id (NULL first), size and checksum; entirely equal rows take neighbouring
slots in any order. Slots come from range partitions and per-partition offsets, so no shard has to fit into
a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.draws import HEX_DIGITS, draw_long
from riskloom.llm.common import table
from riskloom.operators.ranks import keyed_position

RACKS, SHARDS = 2, 2
SEED = 7

#: region -> rack -> {shard: weight}
Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(shards: int) -> Tree:
    """The tree for shards 0 to ``shards`` - 1, each of weight 1."""
    out: Tree = {}
    for s in range(shards):
        region, rack = f"r{s // (RACKS * SHARDS)}", f"k{s // SHARDS % RACKS}"
        out.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return out


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` and one more shard, the next number, in a new region; everything else keeps its draws."""
    shards = [s for racks in tree.values() for rack in racks.values() for s in rack]
    region = next(name for i in range(len(tree) + 1) if (name := f"r{len(tree) + i}") not in tree)
    return {**tree, region: {"k0": {max(shards, default=-1) + 1: weight}}}


def _total(node) -> float:
    return sum(_total(v) if isinstance(v, dict) else float(v) for v in node.values())


def _winner(key: Column, path: str, children: dict[str, float]) -> Column:
    """Name of the child with the smallest weighted draw; ties go to the first name."""
    draws = []
    for name, weight in sorted(children.items()):
        if weight > 0:
            unit = (draw_long(key, F.lit(f"{path}/{name}"), seed=SEED).cast("double") + 0.5) / float(16**HEX_DIGITS)
            draws.append(F.struct((-F.ln(unit) / weight).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*draws))["name"] if len(draws) > 1 else draws[0]["name"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of ``key``: one draw among regions, one among the region's racks, one among the rack's shards."""

    def descend(node, path: str) -> Column:
        if all(not isinstance(v, dict) for v in node.values()):
            return _winner(key, path, {str(k): v for k, v in node.items()}).cast("int")
        names = {k: _total(v) for k, v in node.items()}
        won = _winner(key, path, names)
        out = F.lit(None).cast("int")
        for name, child in node.items():
            if names[name] > 0:
                out = F.when(won == name, descend(child, f"{path}/{name}")).otherwise(out)
        return out

    return descend(tree, "")


def sharded(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot[, grown_shard]) of each row of ``docs`` (doc_id, text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    cols = [F.col("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    cols.append(place(key, tree).alias("shard"))
    if grown is not None:
        cols.append(place(key, grown).alias("grown_shard"))
    return keyed_position(docs.select(*cols), ["doc_id", "size", "text_crc32"], ["shard"], "slot")


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, and where each goes with one more."""
    found = sharded(table(spark, sf_dir, "documents"), tree_of(8), grown(tree_of(8)))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _place_sql(tree: Tree) -> str:
    def winner(path: str, children: dict[str, float]) -> str:
        def draw(name: str, weight: float) -> str:
            digits = f"substr(md5(concat_ws('|', k, '{path}/{name}', '{SEED}')), 1, {HEX_DIGITS})"
            return f"-ln((CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) + 0.5) / {float(16**HEX_DIGITS)!r}) / {float(weight)!r}"

        pairs = ", ".join(f"{{'draw': {draw(n, w)}, 'name': '{n}'}}" for n, w in sorted(children.items()))
        return f"list_sort([{pairs}])[1].name"

    def descend(node, path: str) -> str:
        if all(not isinstance(v, dict) for v in node.values()):
            return f"CAST({winner(path, {str(k): v for k, v in node.items()})} AS INTEGER)"
        cases = " ".join(f"WHEN '{n}' THEN {descend(v, f'{path}/{n}')}" for n, v in node.items())
        return f"CASE {winner(path, {k: _total(v) for k, v in node.items()})} {cases} END"

    return descend(tree, "")


# CRC-32 in SQL: a table of 256 numbers, then one step for each byte of the text.
_CRC_SQL = """
steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps)"""

OP7_SQL = f"""
WITH {_CRC_SQL.strip()},
docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
  FROM documents),
summed AS (
  SELECT doc_id, k, size,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM docs, crc_table),
placed AS (SELECT *, {_place_sql(tree_of(8))} AS shard, {_place_sql(grown(tree_of(8)))} AS grown_shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""
