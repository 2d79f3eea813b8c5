"""The hash tree's shares, movements and slots."""

from collections import Counter

from pyspark.sql import functions as F

from riskloom.llm import sharding as H
from tests.llm import odd


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = H.op7_hash_tree(spark, "/root/testdata/sf0.01").collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 8 for r in moved)
    assert 0.06 < len(moved) / len(rows) < 0.17
    size = Counter(r.shard for r in rows)
    assert sorted(size) == list(range(8)) and max(size.values()) < 1.5 * len(rows) / 8
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(size[s]))


def test_growth_of_any_tree_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    assert H.grown(H.tree_of(8)) == H.tree_of(9)
    twice = H.grown(H.grown(H.tree_of(6)))
    assert sorted(s for racks in twice.values() for rack in racks.values() for s in rack) == list(range(8))
    trees = [H.tree_of(n) for n in range(1, 21)] + [H.grown(H.tree_of(6))]
    sizes = [sum(len(rack) for racks in t.values() for rack in racks.values()) for t in trees]
    both = [F.struct(H.place(F.col("k"), t).alias("a"), H.place(F.col("k"), H.grown(t)).alias("b")) for t in trees]
    for at, n in enumerate(sizes):
        got = keys.select(both[at].alias("s")).select("s.*").collect()
        moved = [r for r in got if r.a != r.b]
        assert all(r.b == n for r in moved) and 0.6 / (n + 1) < len(moved) / len(got) < 1.5 / (n + 1)


def test_changed_weights_move_rows_in_their_subtree_only(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    before, after = H.tree_of(8), H.tree_of(8)
    after["r1"]["k0"] = {4: 0.5, 5: 1.5}  # the rack weighs what it weighed
    got = keys.select(H.place(F.col("k"), before).alias("a"), H.place(F.col("k"), after).alias("b")).collect()
    assert all(r.a == r.b for r in got if r.a not in (4, 5))
    assert {(r.a, r.b) for r in got if r.a != r.b} == {(4, 5)}


def test_shares_follow_weights(spark):
    tree = {"a": {"x": {0: 1.0, 1: 3.0}, "y": {2: 2.0}}, "b": {"z": {3: 6.0, 4: 0.0}}}
    keys = spark.range(24_000).select(F.col("id").cast("string").alias("k"))
    got = Counter(r.s for r in keys.select(H.place(F.col("k"), tree).alias("s")).collect())
    assert 4 not in got
    for shard, weight in ((0, 1), (1, 3), (2, 2), (3, 6)):
        assert abs(got[shard] - 2000 * weight) < 250


def test_odd_rows(spark):
    got = H.sharded(odd.documents(spark), H.tree_of(3)).collect()
    assert len(got) == len(odd.TEXTS) and all(r.shard in (0, 1, 2) for r in got)
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((k, len((t or "").encode()) + 1) for k, t in odd.TEXTS), key=repr)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert H.sharded(odd.documents(spark, []), H.tree_of(3), H.tree_of(4)).count() == 0
