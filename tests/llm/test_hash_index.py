"""Probing against all codes, neighbours against all distances, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hash_index as H


def exact(rows, asked, k):
    """(query, rank, id, distance) by measuring everything; rows are (id, vector) with distinct ids."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = []
    for q in np.flatnonzero([asked(i) for i in ids]):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        order = [o for o in np.lexsort((ids, far)) if o != q][:k]
        out += [(int(ids[q]), r, int(ids[o]), float(far[o])) for r, o in enumerate(order, 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("kind", ["random", "close", "equal"])
def test_probing_finds_every_code_within_the_radius(kind, monkeypatch):
    monkeypatch.setattr(H, "PAIRS", 500)
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, size=(300, H.WORDS)).astype(np.uint64)
    if kind != "random":
        codes = np.repeat(codes[:1], 300, axis=0)
    if kind == "close":
        for row in codes:
            for bit in rng.choice(H.BITS, rng.integers(0, 90), replace=False):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    asked, radius = codes[:60], rng.integers(0, 140, size=60)
    q, r = (np.concatenate(c) for c in zip(*H.Tables(codes).within(asked, radius), strict=True))
    found = sorted(zip(q.tolist(), r.tolist(), strict=True))
    far = H.differing(asked, codes)
    assert found == sorted((int(a), int(b)) for a, b in zip(*np.nonzero(far <= radius[:, None]), strict=True))
    assert len(found) == len(set(found))


def clustered(n, width=48, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    return [(i, (centres[i % 20] + 0.4 * rng.normal(size=width)).round(6).tolist()) for i in range(n)]


def test_recall_with_a_small_sample_and_many_tiles(spark):
    rows = clustered(1500)
    v = H.vectors(frame(spark, rows), "vec_id", "embedding")
    codes = H.fit(v, sample=300)
    found = H.search(v, v.where(F.col("id") % 10 == 0), codes, k=10, tile=400, asked=60)
    truth = exact(rows, lambda i: i % 10 == 0, 10)
    assert H.recall(found, spark.createDataFrame(truth, "query_id bigint, rank int, vec_id bigint, score double")) >= 0.95
    got = found.collect()
    distance = {(q, i): d for q, _, i, d in exact(rows, lambda i: i % 10 == 0, 1499)}
    by = {}
    for r in got:
        assert abs(r.score - distance[r.query_id, r.vec_id]) < 1e-12
        by.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert len(by) == 150
    for ranked in by.values():
        ranked.sort()
        assert [r for r, _, _ in ranked] == list(range(1, len(ranked) + 1)) and [x[1:] for x in ranked] == sorted(x[1:] for x in ranked)


def test_whole_sample_gives_exact_neighbours(spark):
    got = H.op13_hash_index(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    truth = exact(rows, lambda i: i % 100 == 0, 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted((q, n, i, round(d, 9)) for q, n, i, d in truth)


def test_large_groups_of_equal_and_close_vectors(spark):
    rng = np.random.default_rng(3)
    rows = clustered(600, 16)
    rows = [(i, [0.5] * 16 if i % 3 == 0 else v) for i, v in rows]
    rows += [(600 + i, (np.full(16, 0.7) + 1e-4 * rng.normal(size=16)).tolist()) for i in range(300)]
    v = H.vectors(frame(spark, rows), "vec_id", "embedding")
    found = H.search(v, v.where(F.col("id") % 20 == 0), H.fit(v, sample=200), k=10, tile=100, asked=16).collect()
    truth = exact(rows, lambda i: i % 20 == 0, 10)
    mine = {(r.query_id, r.vec_id) for r in found}
    assert len(mine & {(q, i) for q, _, i, _ in truth}) >= 0.95 * len(truth)
    for q in range(0, 600, 60):  # equal vectors rank by id
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [i for i in range(0, 600, 3) if i != q][:10]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1, 0, 0]), (1, [0, 1, 0]), (2, None), (3, []), (4, [0, 0, 0]), (5, [1, None, 0]), (6, [nan, 1, 0]), (7, [inf, 0, 0]),
        (8, [1, 1]), (None, [1, 0, 0]), (9, [2, 0, 0]), (9, [1, 0, 0]), (9, [1, 0, 0]), (100, [1, 0, 0]), (200, None),
    ]
    clash = frame(spark, rows).withColumns({"id": F.lit("x"), "x": F.lit(1), "score": F.lit(2)})
    got = H.neighbours(clash, "vec_id", "embedding", lambda i: i % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got) == [
        (0, 1, 9, 0.0), (0, 2, 100, 0.0), (0, 3, 1, 1.414214), (100, 1, 0, 0.0), (100, 2, 9, 0.0), (100, 3, 1, 1.414214),
    ]
    assert H.neighbours(frame(spark, [(0, [1, 2])]), "vec_id", "embedding", lambda i: i % 100 == 0).count() == 0
    assert H.neighbours(frame(spark, []), "vec_id", "embedding", lambda i: i % 100 == 0).count() == 0
    assert H.neighbours(frame(spark, [(1, [1, 2]), (3, [4, 5])]), "vec_id", "embedding", lambda i: i % 100 == 0).count() == 0
