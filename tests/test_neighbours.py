"""The candidate index: recall against the exact mode, few probes on clusters, hot cells, and its users."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import neighbours as N
from riskloom.operators.models import fit_predict
from riskloom.operators.resample import oversample_smote


def clusters(spark, n=1200, seed=3, width=6, groups=30):
    rng = np.random.default_rng(seed)
    centres = 10 * rng.normal(size=(groups, width))
    rows = [(i, (centres[i % groups] + rng.normal(size=width)).tolist(), str(i % groups % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, label string").repartition(4)


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_few_probes_find_the_neighbours_in_clusters(spark, metric):
    rows = clusters(spark)
    cells = N.build_cells(rows, 5, metric=metric, sample=600)
    assert len(cells.pivots[0]) == 35 and cells.probes <= 6
    found = cells.nearest(rows, rows, 5, metric=metric, skip_same=True)
    exact = N.nearest(rows, rows, 5, metric=metric, skip_same=True)
    assert N.recall(found, exact) >= 0.9
    truth = {(r.id, r.neighbour): r.distance for r in N.nearest(rows, rows, 1200, metric=metric, skip_same=True).collect()}
    got = found.collect()
    assert len({(r.id, r.neighbour) for r in got}) == len(got)
    for r in got:
        assert abs(truth[r.id, r.neighbour] - r.distance) < 1e-9 and 1 <= r["rank"] <= 5


def test_all_cells_are_the_exact_mode(spark):
    rows = clusters(spark, 150)
    cells = N.build_cells(rows, 4, pivots=7)
    cells.probes = 7
    plain = lambda df: sorted((r.id, r["rank"], r.neighbour, round(r.distance, 9), r.label) for r in df.collect())
    kept = {"group": "label", "payload": ["label"], "skip_same": True}
    assert plain(cells.nearest(rows, rows, 4, **kept)) == plain(N.nearest(rows, rows, 4, **kept))


def test_one_cell_with_most_rows_is_cut_into_tiles(spark):
    same = spark.range(400).select("id", F.array(F.lit(1.0), (F.col("id") % 3 == 0).cast("double")).alias("x"))
    cells = N.build_cells(same, 3)
    got = cells.nearest(same, same, 3, skip_same=True, block=40).collect()
    assert len(got) == 1200 and all(r.distance == 0 for r in got)
    one = sorted((r["rank"], r.neighbour) for r in got if r.id == 7)
    assert one == [(1, 1), (2, 2), (3, 4)]


def test_rows_without_candidates_and_wrong_metric(spark):
    rows = clusters(spark, 90, groups=3)
    cells = N.build_cells(rows, 3)
    with pytest.raises(ValueError, match="another metric"):
        cells.nearest(rows, rows, 3, metric="l1")
    with pytest.raises(ValueError, match="no training rows"):
        N.build_cells(rows.limit(0), 3)
    assert N.recall(cells.nearest(rows.limit(0), rows, 3), rows.select("id", F.col("id").alias("neighbour")).limit(0)) == 1.0


def test_votes_and_new_rows_by_candidates(spark):
    rows = clusters(spark)
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    search = N.build_cells(train, 11).nearest
    exact, near = (fit_predict("knn", ("11", "uniform", "2"), train, test, "id", "x", search=s).collect() for s in (N.nearest, search))
    assert len(near) == len(exact) == 300
    agree = {r.id: r.pred for r in exact}
    assert sum(agree[r.id] == r.pred for r in near) >= 285

    few = rows.where("label <> '2' OR id < 300")
    cells = N.build_cells(few, 5, group="label")
    made = oversample_smote(few, "label", "id", "x", 5, search=cells.nearest)
    sizes = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1
    old = {r.id: r for r in few.collect()}
    for r in made.where("copy > 0").collect():
        a, b = np.array(old[r.id].x), np.array(old[r.neighbour].x)
        assert old[r.id].label == old[r.neighbour].label == r.label
        low, high = np.minimum(a, b) - 1e-9, np.maximum(a, b) + 1e-9
        assert ((low <= r.x) & (r.x <= high)).all()
    same = oversample_smote(few, "label", "id", "x", 5).where("copy > 0")
    mixed = made.where("copy > 0").join(same, ["id", "copy", "neighbour"]).count()
    assert mixed >= 0.8 * same.count()


def test_a_block_holds_few_distances_at_a_time():
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"_id": np.arange(N.ROWS), "_x": list(rng.normal(size=(N.ROWS, 64)))})
    asked = rows.head(512).rename(columns={"_id": "_qid"})
    tracemalloc.start()
    got = N._top_of_block(11, 2, (), True)(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 512 * 11 and peak < 64 << 20


def odd_rows(kind, n=4000, width=7):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, width))
    if kind == "ties":
        return np.round(x)
    if kind == "outlier":
        x[5] = 1e9
    if kind == "far from zero":
        x += 1e12
    if kind == "one column":
        x[:, 1:] = 3.0
    if kind == "all equal":
        x[:] = 0.1
    if kind == "tiny":
        x *= 1e-300
    if kind == "huge":
        x *= 1e100
    return x


@pytest.mark.parametrize("norm", [1, 2])
@pytest.mark.parametrize("kind", ["plain", "ties", "outlier", "far from zero", "one column", "all equal", "tiny", "huge"])
def test_candidates_hold_all_nearest_rows(kind, norm):
    """Small numbers only sort out what cannot be among the nearest, whatever the scale; ties go to the smaller id."""
    x = odd_rows(kind)
    queries = np.concatenate([x[::400], 50 * x[:3], x[:2] - 7])
    rows = pd.DataFrame({"_id": np.arange(len(x)), "_x": list(x)})
    got = N._top_of_block(9, norm, (), False)(pd.DataFrame({"_qid": np.arange(len(queries)), "_x": list(queries)}), rows)
    assert len(got) == 9 * len(queries)
    for i, q in enumerate(queries):
        far = N._distances(x, q, norm)
        want = np.lexsort((np.arange(len(x)), far))[:9]
        mine = got[got["_qid"] == i]
        assert mine["_id"].tolist() == want.tolist() and mine["distance"].tolist() == far[want].tolist()


@pytest.mark.parametrize("norm", [1, 2])
def test_few_rows_of_a_tile_are_measured(monkeypatch, norm):
    """Only rows that can be among the nearest are measured in double precision."""
    x = np.random.default_rng(5).normal(size=(12_000, 64))
    measured, plain = [], N._distances

    def counted(rows, point, norm):
        measured.append(len(rows))
        return plain(rows, point, norm)

    monkeypatch.setattr(N, "_distances", counted)
    rows = pd.DataFrame({"_id": np.arange(len(x)), "_x": list(x)})
    N._top_of_block(31, norm, (), True)(rows.head(64).rename(columns={"_id": "_qid"}), rows)
    assert sum(measured) < 64 * len(x) / 10


def test_small_tables_make_blocks_for_all_cores(spark, monkeypatch):
    """A table that fits one tile is still searched by several tasks."""
    rows = clusters(spark, 2000)
    used = spark.sparkContext.accumulator(0)
    plain = N._top_of_block

    def counted(*args):
        run = plain(*args)

        def both(q, t):
            used.add(1)
            return run(q, t)

        return both

    monkeypatch.setattr(N, "_top_of_block", counted)
    assert N.nearest(rows, rows, 3, metric="l1").count() == 6000
    assert used.value >= 8
