import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ranks
from riskloom.operators.ranks import average_ranks, global_position, keyed_position, running_totals


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 3000
    # One key holds a third of the rows and one is NULL.
    key = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcdefgh"), n)).astype(object)
    key[:50] = None
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": rng.integers(0, 40, n).astype(float), "w": rng.integers(0, 9, n)})
    return pdf, spark.createDataFrame(pdf, "id bigint, k string, v double, w bigint").repartition(7)


def test_running_totals_match_cumulative_sums(frame):
    pdf, df = frame
    got = running_totals(df, {"c": "w"}, ["v", "id"], ["k"]).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).groupby("k", dropna=False)["w"].cumsum().sort_index()
    assert got["c"].tolist() == want.tolist()


def test_running_totals_without_keys(frame):
    pdf, df = frame
    got = running_totals(df, {"c": "w", "d": "w"}, ["v", "id"]).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"])["w"].cumsum().sort_index()
    assert got["c"].tolist() == want.tolist() == got["d"].tolist()


def test_positions(frame):
    pdf, df = frame
    got = global_position(df, ["v", "id"]).toPandas().sort_values("position")
    assert got["id"].tolist() == pdf.sort_values(["v", "id"])["id"].tolist()
    keyed = keyed_position(df, ["v", "id"], ["k"], "p").toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).groupby("k", dropna=False).cumcount().sort_index()
    assert keyed["p"].tolist() == want.tolist()


def test_average_ranks_share_tied_places(frame):
    pdf, df = frame
    one = df.selectExpr("k", "v", "cast(1 as bigint) as n")
    got = {(r["k"], r["v"]): r["rank"] for r in average_ranks(one, "v", ["n"], ["k"]).collect()}
    want = pdf.assign(r=pdf.groupby("k", dropna=False)["v"].rank(method="average"))
    for k, v, r in zip(want["k"], want["v"], want["r"]):
        assert got[(k, v)] == r


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    n = 3000
    df = spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % n).alias("v")).withColumn("one", F.lit(1).cast("bigint"))
    assert ranks._ranges(df) == 60 and ranks._ranges(df.limit(50)) is None
    held, write = [], ranks.materialise

    def watched(frame, label):
        out = write(frame, label)
        held.append([r["count"] for r in out.groupBy(F.input_file_name()).count().collect()])
        return out

    monkeypatch.setattr(ranks, "materialise", watched)
    placed = ranks.global_position(df, ["v"])
    assert all(r.position == r.v for r in placed.collect())
    totals = {(r.k, r.v): r.total for r in ranks.running_totals(df, {"total": "one"}, ["v"], ["k"]).collect()}
    for k in range(3):
        own = sorted(v for kk, v in totals if kk == k)
        assert [totals[(k, v)] for v in own] == list(range(1, len(own) + 1))
    assert len(held) == 2 and all(len(h) > 40 and max(h) <= 150 and sum(h) == n for h in held)
