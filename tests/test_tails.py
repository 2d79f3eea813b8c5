"""Tail probabilities against the standard library and against all orderings."""

import itertools
import math
import time

import duckdb
from pyspark.sql import functions as F

from riskloom.functions import tails

POINTS = [0.0, 1e-300, 1e-9, 0.1, 0.7, 1.0, 1.4999999, 1.5, 1.5000001, 2.0, 3.3, 5.0, 8.0, 15.0, 26.0, 30.0, 400.0]


def test_erfc_in_double_precision_here_and_in_sql(spark):
    points = [s * x for x in POINTS for s in (1, -1)]
    got = {r.x: r.v for r in spark.createDataFrame([(x,) for x in points], "x double").select("x", tails.erfc(F.col("x")).alias("v")).collect()}
    con = duckdb.connect()
    for x in points:
        truth = math.erfc(x)
        assert abs(got[x] - truth) <= 2e-13 * truth, (x, got[x], truth)
        sql = con.execute(f"SELECT {tails.erfc_sql('x')} FROM (SELECT CAST(? AS DOUBLE) AS x)", [x]).fetchone()[0]
        assert abs(sql - truth) <= 2e-13 * truth
    odd = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "x double").select(tails.erfc(F.col("x")).alias("v")).collect()
    assert math.isnan(odd[0].v) and odd[1].v is None and odd[2].v == 0.0
    assert abs(spark.range(1).select(tails.normal_tail(F.lit(1.959963984540054))).first()[0] - 0.025) < 1e-15


def test_rank_sum_tail_counts_orderings(spark):
    cases = [(a, b) for a in range(1, 5) for b in range(1, 6)]
    rows = []
    for a, b in cases:
        values = [sum(r) - a * (a + 1) // 2 for r in itertools.combinations(range(1, a + b + 1), a)]
        rows += [(a, b, float(u), sum(v >= u for v in values) / len(values)) for u in range(a * b + 1)]
    got = spark.createDataFrame(rows, "a long, b long, u double, truth double").select("truth", tails.rank_sum_tail(F.col("u"), F.col("a"), F.col("b")).alias("p"))
    assert all(abs(r.p - r.truth) < 1e-12 for r in got.collect())


def test_rank_sum_tail_of_unequal_sizes_is_near_the_normal_law(spark):
    a, b = 8, 300
    spread = math.sqrt(a * b * (a + b + 1) / 12)
    row = spark.createDataFrame([(a, b, a * b / 2 + 1.5 * spread)], "a long, b long, u double").select(tails.rank_sum_tail(F.col("u"), F.col("b"), F.col("a"))).first()
    assert abs(row[0] - 0.5 * math.erfc(1.5 / math.sqrt(2))) < 0.002


def test_signed_rank_p_counts_signs(spark):
    rows = []
    for n in range(1, 9):
        sums = [sum(i for i, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
        rows += [(n, float(w), min(1.0, 2 * sum(s <= w for s in sums) / len(sums))) for w in range(n * (n + 1) // 2 + 1)]
    got = spark.createDataFrame(rows, "n long, w double, truth double").select("truth", tails.signed_rank_p(F.col("w"), F.col("n")).alias("p"))
    assert all(abs(r.p - r.truth) < 1e-12 for r in got.collect())


def test_large_laws_agree_with_counted_ones():
    for n, share in ((400, 0.5), (800, 0.3), (1200, 0.499), (1200, 0.2)):
        c = int(n * (n + 1) / 2 * share)
        counted = tails._signed_rank_counted(c, n)
        assert abs(tails._signed_rank_inverted(c, n) / counted - 1) < 1e-11
    for a, b, share in ((30, 40, 0.45), (20, 1000, 0.3), (200, 300, 0.2), (300, 300, 0.48), (12, 20_000, 0.1)):
        c = int(a * b * share)
        counted = tails._rank_sum_counted(c, a, b)
        assert abs(tails._rank_sum_inverted(c, a, b) / counted - 1) < 1e-10


def test_sides_of_many_thousands_end_in_seconds(spark):
    n, a, b = 100_000, 7_000, 8_000
    s, r = math.sqrt(n * (n + 1) * (2 * n + 1) / 24), math.sqrt(a * b * (a + b + 1) / 12)
    w, u = math.floor(n * (n + 1) / 4 - 2 * s), math.ceil(a * b / 2 + 2 * r)
    df = spark.createDataFrame([(n, float(w), a, b, float(u))], "n long, w double, a long, b long, u double")
    start = time.time()
    row = df.select(tails.signed_rank_p(F.col("w"), F.col("n")), tails.rank_sum_tail(F.col("u"), F.col("a"), F.col("b"))).first()
    assert time.time() - start < 30
    assert abs(row[0] - math.erfc(2 / math.sqrt(2))) < 1e-5 and abs(row[1] - 0.5 * math.erfc(2 / math.sqrt(2))) < 1e-5
    # Far out, doubles end.
    far = spark.createDataFrame([(n, 0.0), (None, 0.0), (3, None)], "n long, w double").select(tails.signed_rank_p(F.col("w"), F.col("n")).alias("p"))
    assert [x.p for x in far.collect()] == [0.0, None, None]
