import itertools
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.functions.cvss import TASKS, WEIGHTS, base_score, cvss_error, label_error, severity_band, vector_parts


def published(vector):
    w = {k: Decimal(WEIGHTS[k][v]) for k, v in (p.split(":") for p in vector.split("/"))}
    impact = Decimal("10.41") * (1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"]))
    reach = 20 * w["AV"] * w["AC"] * w["Au"]
    factor = Decimal("0") if impact == 0 else Decimal("1.176")
    score = (Decimal("0.6") * impact + Decimal("0.4") * reach - Decimal("1.5")) * factor
    return float(score.quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def test_all_vectors(spark):
    names = list(WEIGHTS)
    vectors = ["/".join(f"{n}:{v}" for n, v in zip(names, vs)) for vs in itertools.product(*[WEIGHTS[n] for n in names])]
    df = spark.createDataFrame([(v,) for v in vectors], "v string")
    got = {r["v"]: r["s"] for r in df.select("v", base_score("v").alias("s")).collect()}
    assert len(got) == 729 and all(got[v] == published(v) for v in vectors)
    assert got["AV:N/AC:L/Au:N/C:P/I:P/A:P"] == 7.5 and got["AV:N/AC:L/Au:N/C:C/I:C/A:C"] == 10.0


def test_broken_vector_is_unknown(spark):
    r = spark.createDataFrame([("AV:N/AC:L",)], "v string").select(base_score("v").alias("s"), severity_band(base_score("v")).alias("b")).first()
    assert r["s"] is None and r["b"] == "UNKNOWN"


@pytest.mark.parametrize("score, band", [(0.0, "LOW"), (3.9, "LOW"), (4.0, "MEDIUM"), (6.9, "MEDIUM"), (7.0, "HIGH"), (10.0, "HIGH"), (11.0, "UNKNOWN"), (None, "UNKNOWN")])
def test_bands(spark, score, band):
    assert spark.createDataFrame([(score,)], "s double").select(severity_band("s").alias("b")).first()["b"] == band


def test_parts_in_order(spark):
    r = spark.createDataFrame([("AV:N/AC:L/Au:N/C:P/I:P/A:P",)], "v string").select(F.inline(vector_parts("v"))).collect()
    assert [(x["task"], x["part"]) for x in r][0] == ("cvss2_accessvect", "AV:N")
    assert [(x["task"], x["part"]) for x in r][-1] == ("cvss2_severity", "HIGH")


@pytest.mark.parametrize(
    "task, a, b, want",
    [
        ("cvss2_severity", "LOW", "MEDIUM", 0.5), ("cvss2_severity", "LOW", "HIGH", 1.0), ("cvss2_severity", "LOW", "-", 0.0),
        ("cvss2_conf", "COMPLETE", "PARTIAL", 0.5), ("cvss2_conf", "NONE", "COMPLETE", 1.0), ("cvss2_conf", "NONE", "odd", 1.0),
        ("cvss2_auth", "NONE", "SINGLE", 1.0), ("cvss2_auth", "-", "SINGLE", 1.0), ("cvss2_avail", "NONE", "NONE", 0.0),
    ],
)
def test_partial_error(spark, task, a, b, want):
    df = spark.createDataFrame([(a, b)], "t string, p string")
    assert df.select(label_error(task, "t", "p", "partial").alias("e")).first()["e"] == want
    assert df.select(label_error(task, "t", "p", "abs").alias("e")).first()["e"] == float(a != b)


def test_error_sums_tasks_and_extras(spark):
    row = {t: "LOW" for t in TASKS} | {f"{t}_pred": "LOW" for t in TASKS} | {"cwe": "a", "cwe_pred": "b", "cvss2_severity_pred": "MEDIUM"}
    df = spark.createDataFrame([row])
    r = df.select(cvss_error("abs").alias("a"), cvss_error("partial", ["cwe"]).alias("p")).first()
    assert (r["a"], r["p"]) == (1.0, 1.5)
