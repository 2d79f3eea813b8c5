"""Rates against a plain projected gradient, and the mixture's totals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing as M
from riskloom.llm.common import table
from tests.llm import odd


def optimum(t, p, targets, at_least):
    """The least residual of rates from ``at_least`` on, exactly, by an active set."""
    a = (p * t[:, None]).T
    want = targets - a.sum(axis=1) * at_least
    x, free = np.zeros(len(t)), []
    while True:
        slope = a.T @ (want - a @ x)
        slope[free] = -np.inf
        if slope.max() <= 1e-7 * np.abs(a).max() * np.abs(want).max():
            return np.linalg.norm(a @ x - want)
        free.append(int(slope.argmax()))
        while True:
            s = np.zeros(len(t))
            s[free] = np.linalg.lstsq(a[:, free], want, rcond=None)[0]
            low = [i for i in free if s[i] <= 0]
            if not low:
                break
            x += min(x[i] / (x[i] - s[i]) for i in low) * (s - x)
            free = [i for i in free if x[i] > 1e-12]
        x = s


def mass(spark, t, p):
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "n_tokens bigint, posterior array<double>")


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(1)
    t, p = rng.integers(0, 500, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    want = {"a": 0.5, "b": 0.3, "c": 0.2}
    rates = M.fit_rates(mass(spark, t, p), ["a", "b", "c"], want)
    assert np.allclose(rates.totals / rates.totals.sum(), [0.5, 0.3, 0.2], atol=1e-4)
    got = mass(spark, t, p).select("n_tokens", "posterior", rates.of(F.col("posterior")).alias("r")).collect()
    total = sum(x.n_tokens * x.r * np.array(x.posterior) for x in got)
    assert np.allclose(total, rates.targets, rtol=1e-4) and min(x.r for x in got) >= 0


@pytest.mark.parametrize("at_least,budget,want", [
    (0.0, 2000.0, [0.8, 0.2, 0.0]), (0.5, 5000.0, [0.8, 0.1, 0.1]), (0.0, 20000.0, [0.98, 0.01, 0.01]),
    (1.0, 3000.0, [0.2, 0.2, 0.6]), (0.9, 4500.0, [1.0, 0.0, 0.0]),
])
def test_steps_end_at_the_least_squares_optimum(at_least, budget, want):
    """None of these targets can be reached."""
    rng = np.random.default_rng(2)
    t, p = rng.integers(1, 100, 80).astype(float), rng.dirichlet([0.9, 0.9, 0.9], 80)
    sums = lambda f: np.array(f(t, p))
    best = optimum(t, p, np.array(want) * budget, at_least)
    off = []
    for rounds in (200, 800):
        rates = M.descend(sums, ["a", "b", "c"], dict(zip("abc", want, strict=True)), budget, at_least, rounds, 1e-9)
        r = rates.walk(p)[0]
        assert r.min() >= at_least and np.allclose((t * r) @ p, rates.totals)
        off.append(np.linalg.norm(rates.totals - rates.targets) - best)
    assert -1e-6 * budget < off[1] < 0.025 * budget and off[1] <= off[0] < 0.05 * budget


def test_an_unreachable_target_on_spark(spark):
    rng = np.random.default_rng(2)
    t, p = rng.integers(1, 100, 80).astype(float), rng.dirichlet([0.9, 0.9, 0.9], 80)
    rates = M.fit_rates(mass(spark, t, p), ["a", "b", "c"], {"a": 0.2, "b": 0.2, "c": 0.6}, 3000.0, 1.0)
    r = np.array([x.r for x in mass(spark, t, p).select(rates.of(F.col("posterior")).alias("r")).collect()])
    slope = p @ ((t * r) @ p - rates.targets) / (p @ rates.scale)
    # No rate at the bound wants to rise, and none above it has a gradient.
    assert r.min() >= 1.0 and slope.min() > -1e-3 and np.abs(slope[r > 1.001]).max(initial=0.0) < 1e-3


def test_nothing_is_lost_above_one(spark):
    rng = np.random.default_rng(3)
    t, p = rng.integers(1, 100, 80).astype(float), rng.dirichlet([0.4, 0.4], 80)
    rates = M.fit_rates(mass(spark, t, p), ["a", "b"], {"a": 0.9, "b": 0.1}, at_least=1.0)
    got = np.array([x.r for x in mass(spark, t, p).select(rates.of(F.col("posterior")).alias("r")).collect()])
    assert got.min() >= 1.0 and got.max() > 1.5 and (rates.totals > 0.999 * rates.targets).all()


def test_shares():
    totals = np.array([6.0, 2.0, 2.0])
    assert np.allclose(M.shares_of(["a", "b", "c"], {"a": 1, "b": 1}, totals), [0.4, 0.4, 0.2])
    assert np.allclose(M.shares_of(["a", "b", "c"], {}, totals), [0.6, 0.2, 0.2])


def test_languages_are_told_apart_and_mixed(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = M.fit_domains(docs.select("doc_id", "text"), M.language_labels(docs, labels), "domain")
    seen = docs.select("lang", M.n_tokens("text").alias("n"), model.posterior("text").alias("p")).where("n >= 30").collect()
    right = np.mean([model.names[int(np.argmax(r.p))] == r.lang for r in seen])
    assert right > 0.97 and all(abs(sum(r.p) - 1) < 1e-9 for r in seen)
    found = M.op6_mixing(spark, sf).collect()
    assert len(found) == docs.count()
    tokens = sum(r.n_tokens * r.rate * np.array(r.posterior) for r in found)
    assert np.allclose(tokens / tokens.sum(), [M.TARGETS[n] for n in model.names], atol=0.01)
    drawn, expected = sum(r.copies for r in found), sum(r.rate for r in found)
    assert abs(drawn - expected) < 4 * np.sqrt(len(found))


def test_odd_rows(spark):
    docs = odd.documents(spark)
    domains = M.language_labels(docs, odd.labels(spark))
    out = M.mixed(docs, domains)
    assert out.columns == docs.columns
    got, want = [r.text for r in out.collect()], [t for _, t in odd.TEXTS]
    assert all(got.count(t) >= want.count(t) for t in set(want))
    alone = M.mixed(docs, domains.limit(0))
    assert alone.count() == len(odd.TEXTS)
    assert M.mixed(odd.documents(spark, []), domains.limit(0)).count() == 0
