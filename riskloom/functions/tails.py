"""Tail probabilities of the normal law, as column expressions, and of rank statistics.

That of the normal law has an SQL form with the same steps, for the oracle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.binding import bind

# Below NEAR the complementary error function comes from the series of the error function, above from its
# continued fraction; so many terms give double precision there.
NEAR, SERIES, FRACTION = 1.5, 60, 150
ROOT_PI = math.sqrt(math.pi)


def _down(n: int) -> Column:
    return F.sequence(F.lit(n), F.lit(1), F.lit(-1))


def erfc(x: Column) -> Column:
    """Complementary error function in double precision; NaN for NaN, NULL for NULL."""

    def positive(a: Column) -> Column:
        # erf(a) = 2 / sqrt(pi) * exp(-a^2) * a * (1 + 2a^2/3 * (1 + 2a^2/5 * (1 + ...)))
        series = F.aggregate(_down(SERIES), F.lit(1.0), lambda s, n: 1.0 + s * (2.0 * a * a / (2.0 * n + 1.0)))
        near = 1.0 - 2.0 / ROOT_PI * F.exp(-a * a) * a * series
        # erfc(a) = exp(-a^2) / sqrt(pi) / (a + (1/2) / (a + (2/2) / (a + (3/2) / ...)))
        fraction = F.aggregate(_down(FRACTION), a, lambda t, n: a + n / 2.0 / t)
        return F.when(a < NEAR, near).otherwise(F.exp(-a * a) / (ROOT_PI * fraction))

    return bind(x.cast("double"), lambda v: F.when(v < 0, 2.0 - bind(-v, positive)).otherwise(bind(v, positive)))


def normal_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal law."""
    return 0.5 * erfc(z / math.sqrt(2.0))


def erfc_sql(x: str) -> str:
    """``erfc`` of a column or expression in SQL."""
    a = f"abs({x})"
    series = f"list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(range({SERIES}, 0, -1), lambda n: 2 * {a} * {a} / (2 * n + 1))), lambda s, f: 1 + s * f)"
    fraction = f"list_reduce(list_prepend({a}, list_transform(range({FRACTION}, 0, -1), lambda n: n / CAST(2 AS DOUBLE))), lambda t, h: {a} + h / t)"
    positive = f"CASE WHEN {a} < {NEAR} THEN 1 - {2 / ROOT_PI!r} * exp(-{a} * {a}) * {a} * {series} ELSE exp(-{a} * {a}) / ({ROOT_PI!r} * {fraction}) END"
    return f"(CASE WHEN {x} < 0 THEN 2 - ({positive}) ELSE {positive} END)"


def normal_tail_sql(z: str) -> str:
    return f"0.5 * {erfc_sql(f'(({z}) / {math.sqrt(2.0)!r})')}"


# Numbers of ways are counted up to so many array steps; beyond, probabilities come from the generating function.
COUNT_STEPS = 200_000_000
# So few values on a side are always counted: their law is far from normal.
FEW = 12
# Standard deviations that a law is followed to either side, and the size from which a term counts.
REACH, TINY = 14.0, 1e-19


def _rank_sum_counted(c: int, a: int, b: int) -> float:
    """P(U <= c) from the coefficients of the product of (1 - x^(b + i)) / (1 - x^i), cut behind c."""
    ways = np.zeros(c + 1)
    ways[0] = 1.0
    for i in range(1, a + 1):
        if b + i <= c:
            ways[b + i :] -= ways[: c + 1 - b - i].copy()
        rows = np.zeros(-(-(c + 1) // i) * i)
        rows[: c + 1] = ways
        ways = np.cumsum(rows.reshape(-1, i), axis=0).ravel()[: c + 1] * (i / (b + i))
    return float(ways.sum())


def _signed_rank_counted(c: int, n: int) -> float:
    """P(W <= c): every rank is in the sum or not, with probability one half."""
    ways = np.zeros(c + 1)
    ways[0] = 1.0
    for i in range(1, min(n, c) + 1):
        ways[i:] += ways[: c + 1 - i].copy()
        ways *= 0.5
    return float(np.ldexp(ways.sum(), -max(0, n - c)))


def _tilt(c: int, mean, start: float) -> float:
    """The s <= 0 for which the law with weights exp(s x) has its mean at ``c``; 0 from the mean on."""
    if c >= mean(0.0):
        return 0.0
    low = -abs(start)
    while mean(low) > c:
        low *= 2.0
    high = 0.0
    for _ in range(60):
        s = (low + high) / 2
        low, high = (s, high) if mean(s) < c else (low, s)
    return (low + high) / 2


def _by_inversion(c: int, s: float, log_mass: float, spread: float, law) -> float:
    """P(X <= c) of a lattice law by Fourier sums over the law tilted by exp(s x), whose mean is near ``c``.

    ``log_mass`` is the log of the tilted law's mass, ``spread`` its standard deviation and ``law`` its
    characteristic function. The period of the sum exceeds what the tilted law covers up to ``REACH``
    deviations, so nothing is approximated but masses below 1e-20 of the result.
    """
    scale = log_mass - s * c
    if scale < -745.0:  # an upper bound of the log; below the smallest double
        return 0.0
    held = min(c + 1, math.ceil(REACH * spread))
    period = held + math.ceil(REACH * spread)
    total, first = 0.0, 0
    while first <= period // 2:
        t = np.arange(first, min(first + 32, period // 2 + 1))
        theta = 2.0 * np.pi * t / period
        z = s + 1j * theta
        with np.errstate(invalid="ignore", divide="ignore"):
            near = np.where(z == 0, held, np.expm1(z * held) / np.expm1(z))
        # c * theta is a multiple of 2 pi / period, reduced in whole numbers.
        turn = np.exp(-2j * np.pi * ((t * (c % period)) % period) / period)
        terms = (law(theta) * turn * near).real * np.where((t == 0) | (2 * t == period), 1.0, 2.0)
        total += float(terms.sum())
        if np.abs(terms).max() < TINY * period:
            break
        first += 32
    return max(0.0, total / period * math.exp(scale))


def _product(theta: np.ndarray, size: int, factor) -> np.ndarray:
    """Product over 1 to ``size`` of ``factor(numbers, theta)``, some thousand numbers at a time."""
    out = np.ones(len(theta), dtype=complex)
    for first in range(1, size + 1, 8192):
        out *= factor(np.arange(first, min(first + 8192, size + 1))[:, None], theta[None, :]).prod(axis=0)
    return out


def _rank_sum_inverted(c: int, a: int, b: int) -> float:
    i = np.arange(1, a + 1, dtype=float)

    def bend(x):  # coth(x / 2) / 2 - 1 / x
        small = np.abs(x) < 0.05
        y = np.where(small, 1.0, x)
        return np.where(small, x / 12 - x**3 / 720, 0.5 / np.tanh(y / 2) - 1 / y)

    def mean(s):
        return a * b / 2 + float(((b + i) * bend((b + i) * s) - i * bend(i * s)).sum())

    deviation = math.sqrt(a * b * (a + b + 1) / 12)
    s = _tilt(c, mean, 1 / deviation)
    step = 1e-3 / deviation
    spread = math.sqrt((mean(s + step) - mean(s - step)) / (2 * step))
    whole = lambda j: np.expm1((b + j) * s) / np.expm1(j * s) if s else (b + j) / j
    log_mass = float(np.log(whole(i) * i / (b + i)).sum())

    def factor(j, theta):
        z = s + 1j * theta
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(z == 0, 1.0, np.expm1((b + j) * z) / np.expm1(j * z) / whole(j))

    return _by_inversion(c, s, log_mass, spread, lambda theta: _product(theta, a, factor))


def _signed_rank_inverted(c: int, n: int) -> float:
    j = np.arange(1, n + 1, dtype=float)
    share = lambda s, k: 1.0 / (1.0 + np.exp(-s * k))
    s = _tilt(c, lambda s: float((j * share(s, j)).sum()), n**-1.5)
    p = share(s, j)
    spread = math.sqrt(float((j * j * p * (1 - p)).sum()))
    log_mass = float(np.log((1.0 + np.exp(s * j)) / 2).sum())

    def factor(k, theta):
        p = share(s, k)
        return 1.0 - p + p * np.exp(1j * theta * k)

    return _by_inversion(c, s, log_mass, spread, lambda theta: _product(theta, n, factor))


def rank_sum_upper(u: float, n1: int, n2: int) -> float:
    """P(U >= u) of untied samples of the given sizes; 1 if a side is empty."""
    a, b = sorted((int(n1), int(n2)))
    first = math.ceil(u - 1e-9)

    def lower(c: int) -> float:
        if c < 0:
            return 0.0
        if a < FEW or a * (c + 1) <= COUNT_STEPS:
            return _rank_sum_counted(c, a, b)
        return _rank_sum_inverted(c, a, b)

    if first > a * b:
        return 0.0
    return lower(a * b - first) if 2 * first > a * b else 1.0 - lower(first - 1)


def signed_rank_two_sided(w: float, n: int) -> float:
    """Two-sided probability of a signed-rank sum of ``n`` untied pairs at most ``w``."""
    c, n = math.floor(w), int(n)
    most = n * (n + 1) // 2
    if c < 0:
        return 0.0
    if 2 * c >= most:
        return 1.0
    return min(1.0, 2.0 * (_signed_rank_counted(c, n) if (c + 1) * n <= COUNT_STEPS else _signed_rank_inverted(c, n)))


def _each(fn, *columns: pd.Series) -> pd.Series:
    """``fn`` by row; NULL if a value is missing, NaN if one is."""
    cells = zip(*columns, strict=True)
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in cells], dtype="float64")


def rank_sum_tail(u: Column, n1: Column, n2: Column) -> Column:
    """P(U >= u) of untied samples of the given sizes, one row at a time in whatever task holds it.

    Ways are counted while the smaller side times the values in the tail stay within ``COUNT_STEPS``. Larger
    laws are summed from their generating function: the work is in proportion to the sizes, to double precision.
    """
    return F.pandas_udf(lambda *s: _each(rank_sum_upper, *s), "double")(u.cast("double"), n1.cast("bigint"), n2.cast("bigint"))


def signed_rank_p(w: Column, n: Column) -> Column:
    """Two-sided probability of a signed-rank sum of ``n`` untied pairs at most ``w``; see ``rank_sum_tail``."""
    return F.pandas_udf(lambda *s: _each(signed_rank_two_sided, *s), "double")(w.cast("double"), n.cast("bigint"))
