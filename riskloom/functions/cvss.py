"""CVSS version 2: base score, severity band, vector parts and label errors, as columns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.binding import bind

# Metric weights of the published version 2 equations.
WEIGHTS = {
    "AV": {"L": "0.395", "A": "0.646", "N": "1.000"},
    "AC": {"H": "0.350", "M": "0.610", "L": "0.710"},
    "Au": {"M": "0.450", "S": "0.560", "N": "0.704"},
    "C": {"N": "0.000", "P": "0.275", "C": "0.660"},
    "I": {"N": "0.000", "P": "0.275", "C": "0.660"},
    "A": {"N": "0.000", "P": "0.275", "C": "0.660"},
}

# Task names in the order of the vector parts; the severity band is the last.
VECTOR_TASKS = [
    "cvss2_accessvect", "cvss2_accesscomp", "cvss2_auth",
    "cvss2_conf", "cvss2_integrity", "cvss2_avail", "cvss2_severity",
]

# Task names in report order.
TASKS = [
    "cvss2_conf", "cvss2_integrity", "cvss2_avail", "cvss2_accessvect",
    "cvss2_accesscomp", "cvss2_auth", "cvss2_severity",
]

# Label scales of the ordinal tasks.
SCALES = {
    "cvss2_accesscomp": ["LOW", "MEDIUM", "HIGH"],
    "cvss2_severity": ["LOW", "MEDIUM", "HIGH"],
    "cvss2_conf": ["NONE", "PARTIAL", "COMPLETE"],
    "cvss2_avail": ["NONE", "PARTIAL", "COMPLETE"],
    "cvss2_integrity": ["NONE", "PARTIAL", "COMPLETE"],
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _dec(value: str) -> Column:
    return F.lit(Decimal(value))


def metric_of(vector: Column | str, name: str) -> Column:
    """Value letter of one metric of a vector, NULL when absent."""
    return F.nullif(F.regexp_extract(_c(vector), f"(?:^|/|\\(){name}:([A-Z])", 1), F.lit(""))


def _weight(vector: Column, name: str) -> Column:
    pairs = [x for letter, w in WEIGHTS[name].items() for x in (F.lit(letter), _dec(w))]
    return F.element_at(F.create_map(*pairs), metric_of(vector, name)).cast("decimal(4,3)")


def base_score(vector: Column | str) -> Column:
    """Base score (one decimal, half up) in exact decimal arithmetic; NULL for a broken vector."""
    return bind(_c(vector), _score)


def _score(vector: Column) -> Column:
    w = {m: _weight(vector, m) for m in WEIGHTS}
    one = _dec("1.000")
    kept = ((one - w["C"]) * (one - w["I"])).cast("decimal(12,6)") * (one - w["A"])
    impact = (_dec("10.41") * (one - kept.cast("decimal(14,9)"))).cast("decimal(18,11)")
    reach = (_dec("20") * w["AV"] * w["AC"]).cast("decimal(14,6)") * w["Au"]
    rest = (_dec("0.4") * reach.cast("decimal(18,9)") - _dec("1.5")).cast("decimal(18,11)")

    def score(i: Column) -> Column:
        factor = F.when(i == 0, _dec("0.000")).otherwise(_dec("1.176"))
        return F.round((_dec("0.6") * i + rest).cast("decimal(18,12)") * factor, 1).cast("double")

    return bind(impact, score)


def severity_band(score: Column | str) -> Column:
    """LOW below 4, MEDIUM below 7, HIGH up to 10, else UNKNOWN."""
    return bind(
        _c(score),
        lambda s: F.when((s >= 0) & (s < 4), "LOW")
        .when((s >= 4) & (s < 7), "MEDIUM")
        .when((s >= 7) & (s <= 10), "HIGH")
        .otherwise("UNKNOWN"),
    )


def vector_parts(vector: Column | str) -> Column:
    """Array of (task, part): the six vector parts in order, then the severity band."""
    names = F.array(*[F.lit(t) for t in VECTOR_TASKS])

    def parts(v: Column) -> Column:
        values = F.concat(F.split(v, "/"), F.array(severity_band(base_score(v))))
        return F.zip_with(names, values, lambda t, part: F.struct(t.alias("task"), part.alias("part")))

    return bind(_c(vector), parts)


def _partial(truth: Column, pred: Column, scale: Sequence[str]) -> Column:
    steps = F.array(*[F.lit(s) for s in scale])
    a, b = F.array_position(steps, truth), F.array_position(steps, pred)
    gap = F.abs(a - b)
    return (
        F.when((truth == "-") | (pred == "-"), 0.0)
        .when((a > 0) & (b > 0) & (gap == 1), 0.5)
        .otherwise(1.0)
    )


def label_error(task: str, truth: Column | str, pred: Column | str, kind: str) -> Column:
    """Error of one task: ``abs`` is 0 or 1; ``partial`` gives half for one step on a scale."""
    truth, pred = _c(truth), _c(pred)
    if kind == "abs":
        wrong = F.lit(1.0)
    elif kind == "partial":
        wrong = _partial(truth, pred, SCALES[task]) if task in SCALES else F.lit(1.0)
    else:
        raise ValueError(f"unknown kind: {kind}")
    return F.when(truth.eqNullSafe(pred), 0.0).otherwise(wrong)


def cvss_error(kind: str = "abs", extra: Sequence[str] = (), suffix: str = "_pred") -> Column:
    """Sum of the label errors over all tasks (and extra ones) of a row."""
    parts = [label_error(t, t, t + suffix, kind) for t in [*TASKS, *extra]]
    return reduce(lambda a, b: a + b, parts)
