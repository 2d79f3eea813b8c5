"""Repeatable draws: the same value on any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 15 hex digits of an md5 digest make a 60-bit number that fits a BIGINT.
HEX_DIGITS = 15


def draw_key(*parts: Column | str, seed: int) -> Column:
    """md5 of the parts and the seed joined by ``|``: a uniform sort key."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def draw_long(*parts: Column | str, seed: int) -> Column:
    """Uniform BIGINT in [0, 2^60)."""
    digits = F.substring(draw_key(*parts, seed=seed), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint")


def draw_unit(*parts: Column | str, seed: int) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return draw_long(*parts, seed=seed).cast("double") / F.lit(float(16**HEX_DIGITS))
