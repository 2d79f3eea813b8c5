"""Comparing two sets of runs: rank tests and effect sizes per scenario and metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.draws import draw_key
from riskloom.functions.tails import normal_tail, rank_sum_tail, signed_rank_p
from riskloom.operators.ranks import average_ranks, keyed_position
from riskloom.session import materialise

# Exact distributions are used up to these sizes when nothing is tied, as usual for both tests.
EXACT_RANK_SUM = 8
EXACT_SIGNED = 50


def _exact(method: str, usual: Column) -> Column:
    """Whether the exact distribution is used: ``auto`` where that is usual, else as told."""
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"unknown method: {method}")
    return usual if method == "auto" else F.lit(method == "exact")


def mann_whitney(
    runs: DataFrame, keys: Sequence[str], side: str = "side", value: str = "value", alternative: str | None = None,
    method: str = "auto",
) -> DataFrame:
    """Rank-sum test of side A against side B per keys, with continuity and tie correction.

    ``method`` chooses p: ``auto`` takes the exact distribution if nothing is tied and one side has at most
    EXACT_RANK_SUM values, however many the other has; ``exact`` and ``asymptotic`` always take theirs.
    A side without values gives NULL for z and p.

    Without ``alternative``, the test asks for "greater" where the mean of A is below that of B,
    and for "less" otherwise.
    """
    work = runs.select(
        *keys,
        value,
        F.when(F.col(side) == "A", 1).otherwise(0).cast("bigint").alias("na"),
        F.when(F.col(side) == "B", 1).otherwise(0).cast("bigint").alias("nb"),
    )
    ranked = average_ranks(work, value, ["na", "nb"], keys)
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("na")).alias("ra"),
        F.sum("na").alias("n_a"),
        F.sum("nb").alias("n_b"),
        F.sum(F.col(value) * F.col("na")).alias("sa"),
        F.sum(F.col(value) * F.col("nb")).alias("sb"),
        F.sum(t * t * t - t).alias("tie_sum"),
    )
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    sums = sums.select(
        *keys,
        "n_a",
        "n_b",
        F.try_divide(F.col("sa"), a).alias("mean_a"),
        F.try_divide(F.col("sb"), b).alias("mean_b"),
        (F.col("ra") - a * (a + 1) / 2).alias("u"),
        "tie_sum",
        F.sqrt(a * b / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("tie_sum"), n * (n - 1)), F.lit(0.0)))).alias("_s"),
    )
    if alternative is None:
        alt = F.when(F.col("mean_a") < F.col("mean_b"), "greater").otherwise("less")
    elif alternative in ("greater", "less", "two-sided"):
        alt = F.lit(alternative)
    else:
        raise ValueError(f"unknown alternative: {alternative}")
    sums = sums.withColumn("alternative", alt)
    other = F.col("n_a") * F.col("n_b") - F.col("u")
    used = (
        F.when(F.col("alternative") == "greater", F.col("u"))
        .when(F.col("alternative") == "less", other)
        .otherwise(F.greatest(F.col("u"), other))
    )
    half = F.col("n_a") * F.col("n_b") / 2
    sums = sums.withColumn("_used", used).withColumn(
        "z", F.when(F.col("_s") > 0, (F.col("_used") - half - 0.5) / F.col("_s"))
    )
    fewer = F.least("n_a", "n_b")
    exact = _exact(method, (fewer <= EXACT_RANK_SUM) & (F.col("tie_sum") == 0))
    # A spread of 0 leaves z undefined.
    # Rows that take the other way are NULL to the exact one, which does no work for them.
    tail = F.when(exact, rank_sum_tail(F.when(exact, F.col("_used")), F.col("n_a"), F.col("n_b"))).otherwise(F.coalesce(normal_tail(F.col("z")), F.lit(float("nan"))))
    p = F.when(F.col("alternative") == "two-sided", F.least(F.lit(1.0), 2.0 * tail)).otherwise(tail)
    p = F.when(fewer > 0, p)
    return sums.select(*keys, "n_a", "n_b", "mean_a", "mean_b", "alternative", "u", "z", p.alias("p"))


def _paired(runs, keys, side, value, order, seed) -> DataFrame:
    """Rows of A and B paired by place; the larger side is first drawn down to the smaller."""
    # One row per keys; written out, so Spark knows its size and broadcasts it when it is small.
    sizes = materialise(
        runs.groupBy(*keys).agg(
            F.count(F.when(F.col(side) == "A", 1)).alias("_na"), F.count(F.when(F.col(side) == "B", 1)).alias("_nb")
        ),
        "sizes",
    )
    work = runs.select(*keys, side, value, *order).join(sizes, list(keys))
    mine = F.when(F.col(side) == "A", F.col("_na")).otherwise(F.col("_nb"))
    least = F.least("_na", "_nb")
    draw = F.when(mine > least, draw_key(*order, seed=seed)).otherwise(F.lit(""))
    placed = keyed_position(work.withColumn("_draw", draw), ["_draw", *order], [*keys, side], "_at")
    kept = placed.filter(F.col("_at") < least)
    pair = kept.groupBy(*keys, "_at").agg(
        F.max(F.when(F.col(side) == "A", F.col(value))).alias("a"),
        F.max(F.when(F.col(side) == "B", F.col(value))).alias("b"),
    )
    return pair


def wilcoxon(
    runs: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    side: str = "side",
    value: str = "value",
    seed: int = 42,
    method: str = "auto",
) -> DataFrame:
    """Signed-rank test per keys. Equal sides pair by ``order``; a larger side is sampled first.

    ``method`` chooses p: ``auto`` takes the exact distribution up to EXACT_SIGNED pairs without ties and
    zeros, as usual; ``exact`` and ``asymptotic`` always take theirs.
    """
    pair = _paired(runs, keys, side, value, order, seed)
    diff = pair.withColumn("_d", F.col("a") - F.col("b")).select(
        *keys,
        F.abs("_d").alias("size"),
        F.when(F.col("_d") > 0, 1).otherwise(0).cast("bigint").alias("up"),
        F.when(F.col("_d") < 0, 1).otherwise(0).cast("bigint").alias("down"),
        F.when(F.col("_d") == 0, 1).otherwise(0).cast("bigint").alias("zero"),
    )
    zeros = diff.groupBy(*keys).agg(F.sum("zero").alias("zeros"))
    ranked = average_ranks(diff.filter(F.col("zero") == 0), "size", ["up", "down"], keys)
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("ties").alias("n"),
        F.sum(F.col("rank") * F.col("up")).alias("up"),
        F.sum(F.col("rank") * F.col("down")).alias("down"),
        F.sum(t * t * t - t).alias("tie_sum"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_sum") / 2) / 24)
    w = F.least("up", "down")
    out = zeros.join(sums, list(keys), "left").select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        "zeros",
        w.alias("w"),
        F.try_divide(w - n * (n + 1) / 4, spread).alias("z"),
        "tie_sum",
    )
    exact = _exact(method, (n <= EXACT_SIGNED) & (F.col("zeros") == 0) & (F.col("tie_sum") == 0)) & (n > 0)
    two_sided = F.least(F.lit(1.0), 2.0 * normal_tail(F.abs("z")))
    p = F.when(exact, signed_rank_p(F.when(exact, F.col("w")), F.col("n"))).otherwise(F.coalesce(two_sided, F.lit(float("nan"))))
    return out.select(*keys, "n", "zeros", "w", "z", p.alias("p"))


def cohen_d(runs: DataFrame, keys: Sequence[str], side: str = "side", value: str = "value") -> DataFrame:
    """Absolute difference of means over the pooled standard deviation, per keys."""
    a, b = (F.when(F.col(side) == s, F.col(value)) for s in ("A", "B"))
    agg = runs.groupBy(*keys).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"),
    )
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(F.try_divide((na - 1) * F.col("va") + (nb - 1) * F.col("vb"), na + nb - 2))
    d = F.try_divide(F.abs(F.col("mean_a") - F.col("mean_b")), pooled)
    return agg.select(*keys, "n_a", "n_b", "mean_a", "mean_b", F.when(pooled > 0, d).alias("cohen_d"))


def stack_runs(
    a: DataFrame,
    b: DataFrame,
    metrics: Sequence[str],
    order: Sequence[str],
    scenario: str = "scenario",
    scenarios: Sequence[str] | None = None,
) -> DataFrame:
    """Both run tables in long form: scenario (each, and ``overall``), metric, side, order, value.

    ``overall`` covers all rows; ``scenarios`` limits the separate scenarios that are reported.
    """
    def long(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        own = F.col(scenario)
        names = F.array(own, F.lit("overall"))
        if scenarios is not None:
            names = F.when(own.isin(*scenarios), names).otherwise(F.array(F.lit("overall")))
        out = df.select(F.col(scenario).alias("_own"), *order, F.explode(names).alias("scenario"), cells.alias("_c"))
        return out.select("scenario", "_own", *order, F.lit(side).alias("side"), F.inline("_c"))

    return long(a, "A").unionByName(long(b, "B"))


def compare_runs(
    a: DataFrame,
    b: DataFrame,
    order: Sequence[str],
    metrics: Sequence[str] = ("mcc", "f1"),
    scenario: str = "scenario",
    scenarios: Sequence[str] | None = None,
    names: tuple[str, str] = ("A", "B"),
    alternative: str | None = None,
) -> DataFrame:
    """Means, sizes, rank-sum p, signed-rank p and Cohen's d per scenario and metric.

    The raw values behind each row stay rows: ``stack_runs`` gives them by the same keys.
    """
    runs = stack_runs(a, b, metrics, order, scenario, scenarios)
    keys = ["scenario", "metric"]
    ranks = mann_whitney(runs, keys, alternative=alternative)
    signed = wilcoxon(runs, keys, ["_own", *order])
    size = cohen_d(runs, keys)
    out = (
        size.join(ranks.select(*keys, "alternative", "u", F.col("z").alias("mw_z"), F.col("p").alias("mw_p")), keys, "left")
        .join(signed.select(*keys, "w", F.col("z").alias("wilcoxon_z"), F.col("p").alias("wilcoxon_p")), keys, "left")
        .withColumns({"a": F.lit(names[0]), "b": F.lit(names[1])})
    )
    return out
