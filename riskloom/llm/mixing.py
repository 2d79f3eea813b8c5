"""Mixing documents to target weights of soft domains.

A classifier trained on labelled documents gives each document a posterior over domains: a document may
belong partly to several. A document's rate is how often it is taken on average. Rates r minimise the
squared distance between the expected domain totals, sum of tokens * rate * posterior, and the targets,
with r >= ``at_least`` (0 or more), by accelerated projected gradient steps from r = 1. A document's step
is its gradient over its tokens and over the domain totals that its posterior sees, so short and long
documents, small and large domains move alike; a common factor keeps the scaled steps below the curvature.
The projection is that of each rate on its bound. Where targets cannot be reached, steps end at the
least-squares optimum: no rate above the bound has a gradient, and none at the bound wants to rise.

A step sums K + 2 numbers over the table of (tokens, posterior), which is pinned without the texts. A rate
follows from the posterior and the steps so far, K numbers each, so no rate has to be stored or joined.

With ``budget`` None the targets are set to the smallest total at which no domain has to shrink.
Documents without words have no tokens; they get the rate of their posterior, which then is the share of
each label. A domain without a stated weight keeps its share. Labels beyond ``MAX_DOMAINS`` values are
refused. Without labelled documents there is one domain, "all".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import sample_of_classes, split_words, table
from riskloom.llm.lexical import SparseModel, fit_softmax, restricted, softmax, telling, text_features, words_of
from riskloom.session import materialise

MAX_DOMAINS = 64
#: Features of the domain classifier.
FEATURES = 400
#: Shares of the tokens that each language should have.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


@dataclass
class DomainModel:
    names: list[str]
    words: SparseModel

    def posterior(self, text: str | Column) -> Column:
        """Probability of each domain, in the order of ``names``."""
        words = self.words

        @F.pandas_udf("array<double>")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(softmax(words.logits(texts))))

        return of(text)


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["label"], "features": [text_features(words_of(t)) for t in pdf["text"]]})


def fit_domains(docs: DataFrame, labels: DataFrame, label: str, per_domain: int = 2000) -> DomainModel:
    """Learn from at most ``per_domain`` labelled documents of each domain (``labels``: doc_id and ``label``)."""
    names = labels.select(F.col(label).cast("string").alias("name")).dropna().distinct().limit(MAX_DOMAINS + 1)
    names = sorted(r.name for r in names.collect())
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains in {label}")
    none = SparseModel(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(1))
    if not names:
        return DomainModel(["all"], none)
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label).cast("string")).cast("int") - 1
    sample = sample_of_classes(docs, labels.select("doc_id", at.alias("_y")), range(len(names)), per_domain)
    sample = materialise(sample.select("text", "label").mapInPandas(_featurise, "label int, features array<bigint>"), "sample")
    ids = telling(sample, len(names), least_df=20, chi2=50.0, most=FEATURES)
    y, rows = restricted(sample, ids, ["features"])
    if not len(y):
        return DomainModel(["all"], none)
    return DomainModel(names, fit_softmax(rows["features"], y, len(names), ids, l2=1e-3))


@dataclass
class Rates:
    """How a posterior becomes a rate: the gaps to the targets at each step, the momentum after it, the domain
    totals that scale a row's step, the bound, and the totals reached."""

    gaps: np.ndarray
    momentum: np.ndarray
    scale: np.ndarray
    at_least: float
    totals: np.ndarray
    targets: np.ndarray

    def walk(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rates, rates a step before, where the last step began) for rows of posteriors."""
        unit = 1.0 / np.maximum(posterior @ self.scale, 1e-300)
        now = before = at = np.full(len(posterior), max(1.0, self.at_least))
        ahead = at
        for gap, push in zip(self.gaps, self.momentum, strict=True):
            at, before = ahead, now
            now = np.maximum(self.at_least, at - unit * (posterior @ gap))
            ahead = now + push * (now - before)
        return now, before, at

    def of(self, posterior: Column) -> Column:
        @F.pandas_udf("double")
        def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in batches:
                yield pd.Series(self.walk(np.stack(p))[0] if len(p) else np.zeros(0))

        return rate(posterior)


def shares_of(names: list[str], weights: dict[str, float], totals: np.ndarray) -> np.ndarray:
    """Target share of each domain; one without a weight keeps its share, the others divide the rest."""
    own = totals / max(totals.sum(), 1e-300)
    stated = np.array([n in weights for n in names])
    given = np.array([max(float(weights.get(n, 0.0)), 0.0) for n in names])
    if not given.sum():
        return own
    return np.where(stated, given / given.sum() * (1.0 - own[~stated].sum()), own)


def fit_rates(
    mass: DataFrame,
    names: list[str],
    weights: dict[str, float],
    budget: float | None = None,
    at_least: float = 0.0,
    rounds: int = 200,
    tolerance: float = 1e-6,
) -> Rates:
    """Rates for the rows of ``mass`` (n_tokens, posterior). Each round is one aggregation to K + 2 numbers.

    Steps end when rows move by less than ``tolerance`` of the budget, or after ``rounds`` of them.
    """
    k = len(names)

    def sums(of_batch) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    tokens = batch.column("t").to_numpy(zero_copy_only=False)
                    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    yield pa.RecordBatch.from_pydict({f"s{i}": [float(x)] for i, x in enumerate(of_batch(tokens, p))})

        rows = mass.select(F.col("n_tokens").cast("double").alias("t"), F.col("posterior").alias("p"))
        out = rows.mapInArrow(partial, ", ".join(f"s{i} double" for i in range(k + 2)))
        return np.array([x or 0.0 for x in out.agg(*[F.sum(f"s{i}") for i in range(k + 2)]).first()])

    return descend(sums, names, weights, budget, at_least, rounds, tolerance)


def descend(sums, names: list[str], weights: dict[str, float], budget: float | None, at_least: float, rounds: int, tolerance: float) -> Rates:
    """The steps of ``fit_rates``; ``sums(f)`` adds up the K + 2 numbers that ``f`` (tokens, posteriors) gives for
    blocks of rows."""
    k = len(names)
    totals = sums(lambda t, p: [*(t @ p), 0.0, 0.0])[:k]
    share = shares_of(names, weights, totals)
    if budget is None:
        there = (share > 0) & (totals > 0)
        budget = float((totals[there] / share[there]).max()) if there.any() else float(totals.sum())
    targets = share * budget
    # A domain without tokens asks for nothing: it must not lift the rates of empty documents.
    scale = np.where(totals > 1e-9 * totals.sum(), totals, max(float(totals.sum()), 1.0))
    # Row sums bound the largest curvature of the scaled problem.
    curve = float(sums(lambda t, p: [*((t / np.maximum(p @ scale, 1e-300)) @ p), 0.0, 0.0])[:k].max(initial=0.0))
    reached = totals * max(1.0, at_least)
    rates = Rates(np.zeros((0, k)), np.zeros(0), scale, at_least, reached, targets)
    if not curve:
        return rates
    ahead, age = reached, 1.0
    for _ in range(rounds):
        gap = (ahead - targets) / curve
        rates = Rates(np.vstack([rates.gaps, gap]), np.append(rates.momentum, 0.0), scale, at_least, rates.totals, targets)

        def step(t: np.ndarray, p: np.ndarray, rates: Rates = rates) -> list[float]:
            now, before, at = rates.walk(p)
            uphill = (t * (p @ scale) * (at - now) * (now - before)).sum()
            return [*((t * now) @ p), uphill, (t * np.abs(now - at)).sum()]

        *new, uphill, moved = sums(step)
        new = np.array(new)
        older = 1.0 if uphill > 0 else age
        age = (1.0 + np.sqrt(1.0 + 4.0 * older * older)) / 2.0
        rates.momentum[-1] = push = (older - 1.0) / age
        ahead = new + push * (new - rates.totals)
        rates.totals = new
        if moved <= tolerance * max(budget, 1.0):
            break
    return rates


def n_tokens(text: str | Column) -> Column:
    """Tokens of a text as the mixture counts them: its words."""
    return F.size(split_words(F.col(text) if isinstance(text, str) else text)).cast("bigint")


def copies(rate: Column, key: Column) -> Column:
    """How often a row is taken: the rate's whole part, and one more with its fraction as probability."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit("copies")), 11).cast("double") / F.lit(float(1 << 53))
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of domains: documents that ``labels`` covers, with their language."""
    covered = labels.select("doc_id").dropna().distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).dropna().join(covered, "doc_id")


def measured(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Pinned (doc_id, row, n_tokens, posterior), row being a hash of id and text."""
    return materialise(
        docs.select(
            "doc_id", F.xxhash64("doc_id", "text").alias("row"), n_tokens("text").alias("n_tokens"),
            model.posterior("text").alias("posterior"),
        ),
        "posteriors",
    )


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = TARGETS, at_least: float = 1.0) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; from ``at_least`` 1 on no row is lost."""
    narrow = docs.select("doc_id", "text")
    model = fit_domains(narrow, labels, "domain")
    rates = fit_rates(measured(narrow, model), model.names, weights, at_least=at_least)
    row = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    rated = row.select("row", "key", rates.of(model.posterior(F.col("row.text"))).alias("rate"))
    times = rated.select("row", F.explode(F.array_repeat(F.lit(0), copies(F.col("rate"), F.col("key")).cast("int"))))
    return times.select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, posterior, rate and copies of every document, mixed to ``TARGETS`` by language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_domains(docs.select("doc_id", "text"), language_labels(docs, labels), "domain")
    mass = measured(docs.select("doc_id", "text"), model)
    rates = fit_rates(mass, model.names, TARGETS)
    rated = mass.withColumn("rate", rates.of(F.col("posterior")))
    return rated.select("doc_id", "n_tokens", "posterior", "rate", copies(F.col("rate"), F.col("row")).alias("copies"))
