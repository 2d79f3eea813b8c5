"""Toxicity: a linear classifier of words that is told not to care which group a sentence names.

Training adds to the logistic loss the squared change of a text's score when identity terms in it are
swapped for others of the same kind ("women" for "men"). A term that stands in toxic and harmless
sentences alike so cannot collect weight from its company, and neutral mentions stay below the threshold.

The model is fitted on a bounded sample of labelled documents (``per_class`` of each class); scoring reads
every word of every text. NULL and empty texts score the bias. Without any labelled row, or with one class
only, every text gets the smoothed share of toxic labels (0.25 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import class_counts, fold_of, labelled_sample, table
from riskloom.llm.lexical import (
    SparseModel,
    columns,
    fit_softmax,
    restricted,
    telling,
    text_features,
    words_of,
)
from riskloom.session import materialise

#: Identity terms by kind; a swap takes the next term of the kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"),
    ("mothers", "fathers"), ("wives", "husbands"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"), ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees", "foreigners"), ("immigrant", "native", "refugee", "foreigner"),
    ("old", "young"), ("elderly", "teenagers"), ("disabled", "deaf", "blind"), ("poor", "rich"),
    ("mexican", "american", "chinese", "indian", "german", "french", "russian", "polish", "turkish"),
)

_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass
class ToxicityModel:
    """Word weights and the log-odds to add for the share of each class outside the balanced sample."""

    words: SparseModel
    offset: float

    def scores(self, texts) -> np.ndarray:
        z = self.words.logits(texts)
        return 1.0 / (1.0 + np.exp(-np.clip(z[:, 1] - z[:, 0] + self.offset, -700, 700)))


def swapped(words: set[str], terms=IDENTITY_TERMS) -> set[str]:
    """The words of a sentence with each identity term replaced by the next of its kind."""
    turn = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    return {turn.get(w, w) for w in words}


def _featurise(terms):
    names = {t for kind in terms for t in kind}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, y in zip(pdf["text"], pdf["label"], strict=True):
                lost, won = set(), set()
                if words_of(text) & names:
                    for sentence in _SENTENCE.findall(text):
                        before = words_of(sentence)
                        if before & names:
                            a = set(text_features(before).tolist())
                            b = set(text_features(swapped(before, terms)).tolist())
                            lost |= a - b
                            won |= b - a
                out.append((int(y), text_features(words_of(text)), sorted(lost - won), sorted(won - lost)))
            yield pd.DataFrame(out, columns=["label", "features", "lost", "won"])

    return rows


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    train: Column | None = None,
    per_class: int = 6000,
    pair_weight: float = 1.0,
    terms=IDENTITY_TERMS,
) -> ToxicityModel:
    """Learn from at most ``per_class`` labelled documents of each class for which ``train`` holds."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, label, per_class, train)
    kind = "label int, features array<bigint>, lost array<bigint>, won array<bigint>"
    sample = materialise(sample.select("text", "label").mapInPandas(_featurise(terms), kind), "sample")
    n0, n1 = class_counts(labels, label, train)
    true = np.log((n1 + 0.5) / (n0 + 0.5 if n0 + n1 else 1.5))
    ids = telling(sample, 2, least_df=6, chi2=20.0)
    y, rows = restricted(sample, ids, ["features", "lost", "won"])
    if len(set(y.tolist())) < 2:
        return ToxicityModel(SparseModel(np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(2)), float(true))
    x, lost, won = rows["features"], rows["lost"], rows["won"]
    with_pair = [i for i in range(len(y)) if len(lost[i]) or len(won[i])]
    (p0, c0), (p1, c1) = (columns([side[i] for i in with_pair], ids) for side in (lost, won))
    sign = np.concatenate([-np.ones(len(c0)), np.ones(len(c1))])
    pairs = (np.concatenate([p0, p1]), np.concatenate([c0, c1]), sign, len(with_pair))
    words = fit_softmax(x, y, 2, ids, l2=3e-4, pairs=pairs, pair_weight=pair_weight)
    sampled = np.log(((y == 1).sum() + 0.5) / ((y == 0).sum() + 0.5))
    return ToxicityModel(words, float(true - sampled))


def score(text: str | Column, model: ToxicityModel) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return of(text)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores below ``threshold``."""
    row = docs.select(F.struct("*").alias("row"))
    scored = row.select("row", score(F.col("row.text"), model).alias("score"))
    return scored.where(F.col("score") < threshold).select("row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of fold 0 of 5 (by crc32 of the id) are never read for training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = fold_of(F.col("doc_id"), 5)
    model = fit(docs, labels, train=fold != 0)
    return docs.select("doc_id", (fold == 0).alias("held_out"), score("text", model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
