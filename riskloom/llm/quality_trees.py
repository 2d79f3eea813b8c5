"""Quality classifier: histogram-boosted trees over document statistics.

Statistics are ratios of counts of the whole text (``statistics.COUNTS``), computed by built-in expressions
and pinned once without the texts; labels, language, source and id are not among them. Trees are trained on
at most ``per_class`` labelled documents of each class and applied to Arrow batches.

NULL and empty texts have all counts zero and a score like any other. Without labels every document scores
one half, with one class only that class' smoothed share. Repeated rows are scored each; an id labelled
twice counts by its larger label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import boosting
from riskloom.llm.common import class_counts, fold_of, table
from riskloom.llm.statistics import COUNTS, with_counts
from riskloom.session import materialise


def ratios(c: np.ndarray) -> np.ndarray:
    """Feature rows from count rows, both in the order of their names."""
    v = dict(zip(COUNTS, c.T.astype(float), strict=True))
    words, chars = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1)
    lines, everything = np.maximum(v["n_lines"], 1), np.maximum(v["n_chars_all"], 1)
    return np.stack(
        [
            np.log1p(v["n_words"]), v["word_chars"] / words, v["n_symbols"] / words, v["n_dup_lines"] / lines,
            v["n_repeat_words"] / words, v["n_words"] / lines, v["n_distinct"] / words, v["n_upper"] / chars,
            v["n_digits"] / chars, v["n_marks"] / words, v["word_chars"] / everything, np.log1p(v["longest"]),
            v["n_bars"] / words, v["n_odd"] / words, np.log1p(v["n_lines"]),
        ],
        axis=1,
    )


def measured(docs: DataFrame) -> DataFrame:
    """Pinned doc_id and counts of each row of ``docs``."""
    return materialise(with_counts(docs), "counts")


def fit(counts: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, per_class: int = 10_000) -> boosting.Trees:
    """Trees from a bounded sample of the rows of ``counts`` whose id is in ``labels`` and satisfies ``train``."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("_y")).dropna()
    ids = ids.where(train) if train is not None else ids
    ids = ids.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    known = counts.join(ids, "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", *COUNTS]
    got = [r for y in (0, 1) for r in known.where(F.col("_y") == y).orderBy(*order).limit(per_class).select("_y", *COUNTS).collect()]
    data = np.array([tuple(r) for r in got], dtype=np.int64).reshape(-1, 1 + len(COUNTS))
    n0, n1 = class_counts(labels, label, train)
    prior = (n1 + 0.5) / (n0 + n1 + 1.0)
    return boosting.fit(ratios(data[:, 1:]), data[:, 0], prior=prior)


def score(model: boosting.Trees) -> Column:
    """Probability of class 1, from the columns ``COUNTS``."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(model.scores(ratios(np.stack([c.to_numpy() for c in cols], axis=1))))

    return of(*COUNTS)


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of fold 2 of 4 (by crc32 of the id) are never read for training."""
    counts = measured(table(spark, sf_dir, "documents"))
    fold = fold_of(F.col("doc_id"), 4)
    model = fit(counts, table(spark, sf_dir, "labels"), train=fold != 2)
    scored = counts.select("doc_id", (fold == 2).alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
