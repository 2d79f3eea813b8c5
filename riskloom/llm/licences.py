"""Licence scans: a trained paragraph classifier, confirmed by templates, in DataFrame operations only.

A paragraph is a line with a word. It is judged in windows of at most three times ``STEP`` words that overlap by
two thirds, so that a notice in a line of any length lies whole in a window that holds little else. Logistic
regression over hashed word 1- to 3-grams (Spark ML on sparse vectors) gives a window a probability for every
licence family and for "unknown". It is trained on the templates themselves and on windows of a bounded sample of
documents: those that hold nearly all of a template's words in order teach its family, all others teach "unknown".
A window is believed from a threshold on: what at most ``FALSE_SHARE`` of all unknown windows outside the sample
reach, and one half at least; it is compared with the sum over all families, so that a window with several notices
is believed. Every family of a believed window is confirmed if it contains ``CONTAINED`` of the word 3-grams of one
of the family's templates.

Windows lie side by side over every line, so that each word is scored, and more of them around each anchor. Anchors
are words of the templates, the rarest in the sample, and so many that a text without any of them lacks too many
3-grams of every template to be confirmed: around them a notice lies whole in a window, and only windows with one
are compared with the templates.

Lines of every text are looked at, whole. NULL and empty texts have no paragraphs. Rows that repeat an id or
a text each get their row. Further columns are ignored. On an empty table the templates alone teach.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.binding import bind
from riskloom.llm.common import ascii_lower, split_words, table
from riskloom.session import materialise

# Notices by which licence families are recognised.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",),
    "cc-by": ("Licensed under a Creative Commons Attribution 4.0 International License.",),
    "reserved": ("All rights reserved.",),
}
UNKNOWN = "unknown"
CONTAINED, FALSE_SHARE, HASHES = 0.8, 0.001, 1 << 14
#: Documents of the training sample, and how often each template counts.
SAMPLE, WEIGHT = 4000, 25.0
#: Parts of the training rows, and a third of the words of a window; templates have fewer.
PARTS, STEP = 8, 32
# Words are letters and digits of any script; ASCII signs separate them.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), GAPS)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, at, words): each line with a word; digest is a hash of the text."""
    lines = F.split(ascii_lower(F.coalesce("text", F.lit(""))), "\n")
    cut = F.transform(lines, lambda x: split_words(x, GAPS))
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(cut).alias("at", "words"))
    return rows.where(F.size("words") > 0)


def windows(rows: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """``rows`` (with words) for every third block of ``STEP`` words and each with an anchor: words are the block and
    its neighbours. All words are in a window: the last third block may begin behind the last word.
    """
    w = F.col("words")
    held = F.array_intersect(w, F.array(*[F.lit(a) for a in anchors]))
    near = F.transform(w, lambda x, i: F.when(x.isin(*anchors), F.floor(i / STEP).cast("int")))
    near = F.when(F.size(held) > 0, F.array_distinct(F.array_compact(near))).otherwise(F.array().cast("array<int>"))
    blocks = F.array_union(near, F.sequence(F.lit(0), F.floor((F.size(w) - 1) / STEP).cast("int") + 1, F.lit(3)))
    start = F.greatest((F.col("_b") - 1) * STEP, F.lit(0))
    held = F.slice("words", start + 1, (F.col("_b") + 2) * STEP - start)
    keep = [c for c in rows.columns if c != "words"]
    return rows.select(*keep, "words", F.explode(blocks).alias("_b")).select(*keep, held.alias("words"))


def anchors_of(frequency: dict[str, int]) -> list[str]:
    """Words of which every text that is confirmed for any template has one, rare ones by ``frequency``."""
    chosen: list[str] = []
    for template in (t for ts in TEMPLATES.values() for t in ts):
        words = [w for w in re.split(GAPS, template.lower()) if w]
        grams = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        missing = len(grams) - math.ceil(CONTAINED * len(grams) - 1e-9)  # so many may be lacking
        for word in sorted(set(words), key=lambda w: (frequency.get(w, 0), w)):
            if sum(any(c in g for c in chosen) for g in grams) > missing:
                break
            if word not in chosen:
                chosen.append(word)
    return chosen


def _grams(words: Column, n: int = 3) -> Column:
    """Distinct word n-grams; the whole sequence if it is shorter."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " ")))

    return bind(words, of)


def _held(grams: Column, family: str) -> Column:
    """Largest share of a template's 3-grams, over the family's templates, that are among ``grams``."""
    shares = []
    for template in TEMPLATES[family]:
        own = _grams(words_of(F.lit(template)))
        shares.append(F.size(F.array_intersect(own, grams)) / F.size(own))
    return F.greatest(*shares, F.lit(0.0))


def confirmed(words: Column) -> Column:
    """The families of which a template stands in ``words``."""

    def of(grams: Column) -> Column:
        held = F.array(*[F.when(_held(grams, name) >= CONTAINED, F.lit(name)) for name in TEMPLATES])
        return F.array_compact(held)

    return bind(_grams(words), of)


def _with_terms(rows: DataFrame) -> DataFrame:
    """``rows`` (with words) and the column terms: the words and the word 2- and 3-grams."""
    w = F.col("words")

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        each = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))
        return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<string>"))

    return rows.withColumn("terms", F.concat(w, grams(2), grams(3)))


def _vectors() -> HashingTF:
    return HashingTF(numFeatures=HASHES, binary=True, inputCol="terms", outputCol="features")


class Scanner:
    """The fitted classifier, its anchors, the ids it was trained on, and the probability from which it is believed."""

    def __init__(self, model: PipelineModel, anchors: list[str], ids: DataFrame):
        self.model, self.anchors, self.ids, self.threshold = model, anchors, ids, 0.5
        self.names = [UNKNOWN, *TEMPLATES]

    def scored(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, at, probability, confirmed) of each window of ``docs``."""
        rows = windows(paragraphs(docs), self.anchors)
        # Exploding the one array keeps later filters from evaluating the model again.
        p = F.explode(F.array(vector_to_array("probability"))).alias("_p")
        keep = [c for c in rows.columns if c != "words"]
        out = self.model.transform(_with_terms(rows)).select(*rows.columns, p)
        may = F.arrays_overlap("words", F.array(*[F.lit(a) for a in self.anchors]))
        held = F.when(may, confirmed(F.col("words"))).otherwise(F.array().cast("array<string>"))
        return out.select(*keep, (1.0 - F.col("_p")[0]).alias("probability"), held.alias("confirmed"))

    def calibrate(self, scored: DataFrame) -> None:
        """Set the threshold from all scored windows without a notice, of documents the model has not seen."""
        fresh = scored.where(F.size("confirmed") == 0).join(F.broadcast(self.ids), "doc_id", "left_anti")
        top = fresh.agg(F.percentile_approx("probability", 1 - FALSE_SHARE, 100_000)).first()[0]
        self.threshold = max(0.5, top if top is not None else 0.5)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scanner:
    """Train on the templates and on windows of ``sample`` documents, drawn by the hash of their ids."""
    names = [UNKNOWN, *TEMPLATES]
    spark = docs.sparkSession
    # As many ids as the sample has.
    ids = materialise(docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "drawn")
    drawn = materialise(paragraphs(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")), "paragraphs")
    own_words = sorted({w for ts in TEMPLATES.values() for t in ts for w in re.split(GAPS, t.lower()) if w})
    seen = drawn.select(F.explode(F.array_distinct("words")).alias("w")).where(F.col("w").isin(*own_words)).groupBy("w").count()
    anchors = anchors_of({r["w"]: r["count"] for r in seen.collect()})

    def taught_by(grams: Column) -> Column:
        out = F.lit(0.0)
        for n in TEMPLATES:
            out = F.when(_held(grams, n) >= CONTAINED, F.lit(float(names.index(n)))).otherwise(out)
        return out

    rows = windows(drawn, anchors)
    rows = rows.select("words", bind(_grams(F.col("words")), taught_by).alias("label"))
    # Lines repeat a lot; equal windows count once with their number as weight.
    seen = rows.groupBy("words", "label").agg(F.count("*").cast("double").alias("weight"))
    own = [(t, float(names.index(n)), WEIGHT) for n, ts in TEMPLATES.items() for t in ts] + [("", 0.0, WEIGHT)]
    taught = spark.createDataFrame(own, "text string, label double, weight double")
    taught = taught.select(words_of(F.col("text")).alias("words"), "label", "weight")
    train = materialise(seen.unionByName(taught), "training")
    learner = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-4, maxIter=60)
    # The sample bounds these rows; few parts spare the driver as many gradients.
    return Scanner(Pipeline(stages=[_vectors(), learner]).fit(_with_terms(train).coalesce(PARTS)), anchors, ids)


def scanned(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, n_unconfirmed, families) of each row of ``docs``; calibrates ``scanner`` on them.

    A paragraph is licensed if a believed window of it is confirmed, and unconfirmed if it has believed windows only
    of the other kind.
    """
    scored = materialise(scanner.scored(docs), "windows")
    scanner.calibrate(scored)
    # Rows with the same id and text share a key and lines, which are counted once.
    by_line = scored.where(F.col("probability") > scanner.threshold).groupBy("doc_id", "digest", "at").agg(F.flatten(F.collect_set("confirmed")).alias("c"))
    of = by_line.groupBy("doc_id", "digest").agg(
        F.count_if(F.size("c") > 0).alias("n_licensed"), F.count_if(F.size("c") == 0).alias("n_unconfirmed"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("c")))).alias("families"),
    )
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(lines).cast("bigint").alias("n_paragraphs"))
    same = rows["doc_id"].eqNullSafe(of["doc_id"]) & (rows["digest"] == of["digest"])
    zero = F.lit(0).cast("bigint")
    return rows.join(of, same, "left").select(
        rows["doc_id"], "n_paragraphs", F.coalesce("n_licensed", zero).alias("n_licensed"),
        F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"), F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, fit(docs))
