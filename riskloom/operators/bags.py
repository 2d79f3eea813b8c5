"""Bags of tokens: term counts, weighted terms, and zero-filled vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import explode_tokens, terms, text_or_empty, word_grams
from riskloom.operators.vocab import change_tokens, doc_frequency, stack_texts, term_frequency, with_ids
from riskloom.session import broadcast_if_small, materialise

# Fixed value: size of the bag-of-words vocabulary.
BAG_SIZE = 10_000


def bow_fit(df: DataFrame, columns: Sequence[str], size: int = BAG_SIZE) -> DataFrame:
    """The ``size`` commonest tokens of all text columns: token, id (from 0), term_freq."""
    corpus = stack_texts(df, columns).select(change_tokens("text").alias("_t"))
    return with_ids(term_frequency(corpus, F.col("_t")), "term_freq", size, first=0)


def bow_transform(df: DataFrame, vocab: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add a sparse count vector ``<column>_bow`` per column; unknown tokens are ignored.

    The vocabulary holds at most the fitted number of tokens and goes into the Spark ML model.
    """
    tokens = [r["token"] for r in vocab.orderBy("id").select("token").collect()]
    with_tokens = df.select("*", *[change_tokens(c).alias(f"_t_{c}") for c in columns])
    model = CountVectorizerModel.from_vocabulary(tokens, inputCol="_", outputCol="_")
    for c in columns:
        model = model.setInputCol(f"_t_{c}").setOutputCol(f"{c}_bow")
        with_tokens = model.transform(with_tokens)
    return with_tokens.drop(*[f"_t_{c}" for c in columns])


def bow_counts(df: DataFrame, vocab: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """Long form of the bag: key, id, n. Rows of one document never leave their task early:
    counts are merged per (key, token) before the shuffle."""
    counts = (
        explode_tokens(df, change_tokens(column), key)
        .groupBy(*key, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # with_ids bounds the vocabulary; it is written once, and its size is measured before the hint.
    return counts.join(broadcast_if_small(materialise(vocab.select("token", "id"), "bag")), "token").select(*key, "id", "n")


def zero_fill(col: Column | str, width: int) -> Column:
    """A NULL vector as the zero vector of the given width."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, array_to_vector(F.array_repeat(F.lit(0.0), width)))


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Columns side by side in one vector; sparse parts stay sparse."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


# The weighted term variants. n-grams of sizes lo..hi come from the arguments where
# ``grams`` is True. Variant 1 counts code tokens; the others count lower-case terms.
VARIANTS = {
    1: {"min_df": 0.01, "idf": False, "norm": False, "grams": False},
    2: {"min_df": 0.001, "idf": True, "norm": True, "grams": False},
    3: {"min_df": 0.001, "idf": False, "norm": False, "grams": True},
    4: {"min_df": 0.001, "idf": False, "norm": False, "grams": True},
    5: {"min_df": 0.001, "idf": False, "norm": False, "grams": True},
    6: {"min_df": 0.001, "idf": True, "norm": True, "grams": True},
}

#: Terms, and bytes of them, that go with the tasks of ``tfidf``; more are joined.
TERMS, TERM_BYTES = 200_000, 16 << 20

# Fixed value: the stop word of variants 2 to 6.
STOP_WORD = "aka"


def tfidf(
    df: DataFrame, column: str, key: str, variant: int = 2, min_n: int = 1, max_n: int = 1
) -> DataFrame:
    """Weighted terms in long form: key, token, weight.

    Weight = count, times ``ln((1 + docs) / (1 + df)) + 1`` where the variant uses idf, divided by
    the length of the document's vector where it is normalised. Tokens below ``min_df`` are dropped.
    """
    rule = VARIANTS[variant]
    text = text_or_empty(column)
    if variant == 1:
        tokens = df.select(key, change_tokens(column).alias("_t"))
    else:
        tokens = df.select(key, F.filter(terms(text), lambda t: t != STOP_WORD).alias("_t"))
    lo, hi = (min_n, max_n) if rule["grams"] else (1, 1)
    grams = tokens.select(key, word_grams(F.col("_t"), lo, hi).alias("_g"))
    n_docs, keys, nulls = df.agg(F.count(F.lit(1)), F.countDistinct(key), F.count_if(F.col(key).isNull())).first()
    if keys + min(nulls, 1) < n_docs:
        # Texts of one key are one document; its terms never exceed its text.
        grams = materialise(grams.groupBy(key).agg(F.flatten(F.collect_list("_g")).alias("_g")), "terms")
    freq = doc_frequency(grams, F.col("_g")).withColumnRenamed("doc_freq", "df").filter(F.col("df") >= rule["min_df"] * n_docs)
    idf = (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0) if rule["idf"] else F.lit(1.0)
    freq = materialise(freq.select("token", idf.alias("idf")), "df")
    n, size = freq.agg(F.count(F.lit(1)), F.sum(F.octet_length("token"))).first()
    if n <= TERMS and (size or 0) <= TERM_BYTES:
        rows = freq.collect()
        schema = T.StructType([df.schema[key], T.StructField("token", T.StringType()), T.StructField("weight", T.DoubleType())])
        return grams.mapInArrow(_weigher([r["token"] for r in rows], [r["idf"] for r in rows], rule["norm"], df.schema[key].name), schema)
    counts = explode_tokens(grams, F.col("_g"), [key]).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    weighted = counts.join(freq, "token").select(key, "token", (F.col("n") * F.col("idf")).alias("weight"))
    if not rule["norm"]:
        return weighted
    # A window holds the distinct tokens of one document, never more than its text.
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(key)))
    return weighted.select(key, "token", (F.col("weight") / length).alias("weight"))


def _weigher(terms: Sequence[str], idf: Sequence[float], norm: bool, key: str):
    """Weighted terms of the documents of a batch, as ``tfidf`` defines them: nothing leaves its task."""
    known, factor, size = pa.array(terms, pa.string()), np.array(idf, "float64"), max(len(terms), 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            found = pc.index_in(lists.flatten(), value_set=known)
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            pairs = row[np.asarray(found.is_valid())] * size + np.asarray(found.drop_null())
            pairs, n = np.unique(pairs, return_counts=True)
            row, code = np.divmod(pairs, size)
            weight = n * factor[code]
            if norm:
                weight = weight / np.sqrt(np.bincount(row, weight * weight, minlength=len(lists)))[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), known.take(pa.array(code)), pa.array(weight)], [key, "token", "weight"])

    return weigh
