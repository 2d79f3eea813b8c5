"""A corpus pipeline of the operators in ``riskloom.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet to the shared folder and reads again as the next stage's documents. All stages
but the last return the columns of ``documents`` as they came, whatever further columns there are. Each
works on all that its predecessor kept. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontamination, mixing, simhash, token_store, toxicity
from riskloom.llm.common import fold_of, table
from riskloom.session import materialise


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from labels outside fold 0 whose document is here."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=fold_of(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, model)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 3-word shingles, fingerprints within 3 bits; that with the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=3)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until the languages have their target shares; each stays at least once."""
    labels = mixing.language_labels(docs, table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labels)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the token store."""
    return token_store.stored(spark, docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", not_toxic),
    ("near copies", no_near_copies),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: No SQL: several stages are trained models or hash with functions that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
