"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the word rules (space, tab to carriage return) and A-Z.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, gaps: str = SPACE) -> Column:
    """The non-empty parts of ``text`` between runs of ``gaps``; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 is taken for a NULL id's text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample_of_classes(docs: DataFrame, labels: DataFrame, classes: Iterable[int], per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents of each class, the same on every run.

    ``docs`` has doc_id and text, ``labels`` doc_id and _y, the class. Ids are drawn in the order of their
    hash, before any text is read; rows without an id or a class teach nothing, an id with several classes
    counts by the largest, an id with several texts gives its smallest. The ids drawn are at most
    ``per_class`` for each class, so they are broadcast.
    """
    ids = labels.select("doc_id", "_y").dropna().groupBy("doc_id").agg(F.max("_y").alias("_y"))
    known = ids.join(docs.select("doc_id").dropna().distinct(), "doc_id")
    drawn = None
    for y in classes:
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, train: Column | None = None
) -> DataFrame:
    """``sample_of_classes`` for a 0/1 ``label``, of the documents for which ``train`` (on doc_id) holds."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("_y"))
    return sample_of_classes(docs, ids.where(train) if train is not None else ids, (0, 1), per_class)


def class_counts(labels: DataFrame, label: str, train: Column | None = None) -> tuple[int, int]:
    """How many ids of ``labels`` have class 0 and class 1."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("_y")).dropna()
    ids = ids.where(train) if train is not None else ids
    ids = ids.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    got = ids.agg(F.count_if(F.col("_y") == 0), F.count_if(F.col("_y") == 1)).first()
    return got[0], got[1]


#: Size up to which a measured table is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_below(df: DataFrame, size: Column) -> DataFrame:
    """``df`` (a pinned table) with a broadcast hint if its rows, of ``size`` bytes each, take up less than
    ``BROADCAST_BYTES``; beyond it the join is left to Spark, with the same result."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total < BROADCAST_BYTES else df
