"""Benchmark decontamination by winnowing, in DataFrame operations only.

Benchmark items are cut into windows of ``WINDOW`` words; an item of fewer words is one window. A word of a
document is hit if it lies in an occurrence of a window. To find occurrences, a text's k-gram hashes are
winnowed: of each w = m - k + 1 consecutive ones the smallest is kept, so two texts that share m words in
a row keep a common hash within them. Document fingerprints that the benchmark has too are extended to all
windows of m words around them and compared as text, so the result is exact. k = 7, w = 7 for windows of
13 words; a shorter window length m that occurs in the benchmark is winnowed with k = ceil(m / 2).

Each fingerprint carries the few words around it, so no document is shuffled and none is read twice for its
hits. The benchmark's fingerprints and windows are broadcast where their measured size is below
``common.BROADCAST_BYTES``; beyond it the joins shuffle, with the same result.

NULL and empty texts have no words and no hits. Rows that repeat an id or a text each get their row. Items
without an id hit words but are not named. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.binding import bind
from riskloom.llm.common import LOWER, UPPER, ascii_lower, broadcast_below, split_words, table
from riskloom.session import materialise

WINDOW = 13
# What separates words, in text with A-Z in lower case and in any text.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_POSITION_BITS = 30  # of a fingerprint; the others are of its hash


def _gram(m: int) -> int:
    """Words in the hashed grams for windows of ``m`` words."""
    return (m + 1) // 2


def _smallest(words: Column, m: int) -> Column:
    """Winnowed fingerprints (hash bits, then position from 0) of a text of at least ``m`` words."""
    k = _gram(m)
    w = m - k + 1
    n = F.size(words)
    low = F.lit((1 << _POSITION_BITS) - 1).cast("bigint")

    def gram(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(k)]).bitwiseAND(F.bitwise_not(low)) + i

    def kept(h: Column) -> Column:
        at = F.sequence(F.lit(0), n - m)
        return F.array_distinct(
            F.transform(at, lambda j: F.least(*[F.get(h, j + i) for i in range(w)]) if w > 1 else F.get(h, j))
        )

    found = bind(F.transform(F.sequence(F.lit(0), n - k), gram), kept)
    return F.when(n >= m, found).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(words: Column, m: int, around: bool) -> Column:
    """Structs (m, hash[, first, piece]): piece holds the words from ``first`` that a window can reach."""
    k = _gram(m)

    def as_row(f: Column) -> Column:
        at = f.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
        cols = [F.lit(m).alias("m"), F.shiftright(f, _POSITION_BITS).alias("hash")]
        if around:
            first = F.greatest(at - (m - k), F.lit(0))
            cols += [first.alias("first"), F.array_join(F.slice(words, first + 1, at + m - first), " ").alias("piece")]
        return F.struct(*cols)

    return F.transform(_smallest(words, m), as_row)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of ``items`` in ``docs``: (doc_id, digest, at, m, window) and (window, item_id).

    ``digest`` is a hash of the text: with the id it tells texts apart, and equal rows have equal hits.
    """
    source = items.select("item_id", split_words(ascii_lower(F.col("text")), GAPS).alias("words")).where(F.size("words") > 0)
    m = F.least(F.size("words"), F.lit(WINDOW))
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))
    windows = materialise(source.select("item_id", m.alias("m"), F.explode(cut).alias("window")).distinct(), "windows")
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())  # 13 at most
    known = [
        source.where((m == n)).select(F.explode(_fingerprints(F.col("words"), n, False)).alias("f")).select("f.*")
        for n in lengths
    ]
    if not known:
        none = docs.sparkSession.createDataFrame([], "m int, hash bigint")
        known, lengths = [none], [WINDOW]
    marks = known[0]
    for more in known[1:]:
        marks = marks.unionByName(more)
    marks = broadcast_below(materialise(marks.distinct(), "marks"), F.lit(24))
    words = split_words(ascii_lower(F.col("text")), GAPS)
    found = docs.select("doc_id", F.xxhash64("text").alias("digest"), words.alias("words"))
    rows = F.concat(*[_fingerprints(F.col("words"), n, True) for n in lengths])
    found = found.select("doc_id", "digest", F.explode(rows).alias("f")).select("doc_id", "digest", "f.*")
    hits = found.join(marks, ["m", "hash"], "left_semi")
    spread = F.transform(
        F.sequence(F.lit(1), F.size("part") - F.col("m") + 1),
        lambda i: F.struct((F.col("first") + i - 1).alias("at"), F.array_join(F.slice("part", i, F.col("m")), " ").alias("window")),
    )
    around = hits.select("doc_id", "digest", "m", "first", F.split("piece", " ").alias("part"))
    around = around.where(F.size("part") >= F.col("m")).select("doc_id", "digest", "m", F.explode(spread).alias("w"))
    wanted = broadcast_below(windows.select("m", "window").distinct(), F.octet_length("window") + 32)
    exact = around.select("doc_id", "digest", "m", "w.*").join(wanted, ["m", "window"], "left_semi").distinct()
    return materialise(exact, "occurrences"), windows.select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, digest, n_hit, n_items, items_sha256) of the texts in ``docs`` with a window of ``items``."""
    exact, windows = occurrences(docs, items)
    order = W.partitionBy("doc_id", "digest").orderBy("at", "m")  # one document's windows
    end = F.col("at") + F.col("m")
    before = F.coalesce(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(end - F.greatest(F.col("at"), before), F.lit(0))
    hit = exact.select("doc_id", "digest", fresh.alias("fresh")).groupBy("doc_id", "digest").agg(F.sum("fresh").cast("bigint").alias("n_hit"))
    named = exact.select("doc_id", "digest", "window").distinct().join(windows, "window").select("doc_id", "digest", "item_id").dropna(subset=["item_id"]).distinct()
    named = named.groupBy("doc_id", "digest").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    return hit.join(named, _same(hit, named), "left").select(
        hit["doc_id"], hit["digest"], "n_hit", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
    )


def judged(docs: DataFrame, items: DataFrame, twentieth: int = 20) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A document is contaminated if at least one in ``twentieth`` of its words is hit.
    """
    found = contamination(docs, items)
    n_words = F.size(split_words(F.col("text"), GAPS_ANY)).cast("bigint")
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), n_words.alias("n_words"))
    zero = F.lit(0).cast("bigint")
    out = rows.join(found, _same(rows, found), "left").select(
        rows["doc_id"], rows["digest"], "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (twentieth * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not contaminated by ``items``."""
    bad = judged(docs.select("doc_id", "text"), items).where("contaminated").select("doc_id", "digest").distinct()
    bad = materialise(bad, "contaminated")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("digest"))
    return rows.join(bad, _same(rows, bad), "left_anti").select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return judged(docs, items).drop("digest")


_WORDS_SQL = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP2_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s
        FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
cut AS (
  SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS t
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM docs, lengths WHERE len(w) >= m)),
hit AS (SELECT r, s, m, t FROM cut WHERE t IN (SELECT t FROM windows)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit JOIN windows USING (t) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
