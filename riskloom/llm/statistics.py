"""Counts of a text as columns, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.binding import bind
from riskloom.llm.common import split_words

# The symbols that are counted, and how many words a repeated window has.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_chars_all", "longest", "n_bars", "n_odd",
)


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words in ``window``-word windows that occur twice or more, first occurrence included.

    Windows are compared by a 64-bit hash. Texts without a repeated window stop after a hash set.
    """

    def covered(grams: Column) -> Column:
        # Equal windows become neighbours; the positions of all that have an equal neighbour, in order.
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = bind(
            placed,
            lambda s: F.filter(
                s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
            ),
        )
        at = F.sort_array(F.transform(same, lambda x: x["i"]))
        steps = bind(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def counted(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(covered(grams))

    def of(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)])
        )
        return F.when(F.size(w) > window, bind(grams, counted)).otherwise(F.lit(0).cast("bigint"))

    return bind(words, of)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` of the column ``text``; a NULL text counts as an empty one."""
    t = F.col("_t")
    lost = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("bigint")
    base = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    parts = base.select(
        "doc_id", "_t", split_words(t).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    size = lambda c: F.size(c).cast("bigint")
    return parts.select(
        "doc_id",
        size("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        lost(SYMBOLS).alias("n_symbols"),
        (size("_l") - size(F.array_distinct("_l"))).alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        size("_l").alias("n_lines"),
        size(F.array_distinct("_w")).alias("n_distinct"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).cast("bigint").alias("n_upper"),
        (F.length(t) - F.length(F.regexp_replace(t, "[0-9]+", ""))).cast("bigint").alias("n_digits"),
        (F.length(t) - F.length(F.regexp_replace(t, "[.!?]+", ""))).cast("bigint").alias("n_marks"),
        F.length(t).cast("bigint").alias("n_chars_all"),
        F.coalesce(F.array_max(F.transform("_w", lambda w: F.length(w))), F.lit(0)).cast("bigint").alias("longest"),
        size(F.filter("_w", lambda w: w == "|")).alias("n_bars"),
        size(F.filter("_w", lambda w: F.instr(F.lit(SYMBOLS), F.right(w, F.lit(1))) > 0)).alias("n_odd"),
    )
