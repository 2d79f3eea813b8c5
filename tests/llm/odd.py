"""Rows that every operator has to bear: NULLs, empty and long texts, repeats, clashing column names."""

from __future__ import annotations

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, words string, row string, digest string, node string, fp bigint, rate double, kept boolean, label int"
)
LONG = " ".join(f"word{i % 977} tail{i % 31}." for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog, and then it walks home along the river to sleep until dawn. "

TEXTS = [
    (1, "plain words of a short text"), (2, None), (3, ""), (4, "  \n\t "), (None, "no id here"), (None, None),
    (5, LONG), (6, PROSE * 3), (7, PROSE * 3), (8, PROSE * 3 + "One more."), (6, PROSE * 3), (9, "one"), (9, "two"),
    (10, "ÄÖÜ ß é 日本語 😀 İ"), (11, "same same same same " * 40), (12, "a\nb\na\n\nb\n"),
]


def documents(spark, texts=None):
    rows = [(k, t, None if i % 3 else "en", None, len(t or ""), None, None, "r", None, "n", 5, 0.5, None, 1) for i, (k, t) in enumerate(TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows=((1, 1, 0), (2, 0, 1), (3, None, 0), (None, 1, 1), (6, 1, 0), (6, 0, 1), (99, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
