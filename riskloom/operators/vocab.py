"""Vocabularies: token counts, selection, ids, and per-fold vocabularies from one count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.text import (
    Tokenizer,
    char_grams,
    clean_changes,
    code_tokens,
    explode_tokens,
    text_or_empty,
    word_grams,
    words,
)
from riskloom.operators.ranks import global_position
from riskloom.session import materialise


def stack_texts(df: DataFrame, columns: Sequence[str], name: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """All text columns (before, after, contexts) as one corpus; NULL is empty text."""
    texts = F.array(*[text_or_empty(c) for c in columns])
    return df.select(*keep, F.explode(texts).alias(name))


def _value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each token occurs in the lists of a batch."""
    for b in batches:
        counts = pc.value_counts(b.column(0).flatten().drop_null())
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["token", "n"])


def _frequency(docs: DataFrame, tokens: Column, keys: Sequence[str], name: str) -> DataFrame:
    """Occurrences per token. Without keys, tokens are counted batch by batch before they become rows."""
    if keys:
        return explode_tokens(docs, tokens, keys).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias(name))
    return docs.select(tokens.alias("_t")).mapInArrow(_value_counts, "token string, n bigint").groupBy("token").agg(F.sum("n").alias(name))


def doc_frequency(docs: DataFrame, grams: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Number of documents per token. Partial counts are made before the shuffle."""
    return _frequency(docs, F.array_distinct(grams), keys, "doc_freq")


def term_frequency(docs: DataFrame, grams: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Number of occurrences per token."""
    return _frequency(docs, grams, keys, "term_freq")


#: n-grams of whole documents that are spelt out at a time, unless one document has more.
GRAMS = 1_000_000
#: Bytes of whole documents whose distinct words are cut at a time, unless one document has more.
CUT_BYTES = 16 << 20

_BLANKS = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE_BLANKS = [int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _blank_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are part of a space, as ``words`` understands it."""
    blank = _BLANKS[data]
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[np.isin(data[at + 1], [0x85, 0xA0])]
    blank[at] = blank[at + 1] = True
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    at = at[np.isin(data[at].astype("int64") << 16 | data[at + 1].astype("int64") << 8 | data[at + 2], _WIDE_BLANKS)]
    blank[at] = blank[at + 1] = blank[at + 2] = True
    return blank


def _words_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.StringArray]:
    """The words of all texts in their order, and how many each text has."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", "uint8")[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_blank_bytes(data)
    # A word begins after a space or with its text, and ends before a space or with its text.
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(data))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype("int32")
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(starts, ends)), found


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys. For whole numbers ``np.unique`` goes by a hash table, which is many times slower than to sort."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each distinct key, from 0, in place of the keys; and how many there are."""
    found = pa.array(keys).dictionary_encode()
    return np.asarray(found.indices), len(found.dictionary)


def _spelt(chars: np.ndarray, at: np.ndarray, n: int) -> pa.StringArray:
    """The runs of n characters from ``at`` on, as strings."""
    runs = chars[at[:, None] + np.arange(n)]
    size = n + sum((runs >= least).sum(axis=1) for least in (0x80, 0x800, 0x10000))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype("int32")
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(runs.tobytes().decode("utf-32-le").encode()))


def _grams_by_length(
    known: pa.StringArray, min_n: int, max_n: int, whole_word: bool
) -> Iterator[tuple[pa.StringArray, np.ndarray, np.ndarray]]:
    """For each length of at most ``max_n``: distinct n-grams, and per word how many it has and all their numbers, word by word.

    Grams of different lengths differ. A marked word stands behind its word, so that it meets the grams that are spelt like it.
    A gram is a number: that of the gram without its last character, then the character's place among those that occur.
    """
    length = np.asarray(pc.utf8_length(known))
    marked = np.where(length + 2 <= max_n, length + 2, 0).astype("int32") * whole_word
    step, begins = length, length + (marked > 0)
    if whole_word:
        known, step = pc.binary_join_element_wise(known, "<", known, ">", ""), length * 2 + 2
    chars = np.frombuffer("".join(known.to_pylist()).encode("utf-32-le"), "uint32")
    occurs = np.zeros(0x110000, bool)
    occurs[chars] = True
    place, size = (np.cumsum(occurs, dtype="int32") - 1)[chars], max(int(occurs.sum()), 1)
    # Where a gram can begin, and how long it can be there: at each character of a word, and before a mark that is short enough.
    nth = np.arange(begins.sum(), dtype="int32") - np.repeat(np.cumsum(begins, dtype="int32") - begins, begins)
    left = np.repeat(length, begins) - nth
    mark, whole = left == 0, nth == 0
    left[mark] = marked[marked > 0]
    at = nth + np.repeat(np.cumsum(step, dtype="int32") - step, begins)
    code, bound = np.zeros(len(at), "int64"), 1
    for n in range(1, max_n + 1):
        if n > 1:
            on = left >= n
            at, left, mark, whole, code = at[on], left[on], mark[on], whole[on], code[on]
        if bound * size >= 1 << 62:
            code, bound = _numbered(code)
        code, bound = code * size + place[at + (n - 1)], bound * size
        if n < min_n:
            out = (left == n) & (mark | whole)
            width = (length == n).astype("int64")
        else:
            out = ~mark | (left == n)
            width = np.maximum(length - n + 1, 0).astype("int64")
        if out.any():
            number, distinct = _numbered(code[out])
            of = np.empty(distinct, "int64")
            of[number] = at[out]
            yield _spelt(chars, of, n), width + (marked == n), number


def _count_grams(texts: pa.LargeStringArray, min_n: int, max_n: int, whole_word: bool) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """Each n-gram of the words of the texts, once, and the number of texts that have it."""
    many, found = _words_of(texts)
    found = found.dictionary_encode()
    known = found.dictionary
    pairs = _distinct(np.repeat(np.arange(len(texts)), many) * max(len(known), 1) + np.asarray(found.indices))
    row, word = np.divmod(pairs, max(len(known), 1))
    last = np.searchsorted(row, np.arange(len(texts)), "right")
    for grams, width, number in _grams_by_length(known, min_n, max_n, whole_word):
        first = np.cumsum(width) - width
        spelt = np.concatenate([[0], np.cumsum(width[word])])[last]
        total = np.zeros(len(grams), "int64")
        at = 0
        while at < len(texts):
            # Whole documents, so that a gram of several of its words counts once.
            end = max(at + 1, int(np.searchsorted(spelt, (spelt[at - 1] if at else 0) + GRAMS, "right")))
            span = slice(last[at - 1] if at else 0, last[end - 1])
            n = width[word[span]]
            inside = np.arange(n.sum()) + np.repeat(first[word[span]] - (np.cumsum(n) - n), n)
            keys = np.repeat((row[span] - at) * len(grams), n) + number[inside]
            kind = "uint32" if (end - at) * len(grams) < 1 << 32 else "int64"
            total += np.bincount(_distinct(keys.astype(kind)) % len(grams), minlength=len(grams))
            at = end
        yield grams, total
    if whole_word:
        long = np.asarray(pc.greater(pc.utf8_length(known), max_n - 2))
        yield pc.binary_join_element_wise("<", known, ">", "").filter(pa.array(long)), np.bincount(word, minlength=len(known))[long]


def _word_gram_frequency(docs: DataFrame, text: Column, min_n: int, max_n: int, whole_word: bool) -> DataFrame:
    """Documents per character n-gram within their distinct words, as ``word_char_grams`` cuts them.

    Texts are cut into words, and words into grams, by whole Arrow batches; a batch's distinct words are cut once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.large_string())
            size = np.cumsum(np.asarray(pc.binary_length(texts)))
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CUT_BYTES, "right")))
                for grams, total in _count_grams(texts.slice(at, end - at), min_n, max_n, whole_word):
                    yield pa.RecordBatch.from_arrays([grams, pa.array(total)], ["token", "n"])
                at = end

    out = docs.select(F.make_valid_utf8(text).alias("_t")).mapInArrow(count, "token string, n bigint")
    return out.groupBy("token").agg(F.sum("n").alias("doc_freq"))


def with_ids(counts: DataFrame, count: str, max_vocab: int | None, first: int = 1) -> DataFrame:
    """Keep the ``max_vocab`` commonest tokens (ties by token) and number them from ``first``."""
    if max_vocab is None:
        ranked = counts.withColumn("_neg", -F.col(count))
        out = global_position(ranked, ["_neg", "token"], "_p")
        return out.select("token", (F.col("_p") + first).cast("int").alias("id"), count)
    top = counts.orderBy(F.desc(count), "token").limit(max_vocab)
    # At most max_vocab rows meet in this window.
    place = F.row_number().over(W.orderBy(F.desc(count), "token"))
    return top.select("token", (place + (first - 1)).alias("id"), count)


def _bounded(counts: DataFrame, bound, n: int | None, lower: bool) -> DataFrame:
    """Filter by document count (int) or by share of the base (float)."""
    if bound is None:
        return counts
    value = F.col("doc_freq") / F.lit(float(n)) if isinstance(bound, float) else F.col("doc_freq")
    return counts.filter(value >= bound if lower else value <= bound)


def select_vocab(
    counts: DataFrame,
    n_docs,
    min_df: int | float | None = 0.01,
    max_df: int | float | None = 1.0,
    max_vocab: int | None = None,
    oov: str | None = None,
    ratio_base: str = "documents",
) -> DataFrame:
    """Vocabulary (token, id, doc_freq) from document frequencies.

    ``max_vocab`` wins over the frequency bounds. Bounds given as floats are shares of the
    documents (``n_docs()`` is called only then) or, with ``ratio_base='vocab'``, of the distinct
    tokens. ``oov`` adds a token for everything else, with the last id.
    """
    if min_df is None and max_df is None and max_vocab is None:
        raise ValueError("give min_df, max_df or max_vocab")
    if ratio_base not in ("documents", "vocab"):
        raise ValueError(f"unknown ratio base: {ratio_base}")
    if max_vocab is None:
        n = None
        if isinstance(min_df, float) or isinstance(max_df, float):
            if ratio_base == "vocab":
                counts = materialise(counts, "counts")
                n = counts.count()
            else:
                n = n_docs()
        counts = _bounded(_bounded(counts, min_df, n, True), max_df, n, False)
    vocab = with_ids(counts, "doc_freq", max_vocab)
    if oov is None:
        return vocab
    vocab = materialise(vocab, "vocab")
    last = vocab.agg(
        F.lit(oov).alias("token"),
        (F.count(F.lit(1)) + 1).cast("int").alias("id"),
        F.lit(None).cast("bigint").alias("doc_freq"),
    )
    return vocab.filter(F.col("token") != oov).unionByName(last)


def vocab_words(
    docs: DataFrame,
    text: str = "text",
    tokenizer: Tokenizer = words,
    min_n: int = 1,
    max_n: int = 1,
    **select,
) -> DataFrame:
    """Vocabulary of token n-grams by document frequency; see ``select_vocab``."""
    tokens = docs.select(tokenizer(text_or_empty(text)).alias("_t"))
    counts = doc_frequency(tokens, word_grams(F.col("_t"), min_n, max_n))
    return select_vocab(counts, docs.count, **select)


def vocab_chars(
    docs: DataFrame,
    text: str = "text",
    min_n: int = 3,
    max_n: int = 6,
    word_bound: bool = False,
    whole_word: bool = False,
    **select,
) -> DataFrame:
    """Vocabulary of character n-grams by document frequency; see ``select_vocab``.

    Within words, each distinct word of a document is cut once.
    """
    body = text_or_empty(text)
    if word_bound:
        counts = _word_gram_frequency(docs, body, min_n, max_n, whole_word)
    else:
        counts = doc_frequency(docs, char_grams(body, min_n, max_n, False, whole_word))
    return select_vocab(counts, docs.count, **select)


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Add document frequencies of several corpora, to continue a vocabulary with new text."""
    out = counts[0].select("token", "doc_freq")
    for c in counts[1:]:
        out = out.unionByName(c.select("token", "doc_freq"))
    return out.groupBy("token").agg(F.sum("doc_freq").alias("doc_freq"))


# The ways of choosing a fold's training rows, and the column that holds a row's part.
SPLITS = {"time": "time_partition", "random": "partition", "holdout": "set"}


def trains(split: str, part: Column, fold: int) -> Column:
    """Whether a row of the given part trains in the fold.

    ``time``: parts up to the fold. ``random``: all parts but the fold. ``holdout``: the rows marked ``train``,
    the same in every fold. A NULL part trains nowhere.
    """
    if split == "time":
        return part <= fold
    if split == "random":
        return part != fold
    if split == "holdout":
        return part == "train"
    raise ValueError(f"unknown split: {split}")


def _count_by_fold(docs: DataFrame, tokens: Column, split: str, part: str | None, folds: Sequence[int]) -> DataFrame:
    """One row per token with a count column per fold: rows of its training parts.

    Text is tokenised once and counted once by (token, part). A token has as many of these counts as there are
    parts; a fold's count is a running sum over them (time), or all but one (random).
    """
    part = part or SPLITS[split]
    counts = explode_tokens(docs, tokens, [part]).groupBy("token", part).agg(F.count(F.lit(1)).alias("_n"))
    p, n = F.col(part), F.col("_n")
    zero = F.lit(0).cast("bigint")
    held = lambda condition: F.coalesce(F.sum(F.when(condition, n)), zero)
    if split == "time":
        last = max(folds, default=-1)
        cells = counts.groupBy("token").agg(*[held(p <= 0 if i == 0 else p == i).alias(f"_p{i}") for i in range(last + 1)])
        for i in range(1, last + 1):
            cells = cells.withColumn(f"_p{i}", F.col(f"_p{i - 1}") + F.col(f"_p{i}"))
        return cells.select("token", *[F.col(f"_p{f}").alias(f"f{f}") for f in folds])
    if split == "random":
        cells = counts.groupBy("token").agg(held(p.isNotNull()).alias("_all"), *[held(p == f).alias(f"_p{f}") for f in folds])
        return cells.select("token", *[(F.col("_all") - F.col(f"_p{f}")).alias(f"f{f}") for f in folds])
    return counts.groupBy("token").agg(*[held(trains(split, p, f)).alias(f"f{f}") for f in folds])


def _by_fold(wide: DataFrame, folds: Sequence[int], name: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(int(f)).alias("fold"), F.col(f"f{f}").alias(name)) for f in folds])
    return wide.select("token", F.inline(cells)).filter(F.col(name) > 0).select("fold", "token", name)


def fold_counts(
    docs: DataFrame, grams: Column, part: str | None = None, folds: Sequence[int] = tuple(range(10)), split: str = "time"
) -> DataFrame:
    """Document frequency of every token in the training text of every fold."""
    return _by_fold(_count_by_fold(docs, F.array_distinct(grams), split, part, folds), folds, "doc_freq")


def fold_term_counts(
    docs: DataFrame, grams: Column, part: str | None = None, folds: Sequence[int] = tuple(range(10)), split: str = "time"
) -> DataFrame:
    """Occurrences of every token in the training text of every fold."""
    return _by_fold(_count_by_fold(docs, grams, split, part, folds), folds, "term_freq")


def fold_vocab(
    docs: DataFrame,
    grams: Column,
    part: str | None = None,
    folds: Sequence[int] = tuple(range(10)),
    max_vocab: int = 10_000,
    split: str = "time",
    count: str = "doc_freq",
) -> DataFrame:
    """The ``max_vocab`` commonest tokens per fold with ids from 1: (fold, token, id, ``count``).

    ``count`` is ``doc_freq`` or ``term_freq``; ties go by token. A histogram of the counts gives, per fold, the
    count below which no token can make it, so only tokens from that count on are put in order.
    """
    counted = {"doc_freq": F.array_distinct(grams), "term_freq": grams}[count]
    wide = materialise(_count_by_fold(docs, counted, split, part, folds), "foldcounts")
    counts = _by_fold(wide, folds, count)
    histogram = counts.groupBy("fold", count).agg(F.count(F.lit(1)).alias("_n"))
    # One row per fold and distinct count.
    above = F.sum("_n").over(W.partitionBy("fold").orderBy(F.desc(count)).rowsBetween(W.unboundedPreceding, -1))
    least = (
        histogram.withColumn("_above", F.coalesce(above, F.lit(0)))
        .filter(F.col("_above") < max_vocab)
        .groupBy("fold")
        .agg(F.min(count).alias("_least"))
    )
    # One row per fold, as many as the list of folds.
    likely = counts.join(F.broadcast(least), "fold").filter(F.col(count) >= F.col("_least")).drop("_least")
    # Spark keeps max_vocab rows per fold and task before the shuffle.
    place = F.row_number().over(W.partitionBy("fold").orderBy(F.desc(count), "token"))
    return likely.withColumn("id", place).filter(F.col("id") <= max_vocab).select("fold", "token", "id", count)


def vocab_report(vocab: DataFrame, count: str = "doc_freq", with_count: bool = True) -> DataFrame:
    """Tokens sorted by count, largest first."""
    out = vocab.orderBy(F.desc(count), "token")
    return out.select("token", count) if with_count else out.select("token")


def change_tokens(col: Column | str) -> Column:
    """Tokens of a change text: markers removed, NULL as empty."""
    return code_tokens(clean_changes(text_or_empty(col)))
