"""Texts as padded id sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import (
    LOOKUP_LIMIT,
    Tokenizer,
    char_grams,
    code_tokens,
    pad_ids,
    text_or_empty,
    token_ids,
    word_grams,
)
from riskloom.session import broadcast_if_small, materialise

# Sequence lengths of word and character ids.
WORD_LENGTH = 512
CHAR_LENGTH = 1024


def small_vocab(vocab: DataFrame) -> dict[str, int] | None:
    """The vocabulary as a dictionary, or None when it exceeds the lookup limit."""
    rows = vocab.select("token", "id").limit(LOOKUP_LIMIT + 1).collect()
    return None if len(rows) > LOOKUP_LIMIT else {r["token"]: r["id"] for r in rows}


def _unknown_id(vocab: DataFrame, oov: str | None) -> int | None:
    if oov is None:
        return None
    row = vocab.filter(F.col("token") == oov).select("id").first()
    if row is None:
        raise ValueError(f"token {oov!r} is not in the vocabulary")
    return row["id"]


def add_ids(
    df: DataFrame, grams: dict[str, Column], vocab: DataFrame, key: Sequence[str], oov: str | None = None
) -> DataFrame:
    """Add one id-array column per entry of ``grams`` (name -> token array column).

    A small vocabulary goes with the tasks and is looked up batch by batch, without a shuffle. A larger one is
    joined: tokens are exploded with their place and put together again by the row's own number, so
    rows that share a key, or have none, keep their own ids. Both ways give the same.
    """
    unknown = _unknown_id(vocab, oov)
    ids = small_vocab(vocab)
    if ids is not None:
        find = token_ids(ids, unknown)
        work = df.select("*", *[g.alias(f"_g_{n}") for n, g in grams.items()])
        return work.select(*df.columns, *[find(F.col(f"_g_{n}")).alias(n) for n in grams])
    work = df.select("*", *[g.alias(f"_g_{n}") for n, g in grams.items()])
    work = materialise(work.withColumn("_row", F.monotonically_increasing_id()), "rows")
    out = work
    for name in grams:
        out = _joined_ids(out, work, name, vocab, unknown)
    return out.select(*df.columns, *grams)


def _joined_ids(out, work, name, vocab, unknown) -> DataFrame:
    """Ids by join; Spark broadcasts the vocabulary if it is small and shuffles by token beyond.

    Tokens of a document never exceed its own text, so regrouping by row stays bounded.
    """
    placed = work.select("_row", F.posexplode(f"_g_{name}").alias("_pos", "_token"))
    ids = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    found = placed.join(ids, "_token", "inner" if unknown is None else "left")
    if unknown is not None:
        found = found.withColumn("_id", F.coalesce("_id", F.lit(unknown)))
    rows = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_id"))).alias("_s"))
    rows = rows.select("_row", F.transform("_s", lambda s: s["_id"]).alias(name))
    return out.join(rows, "_row", "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))


def fold_ids(
    df: DataFrame, grams: dict[str, Column], vocab: DataFrame, folds: Sequence[int], key: Sequence[str]
) -> DataFrame:
    """Id arrays of every row under the vocabulary of every fold: fold, ``key``, one column per entry of ``grams``.

    ``vocab`` is (fold, token, id). It becomes one row per token with the token's id in each fold, which the
    tokens of all columns, exploded with their place, meet in one join; each row is put together again by its own
    number and read once per fold. Tokens unknown to a fold are dropped there.
    """
    folds = [int(f) for f in folds]
    ids = vocab.groupBy("token").agg(F.array(*[F.max(F.when(F.col("fold") == f, F.col("id"))) for f in folds]).alias("_ids"))
    ids = broadcast_if_small(materialise(ids, "foldids"))
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), g.alias("_tokens")) for i, g in enumerate(grams.values())])
    work = df.select(*key, sides.alias("_s"))
    work = materialise(work.withColumn("_row", F.monotonically_increasing_id()), "rows")
    placed = work.select("_row", F.inline("_s")).select("_row", "_side", F.posexplode("_tokens").alias("_pos", "token"))
    found = placed.join(ids, "token")
    one = lambda i: F.when(F.col("_side") == i, F.struct("_pos", "_ids"))
    # The tokens of a row never exceed its own text.
    lists = found.groupBy("_row").agg(*[F.array_sort(F.collect_list(one(i))).alias(f"_l{i}") for i in range(len(grams))])
    rows = work.select("_row", *key).join(lists, "_row", "left")

    def of(i: int, at: int) -> Column:
        known = F.filter(f"_l{i}", lambda s: F.get(s["_ids"], F.lit(at)).isNotNull())
        return F.coalesce(F.transform(known, lambda s: F.get(s["_ids"], F.lit(at))), F.array().cast("array<int>"))

    cells = [F.struct(F.lit(f).alias("fold"), *[of(i, at).alias(n) for i, n in enumerate(grams)]) for at, f in enumerate(folds)]
    return rows.select(*key, F.inline(F.array(*cells))).select("fold", *key, *grams)


def encode_words(
    df: DataFrame,
    vocab: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    tokenizer: Tokenizer = code_tokens,
    maxlen: int = WORD_LENGTH,
    padding: str = "pre",
    min_n: int = 1,
    max_n: int = 1,
    oov: str | None = None,
) -> DataFrame:
    """Add ``<column>_ids`` (exactly ``maxlen`` ids) and ``<column>_len`` (ids before padding)."""
    tokens = df.select("*", *[tokenizer(text_or_empty(c)).alias(f"_t_{c}") for c in columns])
    grams = {f"_i_{c}": word_grams(F.col(f"_t_{c}"), min_n, max_n) for c in columns}
    return _padded(add_ids(tokens, grams, vocab, key, oov), df.columns, columns, maxlen, padding)


def encode_chars(
    df: DataFrame,
    vocab: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    maxlen: int = CHAR_LENGTH,
    padding: str = "pre",
    min_n: int = 3,
    max_n: int = 6,
    word_bound: bool = False,
    whole_word: bool = False,
    oov: str | None = None,
) -> DataFrame:
    """As ``encode_words``, with character n-grams."""
    grams = {
        f"_i_{c}": char_grams(text_or_empty(c), min_n, max_n, word_bound, whole_word) for c in columns
    }
    return _padded(add_ids(df, grams, vocab, key, oov), df.columns, columns, maxlen, padding)


def _padded(df, kept, columns, maxlen, padding) -> DataFrame:
    return df.select(
        *kept,
        *[
            x
            for c in columns
            for x in (
                pad_ids(F.col(f"_i_{c}"), maxlen, padding).alias(f"{c}_ids"),
                F.size(f"_i_{c}").alias(f"{c}_len"),
            )
        ],
    )


def encode_both(
    df: DataFrame,
    word_vocab: DataFrame,
    char_vocab: DataFrame,
    column: str,
    key: Sequence[str],
    word_args: dict | None = None,
    char_args: dict | None = None,
) -> DataFrame:
    """Word ids followed by character ids in one array ``<column>_ids``."""
    w = encode_words(df, word_vocab, [column], key, **(word_args or {}))
    w = w.withColumnsRenamed({f"{column}_ids": "_w", f"{column}_len": "_wl"})
    c = encode_chars(w, char_vocab, [column], key, **(char_args or {}))
    return c.select(
        *df.columns,
        F.concat("_w", f"{column}_ids").alias(f"{column}_ids"),
        F.col("_wl").alias(f"{column}_word_len"),
        F.col(f"{column}_len").alias(f"{column}_char_len"),
    )


def encode_pairs(
    df: DataFrame, vocab: DataFrame, key: str = "commit", token: str = "word", columns: Sequence[str] | None = None
) -> DataFrame:
    """Before and after text (and contexts, where present) as id sequences bound by name.

    ``prev_data`` -> ``prev_features``, ``cur_data`` -> ``cur_features``; contexts keep theirs.
    """
    names = columns or [c for c in ("prev_data", "cur_data", "prev_context", "cur_context") if c in df.columns]
    if token == "word":
        out = encode_words(df, vocab, names, [key])
    elif token == "char":
        out = encode_chars(df, vocab, names, [key], min_n=1, max_n=1, word_bound=True)
    else:
        raise ValueError(f"unknown token kind: {token}")
    return out.select(
        key,
        *[F.col(f"{c}_ids").alias(c.replace("_data", "_features")) for c in names],
        *[F.col(f"{c}_len").alias(f"{c}_len") for c in names],
    )


def length_stats(df: DataFrame, length: str, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of sequence lengths above 0."""
    n = F.col(length)
    return (
        df.filter(n > 0)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(n).alias("shortest"),
            F.avg(n).alias("mean"),
            F.max(n).alias("longest"),
        )
    )
