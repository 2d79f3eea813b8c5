"""Code text as columns: cleaning, tokens, n-grams, ids and padding. All run inside the JVM."""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operator tokens of code text, tried in this order before words.
OPERATOR_TOKENS = [
    "<=", ">=", "<", ">", "?", "/=", "+=", "-=", "++", "--", "*=", "+", "-", "*", "/",
    "!=", "==", "=", "!", "&=", "&", "%", "||", "|=", "|", "$", ":",
]

# Fixed value: a word token is a run of ASCII letters and digits.
WORD_TOKEN = "[a-zA-Z0-9]+"

# Fixed value: the marker between changed files; one line break after it goes with it.
CHANGE_END = "##<END>##[\r\n]"

# Fixed value: whitespace as text splitting understands it (Unicode spaces and separators).
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Fixed value: the token pattern of the weighted term variants (a letter, then at least one more).
TERM_PATTERN = f"[^{SPACE}]*[A-Za-z][^{SPACE}]+"

# The Java keywords counted as change metrics.
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class",
    "continue", "const", "default", "do", "double", "else", "enum", "exports", "extends",
    "false", "final", "finally", "float", "for", "goto", "if", "implements", "import",
    "instanceof", "int", "interface", "long", "module", "native", "new", "null", "package",
    "private", "protected", "public", "requires", "return", "short", "static", "strictfp",
    "super", "switch", "synchronized", "this", "throw", "throws", "transient", "true", "try",
    "var", "void", "volatile", "while",
]

Tokenizer = Callable[[Column], Column]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def code_pattern() -> str:
    """Pattern of one code token, valid in Java and RE2."""
    operators = "|".join(re.sub(r"([?+*|$])", r"\\\1", t) for t in OPERATOR_TOKENS)
    return f"(?:{operators})|(?:{WORD_TOKEN})"


def text_or_empty(col: Column | str) -> Column:
    """NULL text as the empty string."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def clean_changes(col: Column | str) -> Column:
    """Text without the markers between changed files."""
    return F.regexp_replace(_c(col), CHANGE_END, "")


def find_all(col: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(group))


def _java_code() -> str:
    """``code_pattern`` for Java: words first, as no operator begins like one, and operators by their first character."""
    tails: dict[str, str] = {}
    for token in OPERATOR_TOKENS:
        tails[token[0]] = tails.get(token[0], "") + re.escape(token[1:])
    firsts: dict[str, str] = {}
    for first, tail in tails.items():
        firsts[tail] = firsts.get(tail, "") + re.escape(first)
    return "|".join([f"{WORD_TOKEN}+", *[f"[{first}]" + (f"[{tail}]?" if tail else "") for tail, first in firsts.items()]])


# The patterns of words and terms for Java, where the class of all that is not a space is very slow: most characters are
# settled by a plain range (printable ASCII, and letters up to U+167F), most ends by a blank or a line break, and
# nothing is tried twice. A term is a run of non-space characters with a letter that is not its last.
_PLAIN, _PLAIN_NO_LETTER = r"[!-~\xa1-\x{167f}]", r"[!-@\x5b-`{-~\xa1-\x{167f}]"
_JAVA_RUN = rf"(?:{_PLAIN}++(?:(?=[ \n])|[^{SPACE}]*+)|(?![ \n])[^{SPACE}]++)"
_JAVA_TERM = (
    rf"[A-Za-z]{_JAVA_RUN}|(?![ \n])(?<!{_PLAIN})(?<![^{SPACE}])"
    rf"(?:{_PLAIN_NO_LETTER}++|[^{SPACE}A-Za-z])[^{SPACE}A-Za-z]*+[A-Za-z]{_JAVA_RUN}"
)


def code_tokens(col: Column | str) -> Column:
    """Operators and alphanumeric words in order; case is kept."""
    return find_all(col, _java_code())


def words(col: Column | str) -> Column:
    """Runs of non-space characters."""
    return find_all(col, _JAVA_RUN)


def terms(col: Column | str) -> Column:
    """Lower-case tokens of the weighted term variants."""
    return find_all(F.lower(_c(col)), _JAVA_TERM)


def explode_tokens(df: DataFrame, tokens: Column, keys: Sequence[str] = (), name: str = "token") -> DataFrame:
    """One row per token.

    The outer form keeps the optimizer from adding a filter on the array's size, which would cut
    every text into tokens a second time below the projection. Empty texts give no row.
    """
    return df.select(*keys, F.explode_outer(tokens).alias(name)).filter(F.col(name).isNotNull())


def _empty() -> Column:
    return F.array().cast("array<string>")


def token_ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]))
    return F.when(F.size(tokens) >= n, grams).otherwise(_empty())


def word_grams(tokens: Column, min_n: int = 1, max_n: int = 1) -> Column:
    """All token n-grams, shorter ones first."""
    parts = [token_ngrams(tokens, n) for n in range(min_n, max_n + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def substrings(col: Column, n: int) -> Column:
    """All substrings of n characters, in one pass over the text.

    The lookahead captures n characters and one is consumed, so positions advance by whole
    characters; cutting with ``substring`` would start over from the front for each position.
    Single characters need no pattern.
    """
    if n == 1:
        return F.when(col == "", _empty()).otherwise(F.split(col, ""))
    return find_all(col, f"(?s)(?=(.{{{n}}})).", 1)


def _marked(word: Column) -> Column:
    return F.concat(F.lit("<"), word, F.lit(">"))


def word_char_grams(word_list: Column, min_n: int = 3, max_n: int = 6, whole_word: bool = False) -> Column:
    """Character n-grams within each word of an array, word by word.

    Per word: the marked whole word if asked for, then n-grams by length; a word shorter than
    ``min_n`` counts once as itself.
    """
    if min_n == max_n == 1 and not whole_word:
        return substrings(F.array_join(word_list, ""), 1)

    def of_word(w: Column) -> Column:
        parts = [F.array(_marked(w))] if whole_word else []
        parts += [substrings(w, n) for n in range(min_n, max_n + 1)]
        if min_n > 1:
            parts.append(F.when(F.char_length(w) < min_n, F.array(w)).otherwise(_empty()))
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return F.flatten(F.transform(word_list, of_word))


def char_grams(
    col: Column | str, min_n: int = 3, max_n: int = 6, word_bound: bool = False, whole_word: bool = False
) -> Column:
    """Character n-grams in reading order of the encoder: within words (``word_bound``) or across
    the text, there single characters, marked whole words, then longer n-grams by length."""
    text = _c(col)
    if word_bound:
        return word_char_grams(words(text), min_n, max_n, whole_word)
    parts = [substrings(text, 1)] if min_n == 1 else []
    if whole_word:
        parts.append(F.transform(words(text), _marked))
    parts += [substrings(text, n) for n in range(max(min_n, 2), max_n + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def pad_ids(ids: Column, maxlen: int, padding: str = "pre") -> Column:
    """The first ``maxlen`` ids, filled with 0 before (``pre``) or after (``post``)."""
    kept = F.slice(ids, 1, maxlen)
    fill = F.array_repeat(F.lit(0), F.greatest(F.lit(maxlen) - F.size(ids), F.lit(0)))
    if padding == "pre":
        return F.concat(fill, kept)
    if padding == "post":
        return F.concat(kept, fill)
    raise ValueError(f"unknown padding: {padding}")


LOOKUP_LIMIT = 20_000  # largest token table that is placed in the plan


def token_lookup(ids: dict[str, int], buckets: int = 1024) -> Callable[[Column], Column]:
    """Function token -> id (NULL if unknown) over a literal table.

    Spark searches a map from front to back, so the table is cut into many small maps by CRC-32
    and each search reads a handful of entries. The table must be small: it is part of the plan.
    """
    if len(ids) > LOOKUP_LIMIT:
        raise ValueError(f"{len(ids)} tokens exceed the lookup limit of {LOOKUP_LIMIT}")
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, i in ids.items():
        maps[zlib.crc32(token.encode()) % buckets][token] = i
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")

    def find(token: Column) -> Column:
        place = F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")
        return F.element_at(F.get(table, place), token)

    return find


def map_tokens(tokens: Column, find: Callable[[Column], Column], unknown: int | None = None) -> Column:
    """Ids of the tokens in order; unknown tokens are dropped, or get the id ``unknown``."""
    ids = F.transform(tokens, find)
    if unknown is None:
        return F.filter(ids, lambda i: i.isNotNull())
    return F.transform(ids, lambda i: F.coalesce(i, F.lit(unknown)))


def _kept(lists: pa.ListArray, keep: np.ndarray, values: pa.Array) -> pa.ListArray:
    """``values``, the kept items of ``lists``, as lists again; ``keep`` has a place per item."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    kept = np.concatenate([[0], np.cumsum(keep)])
    return pa.ListArray.from_arrays(pa.array(kept[np.concatenate([[0], ends])], pa.int32()), values)


def token_ids(ids: dict[str, int], unknown: int | None = None) -> Callable[[Column], Column]:
    """Function tokens -> ids by one hash lookup per Arrow batch; unknown tokens are dropped, or get the id ``unknown``.

    The same ids as ``map_tokens`` over ``token_lookup``, whose functions Spark interprets token by token.
    """
    known, numbers = pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.int32())

    def find(lists: pa.Array) -> pa.Array:
        found = pc.take(numbers, pc.index_in(lists.flatten(), value_set=known))
        if unknown is not None:
            found = pc.fill_null(found, unknown)
        return _kept(lists, np.asarray(found.is_valid()), found.drop_null())

    return F.arrow_udf(find, "array<int>")


def known_tokens(vocab: Sequence[str]) -> Callable[[Column], Column]:
    """Function tokens -> those of them that are in ``vocab``, in order."""
    known = pa.array(list(vocab), pa.string())

    def find(lists: pa.Array) -> pa.Array:
        keep = pc.is_in(lists.flatten(), value_set=known)
        return _kept(lists, np.asarray(keep), lists.flatten().filter(keep))

    return F.arrow_udf(find, "array<string>")


def keyword_counts(
    df: DataFrame, tokens: Column, keep: Sequence[str], keywords: Sequence[str] = tuple(JAVA_KEYWORDS)
) -> DataFrame:
    """Columns ``keep`` and one count column ``kw_<keyword>`` per keyword.

    Tokens are cut down to the keywords in a projection of their own, so the text is read once and
    each count goes over a short array.
    """
    hits = df.select(*keep, F.filter(tokens, lambda t: t.isin(*keywords)).alias("_hits"))

    def count(keyword: str) -> Column:
        return F.size(F.filter("_hits", lambda t: t == keyword))

    return hits.select(*keep, *[count(k).alias(f"kw_{k}") for k in keywords])


def letter_counts(text: Column, groups: Sequence[str]) -> Column:
    """How many characters of each group a text has: an array in the order of ``groups``, all 0 for NULL.

    Bytes of a text are counted in one pass; letters of two bytes are looked at by pairs, and longer ones one by one.
    """
    member = np.array([[chr(b) in group for group in groups] for b in range(128)], "int64")
    two = {c: int.from_bytes(c.encode(), "big") for group in groups for c in group if len(c.encode()) == 2}
    longer = [(c, i) for i, group in enumerate(groups) for c in set(group) if len(c.encode()) > 2]

    def count(batch: pa.Array) -> pa.Array:
        batch = pc.fill_null(batch.cast(pa.large_string()), "")
        found = np.zeros((len(batch), len(groups)), "int64")
        if len(batch):
            _, ends, data = batch.buffers()
            ends = np.frombuffer(ends, "int64")[batch.offset : batch.offset + len(batch) + 1]
            data = np.frombuffer(data or b"", "uint8")[: ends[-1]]
            for row, (a, b) in enumerate(itertools.pairwise(ends.tolist())):
                found[row] = np.bincount(data[a:b], minlength=128)[:128] @ member
            lead = np.flatnonzero(data[:-1] >= 0xC2)
            pair = data[lead].astype("uint16") << 8 | data[lead + 1]
            row = np.searchsorted(ends, lead, side="right") - 1
            for i, group in enumerate(groups):
                for c in set(group) & two.keys():
                    found[:, i] += np.bincount(row[(pair == two[c]) & (row >= 0)], minlength=len(batch))
            for c, i in longer:
                found[:, i] += np.asarray(pc.count_substring(batch, c))
        at = np.arange(len(batch) + 1, dtype="int32") * len(groups)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.ravel()))

    return F.arrow_udf(count, "array<bigint>")(text)
