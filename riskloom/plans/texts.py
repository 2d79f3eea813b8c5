"""Text and sequence queries over documents and conversations."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from riskloom.functions.text import (
    JAVA_KEYWORDS,
    SPACE,
    TERM_PATTERN,
    clean_changes,
    code_pattern,
    code_tokens,
    keyword_counts,
)
from riskloom.operators.bags import bow_counts, bow_fit, bow_transform, tfidf
from riskloom.operators.encode import (
    encode_both,
    encode_chars,
    encode_pairs,
    encode_words,
    length_stats,
)
from riskloom.operators.folds import time_folds, time_order
from riskloom.operators.vocab import (
    doc_frequency,
    fold_vocab,
    merge_counts,
    stack_texts,
    term_frequency,
    vocab_chars,
    vocab_report,
    vocab_words,
    with_ids,
)
from riskloom.plans.forecast import rounded
from riskloom.plans.registry import query, table
from riskloom.plans.views import part_sql
from riskloom.session import spread


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


CODE = q(code_pattern())
WORDS = q(f"[^{SPACE}]+")


def documents(spark, sf):
    return spread(table(spark, sf, "documents"))


def change_pairs(spark, sf):
    """User turns as text before, the turn after as text after; no next turn gives NULL."""
    c = table(spark, sf, "conversations")
    prev = c.filter(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("commit"),
        "conv_id",
        (F.col("turn") + 1).alias("turn"),
        F.col("text").alias("prev_data"),
    )
    cur = c.select("conv_id", "turn", F.col("text").alias("cur_data"))
    return prev.join(cur, ["conv_id", "turn"], "left").select("commit", "prev_data", "cur_data")


PAIRS_SQL = """pairs AS (
  SELECT p.conv_id || '-' || p.turn AS commit, p.text AS prev_data, c.text AS cur_data
  FROM conversations p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1
  WHERE p.role = 'user')"""


@query(
    "clean_changes",
    """SELECT doc_id, md5(regexp_replace(chr(10) || replace(text, '. ', '.##<END>##' || chr(10)), '##<END>##[\r\n]', '', 'g')) AS cleaned
    FROM documents""",
)
def _clean(spark, sf):
    marked = F.concat(F.lit("\n"), F.replace("text", F.lit(". "), F.lit(".##<END>##\n")))
    return documents(spark, sf).select("doc_id", F.md5(clean_changes(marked)).alias("cleaned"))


@query(
    "code_tokens",
    f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens
    FROM (SELECT doc_id, regexp_extract_all(text, {CODE}) AS t FROM documents)""",
)
def _code_tokens(spark, sf):
    d = documents(spark, sf).select("doc_id", code_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.concat_ws(" ", "t")).alias("tokens"))


@query(
    "stack_texts",
    f"""WITH {PAIRS_SQL} SELECT coalesce(x, '') AS text, count(*) AS n
    FROM (SELECT prev_data AS x FROM pairs UNION ALL SELECT cur_data FROM pairs) GROUP BY 1""",
)
def _stack(spark, sf):
    return stack_texts(change_pairs(spark, sf), ["prev_data", "cur_data"]).groupBy("text").agg(
        F.count(F.lit(1)).alias("n")
    )


def word_vocab_sql(name: str, texts: str, pattern: str, limit: int, max_n: int = 1) -> str:
    grams = "t" if max_n == 1 else (
        "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
    )
    return f"""{name}_t AS (SELECT regexp_extract_all(x, {pattern}) AS t FROM ({texts})),
{name} AS (
  SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id, count(*) AS doc_freq
  FROM (SELECT unnest(list_distinct({grams})) AS token FROM {name}_t) GROUP BY token
  ORDER BY doc_freq DESC, token LIMIT {limit})"""


DOC_TEXTS = "SELECT coalesce(text, '') AS x FROM documents"


@query("vocab_words", f"WITH {word_vocab_sql('v', DOC_TEXTS, WORDS, 5000, 2)} SELECT * FROM v")
def _vocab_words(spark, sf):
    return vocab_words(documents(spark, sf), min_n=1, max_n=2, max_vocab=5000)


@query(
    "vocab_by_share",
    f"""WITH t AS (SELECT regexp_extract_all(x, {CODE}) AS t FROM ({DOC_TEXTS})),
    c AS (SELECT token, count(*) AS doc_freq FROM (SELECT unnest(list_distinct(t)) AS token FROM t) GROUP BY token
          HAVING doc_freq / (SELECT count(*) FROM documents)::DOUBLE BETWEEN 0.01 AND 0.6),
    v AS (SELECT token, row_number() OVER (ORDER BY doc_freq DESC, token) AS id, doc_freq FROM c)
    SELECT token, CAST(id AS INTEGER) AS id, doc_freq FROM v
    UNION ALL SELECT '<oov>', CAST(count(*) + 1 AS INTEGER), NULL FROM v""",
)
def _vocab_share(spark, sf):
    return vocab_words(
        documents(spark, sf), tokenizer=code_tokens, min_df=0.01, max_df=0.6, oov="<oov>"
    )


# Substrings of n characters of a word w, in SQL.
def _sub(n: int) -> str:
    return f"list_transform(range(1, length(w) - {n} + 2), lambda i: substring(w, i, {n}))"


CHAR_GRAMS_SQL = (
    "CASE WHEN length(w) < 3 THEN ['<' || w || '>', w] ELSE list_concat(['<' || w || '>'], "
    + f"list_concat({_sub(3)}, list_concat({_sub(4)}, list_concat({_sub(5)}, {_sub(6)})))) END"
)


@query(
    "vocab_chars",
    f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {WORDS})) AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest({CHAR_GRAMS_SQL}) AS token FROM w)
    SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id, count(*) AS doc_freq
    FROM g GROUP BY token ORDER BY doc_freq DESC, token LIMIT 5000""",
)
def _vocab_chars(spark, sf):
    return vocab_chars(
        documents(spark, sf), word_bound=True, whole_word=True, max_vocab=5000
    )


@query(
    "vocab_chars_across",
    """WITH g AS (
      SELECT DISTINCT doc_id, substring(text, i, n) AS token
      FROM (SELECT doc_id, text, n, unnest(range(1, length(text) - n + 2)) AS i
            FROM (SELECT turn + 100 * conv_id AS doc_id, text FROM conversations), (VALUES (1), (2), (3)) s(n)))
    SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id, count(*) AS doc_freq
    FROM g GROUP BY token ORDER BY doc_freq DESC, token LIMIT 3000""",
)
def _vocab_chars_across(spark, sf):
    return vocab_chars(table(spark, sf, "conversations"), min_n=1, max_n=3, max_vocab=3000)


@query(
    "vocab_merge",
    f"""WITH t AS (SELECT regexp_extract_all(text, {CODE}) AS t FROM documents
                   UNION ALL SELECT regexp_extract_all(text, {CODE}) FROM conversations)
    SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id, count(*) AS doc_freq
    FROM (SELECT unnest(list_distinct(t)) AS token FROM t) GROUP BY token ORDER BY doc_freq DESC, token LIMIT 2000""",
)
def _vocab_merge(spark, sf):
    sides = [
        doc_frequency(spread(table(spark, sf, n)).select(code_tokens("text").alias("t")), F.col("t"))
        for n in ("documents", "conversations")
    ]
    return with_ids(merge_counts(*sides), "doc_freq", 2000)


@query(
    "vocab_report",
    f"""SELECT token, count(*) AS term_freq
    FROM (SELECT unnest(regexp_extract_all(text, {CODE})) AS token FROM documents) GROUP BY token""",
)
def _vocab_report(spark, sf):
    d = documents(spark, sf).select(code_tokens("text").alias("t"))
    return vocab_report(term_frequency(d, F.col("t")), "term_freq")


def _pad_sql(ids: str, maxlen: int, padding: str) -> str:
    fill = f"list_transform(range(greatest({maxlen} - len({ids}), 0)), lambda z: CAST(0 AS INTEGER))"
    kept = f"{ids}[1:{maxlen}]"
    return f"list_concat({fill}, {kept})" if padding == "pre" else f"list_concat({kept}, {fill})"


@query(
    "encode_words",
    f"""WITH {word_vocab_sql('v', DOC_TEXTS, CODE, 2000, 2)},
    t AS (SELECT doc_id, regexp_extract_all(text, {CODE}) AS t FROM documents),
    g AS (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM t),
    u AS (SELECT doc_id, unnest(g) AS token, generate_subscripts(g, 1) AS pos FROM g),
    e AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM u JOIN v USING (token) GROUP BY doc_id),
    a AS (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN e USING (doc_id))
    SELECT doc_id, {_pad_sql('ids', 512, 'pre')} AS text_ids, CAST(len(ids) AS INTEGER) AS text_len FROM a""",
)
def _encode_words(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    vocab = vocab_words(d, tokenizer=code_tokens, max_n=2, max_vocab=2000)
    return encode_words(d, vocab, ["text"], ["doc_id"], max_n=2).drop("text")


CHAR_VOCAB_SQL = f"""cv AS (
  SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id, count(*) AS doc_freq
  FROM (SELECT DISTINCT doc_id, unnest(string_split(w, '')) AS token
        FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {WORDS})) AS w FROM documents))
  GROUP BY token ORDER BY doc_freq DESC, token LIMIT 10000)"""

CHAR_IDS_SQL = f"""chars AS (
  SELECT doc_id, string_split(array_to_string(regexp_extract_all(text, {WORDS}), ''), '') AS c FROM documents),
char_ids AS (
  SELECT doc_id, list(id ORDER BY pos) AS ids
  FROM (SELECT doc_id, unnest(c) AS token, generate_subscripts(c, 1) AS pos FROM chars) JOIN cv USING (token)
  GROUP BY doc_id)"""


@query(
    "encode_chars",
    f"""WITH {CHAR_VOCAB_SQL}, {CHAR_IDS_SQL}
    SELECT doc_id, {_pad_sql('ids', 1024, 'post')} AS text_ids, CAST(len(ids) AS INTEGER) AS text_len
    FROM (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN char_ids USING (doc_id))""",
)
def _encode_chars(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    vocab = vocab_chars(d, min_n=1, max_n=1, word_bound=True, max_vocab=10_000)
    return encode_chars(d, vocab, ["text"], ["doc_id"], min_n=1, max_n=1, word_bound=True, padding="post").drop("text")


@query(
    "encode_both",
    f"""WITH {word_vocab_sql('v', DOC_TEXTS, CODE, 10000)}, {CHAR_VOCAB_SQL}, {CHAR_IDS_SQL},
    word_ids AS (
      SELECT doc_id, list(coalesce(id, (SELECT max(id) + 1 FROM v)) ORDER BY pos) AS ids
      FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
            FROM (SELECT doc_id, regexp_extract_all(text, {CODE}) AS t FROM documents)) LEFT JOIN v USING (token)
      GROUP BY doc_id),
    a AS (SELECT doc_id, coalesce(w.ids, []) AS wi, coalesce(c.ids, []) AS ci
          FROM documents LEFT JOIN word_ids w USING (doc_id) LEFT JOIN char_ids c USING (doc_id))
    SELECT doc_id, list_concat({_pad_sql('wi', 512, 'pre')}, {_pad_sql('ci', 1024, 'pre')}) AS text_ids,
           CAST(len(wi) AS INTEGER) AS text_word_len, CAST(len(ci) AS INTEGER) AS text_char_len FROM a""",
)
def _encode_both(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    w = vocab_words(d, tokenizer=code_tokens, max_vocab=10_000, oov="<oov>")
    c = vocab_chars(d, min_n=1, max_n=1, word_bound=True, max_vocab=10_000)
    return encode_both(
        d, w, c, "text", ["doc_id"],
        {"maxlen": 512, "oov": "<oov>"},
        {"maxlen": 1024, "min_n": 1, "max_n": 1, "word_bound": True},
    ).drop("text")


PAIR_TEXTS = "SELECT coalesce(prev_data, '') AS x FROM pairs UNION ALL SELECT coalesce(cur_data, '') FROM pairs"


def _pair_ids_sql(side: str) -> str:
    return f"""{side}_ids AS (
      SELECT commit, list(id ORDER BY pos) AS ids
      FROM (SELECT commit, unnest(t) AS token, generate_subscripts(t, 1) AS pos
            FROM (SELECT commit, regexp_extract_all(coalesce({side}_data, ''), {CODE}) AS t FROM pairs)) JOIN v USING (token)
      GROUP BY commit)"""


@query(
    "encode_pairs",
    f"""WITH {PAIRS_SQL}, {word_vocab_sql('v', PAIR_TEXTS, CODE, 10000)}, {_pair_ids_sql('prev')}, {_pair_ids_sql('cur')},
    a AS (SELECT commit, coalesce(p.ids, []) AS pi, coalesce(c.ids, []) AS ci
          FROM pairs LEFT JOIN prev_ids p USING (commit) LEFT JOIN cur_ids c USING (commit))
    SELECT commit, {_pad_sql('pi', 512, 'pre')} AS prev_features, {_pad_sql('ci', 512, 'pre')} AS cur_features,
           CAST(len(pi) AS INTEGER) AS prev_data_len, CAST(len(ci) AS INTEGER) AS cur_data_len FROM a""",
)
def _encode_pairs(spark, sf):
    pairs = change_pairs(spark, sf)
    vocab = vocab_words(stack_texts(pairs, ["prev_data", "cur_data"]), tokenizer=code_tokens, max_vocab=10_000)
    return encode_pairs(pairs, vocab)


def change_contexts(spark, sf):
    """Change pairs with the turn before the pair and the turn after it as contexts."""
    c = table(spark, sf, "conversations")
    users = c.filter(F.col("role") == "user").select("conv_id", "turn")
    out = users
    for name, step in (("prev_data", 0), ("cur_data", 1), ("prev_context", -1), ("cur_context", 2)):
        out = out.join(c.select("conv_id", (F.col("turn") - step).alias("turn"), F.col("text").alias(name)), ["conv_id", "turn"], "left")
    return out.withColumn("commit", F.concat_ws("-", "conv_id", "turn")).drop("conv_id", "turn")


def _context_sql() -> str:
    names = {"prev_data": 0, "cur_data": 1, "prev_context": -1, "cur_context": 2}
    joins = " ".join(f"LEFT JOIN conversations {n} ON {n}.conv_id = p.conv_id AND {n}.turn = p.turn + {step}" for n, step in names.items())
    texts = " UNION ALL ".join(f"SELECT coalesce({n}, '') AS x FROM four" for n in names)
    ids = ", ".join(
        f"""{n}_ids AS (SELECT commit, list(id ORDER BY pos) AS {n}_i FROM (SELECT commit, unnest(t) AS token, generate_subscripts(t, 1) AS pos
        FROM (SELECT commit, regexp_extract_all(coalesce({n}, ''), {CODE}) AS t FROM four)) JOIN v USING (token) GROUP BY commit)""" for n in names
    )
    cells = ", ".join(
        f"{_pad_sql(f'coalesce({n}_i, [])', 512, 'pre')} AS {n.replace('_data', '_features')}, CAST(len(coalesce({n}_i, [])) AS INTEGER) AS {n}_len" for n in names
    )
    return f"""WITH four AS (SELECT p.conv_id || '-' || p.turn AS commit, {", ".join(f"{n}.text AS {n}" for n in names)}
      FROM conversations p {joins} WHERE p.role = 'user'), {word_vocab_sql('v', texts, CODE, 10000)}, {ids}
    SELECT commit, {cells} FROM four {" ".join(f"LEFT JOIN {n}_ids USING (commit)" for n in names)}"""


@query("encode_contexts", _context_sql())
def _encode_contexts(spark, sf):
    changes = change_contexts(spark, sf)
    names = ["prev_data", "cur_data", "prev_context", "cur_context"]
    vocab = vocab_words(stack_texts(changes, names), tokenizer=code_tokens, max_vocab=10_000)
    return encode_pairs(changes, vocab)


def _pair_chars_sql() -> str:
    def side(n: str) -> str:
        return f"""{n}_ids AS (SELECT commit, list(id ORDER BY pos) AS {n}_i FROM (SELECT commit, unnest(c) AS token, generate_subscripts(c, 1) AS pos
        FROM (SELECT commit, string_split(array_to_string(regexp_extract_all(coalesce({n}_data, ''), {WORDS}), ''), '') AS c FROM pairs)) JOIN v USING (token) GROUP BY commit)"""

    cells = ", ".join(f"{_pad_sql(f'coalesce({n}_i, [])', 1024, 'pre')} AS {n}_features, CAST(len(coalesce({n}_i, [])) AS INTEGER) AS {n}_data_len" for n in ("prev", "cur"))
    return f"""WITH {PAIRS_SQL}, texts AS (SELECT row_number() OVER () AS r, x FROM ({PAIR_TEXTS})),
    v AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id FROM (
      SELECT DISTINCT r, unnest(string_split(w, '')) AS token FROM (SELECT DISTINCT r, unnest(regexp_extract_all(x, {WORDS})) AS w FROM texts))
      GROUP BY token ORDER BY count(*) DESC, token LIMIT 10000), {side('prev')}, {side('cur')}
    SELECT commit, {cells} FROM pairs LEFT JOIN prev_ids USING (commit) LEFT JOIN cur_ids USING (commit)"""


@query("encode_pair_chars", _pair_chars_sql())
def _encode_pair_chars(spark, sf):
    pairs = change_pairs(spark, sf)
    vocab = vocab_chars(stack_texts(pairs, ["prev_data", "cur_data"]), min_n=1, max_n=1, word_bound=True, max_vocab=10_000)
    return encode_pairs(pairs, vocab, token="char")


@query(
    "length_stats",
    f"""SELECT lang, count(*) AS n, CAST(min(l) AS INTEGER) AS shortest, round(avg(l), 8) AS mean, CAST(max(l) AS INTEGER) AS longest
    FROM (SELECT lang, len(regexp_extract_all(text, {CODE})) AS l FROM documents) WHERE l > 0 GROUP BY lang""",
)
def _length_stats(spark, sf):
    d = documents(spark, sf).select("lang", F.size(code_tokens("text")).alias("l"))
    return rounded(length_stats(d, "l", ["lang"]))


@query(
    "keyword_counts",
    "WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, "
    + CODE
    + "), lambda w: w IN ("
    + ", ".join(q(k) for k in JAVA_KEYWORDS)
    + ")) AS t FROM documents) SELECT doc_id, "
    + ", ".join(
        f"CAST(len(list_filter(t, lambda w: w = {q(k)})) AS INTEGER) AS kw_{k}" for k in JAVA_KEYWORDS
    )
    + " FROM t",
)
def _keywords(spark, sf):
    return keyword_counts(documents(spark, sf), code_tokens("text"), ["doc_id"])


def docs_with_parts(spark, sf):
    """Documents in id order, cut into 12 parts.

    The order is that of the ids, so a part is a range of ids: texts meet the first id of each part, not a table.
    """
    d = documents(spark, sf).select("doc_id", "text").where("doc_id IS NOT NULL")
    parts = time_folds(time_order(d.select("doc_id", F.col("doc_id").alias("date")), "doc_id", "date"))
    # One row per part.
    first = parts.groupBy("time_partition").agg(F.min("doc_id").alias("first")).collect()
    part = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col("doc_id") >= r["first"], r["time_partition"]).otherwise(0) for r in first])
    return d.withColumn("time_partition", part.cast("int"))


DOC_PARTS_SQL = f"""doc_pos AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents),
doc_parts AS (SELECT doc_id, text, {part_sql(12)} AS time_partition FROM doc_pos)"""


@query(
    "fold_vocab",
    f"""WITH {DOC_PARTS_SQL},
    tok AS (SELECT time_partition, unnest(list_distinct(regexp_extract_all(text, {CODE}))) AS token FROM doc_parts),
    c AS (SELECT CAST(f.i AS INTEGER) AS fold, token, count(*) AS doc_freq FROM tok, range(10) f(i)
          WHERE time_partition <= f.i GROUP BY ALL)
    SELECT fold, token, CAST(row_number() OVER (PARTITION BY fold ORDER BY doc_freq DESC, token) AS INTEGER) AS id, doc_freq
    FROM c QUALIFY id <= 3000""",
)
def _fold_vocab(spark, sf):
    d = docs_with_parts(spark, sf).select("time_partition", code_tokens("text").alias("t"))
    return fold_vocab(d, F.col("t"), max_vocab=3000)


CLEAN_CODE = f"regexp_extract_all(regexp_replace(text, '##<END>##[\r\n]', '', 'g'), {CODE})"
BAG_SQL = f"""terms AS (SELECT doc_id, unnest({CLEAN_CODE}) AS token FROM documents),
bag AS (
  SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS INTEGER) AS id, count(*) AS term_freq
  FROM terms GROUP BY token ORDER BY term_freq DESC, token LIMIT 10000)"""


@query("bow_fit", f"WITH {BAG_SQL} SELECT * FROM bag")
def _bow_fit(spark, sf):
    return bow_fit(documents(spark, sf), ["text"])


@query("bow_counts", f"WITH {BAG_SQL} SELECT doc_id, id, count(*) AS n FROM terms JOIN bag USING (token) GROUP BY ALL")
def _bow_counts(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    return bow_counts(d, bow_fit(d, ["text"]), "text", ["doc_id"])


@query("bow_transform", f"WITH {BAG_SQL} SELECT id, CAST(term_freq AS DOUBLE) AS total FROM bag")
def _bow_transform(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    bags = bow_transform(d, bow_fit(d, ["text"]), ["text"])
    sums = bags.agg(vector_to_array(Summarizer.sum(F.col("text_bow"))).alias("s"))
    return rounded(sums.select(F.posexplode("s").alias("id", "total")))


def _tfidf_sql(tokens: str, min_df: float, idf: bool) -> str:
    weight = "n * (ln((1.0 + docs) / (1.0 + df)) + 1.0)" if idf else "CAST(n AS DOUBLE)"
    norm = "weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id))" if idf else "weight"
    return f"""WITH t AS ({tokens}),
    c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL),
    d AS (SELECT token, count(*) AS df, (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS docs FROM c GROUP BY token
          HAVING df >= CAST({min_df} AS DOUBLE) * docs),
    w AS (SELECT doc_id, token, {weight} AS weight FROM c JOIN d USING (token))
    SELECT doc_id, token, round({norm}, 8) AS weight FROM w"""


TERMS_T = f"list_filter(regexp_extract_all(lower(text), {q(TERM_PATTERN)}), lambda w: w <> 'aka')"


@query("tfidf_counts", _tfidf_sql(f"SELECT doc_id, unnest({CLEAN_CODE}) AS token FROM documents", 0.01, False))
def _tfidf_counts(spark, sf):
    return rounded(tfidf(documents(spark, sf), "text", "doc_id", variant=1))


@query("tfidf", _tfidf_sql(f"SELECT doc_id, unnest({TERMS_T}) AS token FROM documents", 0.001, True))
def _tfidf(spark, sf):
    return rounded(tfidf(documents(spark, sf), "text", "doc_id", variant=2))


@query(
    "tfidf_ngrams",
    _tfidf_sql(
        "SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS token "
        f"FROM (SELECT doc_id, {TERMS_T} AS t FROM documents)",
        0.001,
        True,
    ),
)
def _tfidf_ngrams(spark, sf):
    return rounded(tfidf(documents(spark, sf), "text", "doc_id", variant=6, min_n=1, max_n=2))
