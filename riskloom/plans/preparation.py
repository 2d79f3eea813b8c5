"""From commits, advisories and change texts to the commit map and per-fold features."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import char_grams, code_tokens, pad_ids, text_or_empty
from riskloom.operators.aggregates import first_per_group
from riskloom.operators.bags import BAG_SIZE
from riskloom.operators.embeddings import VECTOR_SIZE, mean_of_known, w2v_train
from riskloom.operators.encode import CHAR_LENGTH, WORD_LENGTH, fold_ids
from riskloom.operators.folds import holdout_split, random_folds, time_folds, time_order
from riskloom.operators.joins import left_join
from riskloom.operators.vocab import SPLITS, change_tokens, fold_vocab, stack_texts, trains
from riskloom.plans.forecast import RANDOM_PARTS_SQL
from riskloom.plans.registry import query, table
from riskloom.plans.texts import CODE, PAIRS_SQL, _pad_sql, change_pairs
from riskloom.plans.views import ORDERED_SQL, change_stream, part_sql
from riskloom.session import broadcast_if_small, materialise, spread

# Folds whose word vectors are trained at a time.
FITS = 3

def commit_map(commits: DataFrame, advisories: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Commits with advisory labels, holdout set, random fold and time part.

    Every commit gets its set and folds once, by its first date; the rows of a commit share them.
    """
    data = left_join(commits, advisories, ["id"]) if advisories is not None else commits
    ordered = time_folds(holdout_split(time_order(commits)))
    # Both sides are one row per commit.
    folds = ordered.select("commit", "set", "time_partition").join(random_folds(commits, seed=seed), "commit")
    return data.join(folds, "commit")


def raw_changes(df: DataFrame, names: dict[str, str], key: str = "commit") -> DataFrame:
    """Change texts under their standard names: NULL is empty, one row per commit.

    ``names`` maps source to standard columns. Of several rows of a commit the first by text stays.
    """
    texts = df.select(F.col(key).alias("commit"), *[text_or_empty(a).alias(b) for a, b in names.items()])
    return first_per_group(texts, ["commit"], list(names.values()))


def _fold_table(parts: DataFrame, texts: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    # Texts stay where they are while the parts are few.
    labelled = texts.join(broadcast_if_small(materialise(parts.select("commit", SPLITS[split]), "parts")), "commit")
    return stack_texts(labelled, columns, keep=[SPLITS[split]])


def fold_sequences(
    changes: DataFrame, files: DataFrame, parts: DataFrame, token: str = "word",
    folds: Sequence[int] = tuple(range(10)), max_vocab: int = BAG_SIZE, split: str = "time",
    columns: Sequence[str] = ("prev_data", "cur_data"), file_columns: Sequence[str] = ("prev_file", "cur_file"),
) -> DataFrame:
    """Id sequences of every change for every fold: fold, commit, ``<side>_features``.

    The vocabulary of a fold comes from the files of its training parts; all folds are counted in one
    pass. Change texts are cut into tokens once and meet the ids of all folds in one join. ``split`` is ``time``,
    ``random`` or ``holdout``; ``parts`` has commit and the column of that split.
    """
    if token == "word":
        cut, length = (lambda c: code_tokens(text_or_empty(c))), WORD_LENGTH
    elif token == "char":
        cut, length = (lambda c: char_grams(text_or_empty(c), 1, 1, word_bound=True)), CHAR_LENGTH
    else:
        raise ValueError(f"unknown token kind: {token}")
    corpus = _fold_table(parts, files, file_columns, split).select(SPLITS[split], cut("text").alias("_t"))
    vocab = fold_vocab(corpus, F.col("_t"), folds=folds, max_vocab=max_vocab, split=split)
    ids = fold_ids(changes, {f"_i_{c}": cut(c) for c in columns}, vocab, folds, ["commit"])
    return ids.select("fold", "commit", *[pad_ids(F.col(f"_i_{c}"), length).alias(c.replace("_data", "_features")) for c in columns])


def fold_bags(
    changes: DataFrame, files: DataFrame, parts: DataFrame, folds: Sequence[int] = tuple(range(10)),
    columns: Sequence[str] = ("prev_data", "cur_data"), file_columns: Sequence[str] = ("prev_file", "cur_file"),
    size: int = BAG_SIZE, split: str = "time",
) -> DataFrame:
    """Count vectors of every change for every fold, by the commonest tokens of its training files.

    Tokens become the numbers of their places (from 0, commonest first) in one join for all folds, so one
    counting model, over the numbers, serves every fold.
    """
    corpus = _fold_table(parts, files, file_columns, split).select(SPLITS[split], change_tokens("text").alias("_t"))
    vocab = fold_vocab(corpus, F.col("_t"), folds=folds, max_vocab=size, split=split, count="term_freq")
    rows = fold_ids(changes, {c: change_tokens(c) for c in columns}, vocab, folds, ["commit"])
    model = CountVectorizerModel.from_vocabulary([str(i + 1) for i in range(size)], inputCol="_", outputCol="_")
    rows = rows.select("fold", "commit", *[F.col(c).cast("array<string>").alias(f"_n_{c}") for c in columns])
    for c in columns:
        rows = model.setInputCol(f"_n_{c}").setOutputCol(c.replace("_data", "_features")).transform(rows)
    return rows.drop(*[f"_n_{c}" for c in columns])


def fold_embeddings(
    changes: DataFrame, files: DataFrame, parts: DataFrame, folds: Sequence[int] = tuple(range(10)),
    columns: Sequence[str] = ("prev_data", "cur_data"), file_columns: Sequence[str] = ("prev_file", "cur_file"),
    size: int = VECTOR_SIZE, split: str = "time",
) -> DataFrame:
    """Mean word vectors of every change for every fold; one model per fold's training files.

    Files and changes are cut into tokens once for all folds, and ``FITS`` folds are trained at a time, so that the
    few parts of an early fold do not leave the cluster idle.
    """
    labelled = files.join(broadcast_if_small(materialise(parts.select("commit", SPLITS[split]), "parts")), "commit")
    texts = stack_texts(labelled, file_columns, keep=[SPLITS[split]])
    corpus = materialise(texts.select(SPLITS[split], change_tokens("text").alias("_t")), "sentences")
    cut = materialise(changes.select("commit", *[change_tokens(c).alias(c) for c in columns]), "changes")

    def of_fold(fold: int) -> DataFrame:
        model = w2v_train(corpus.filter(trains(split, F.col(SPLITS[split]), fold)).select("_t"), size)
        names = {c: c.replace("_data", "_features") for c in columns}
        return mean_of_known(cut, model, names).select(F.lit(int(fold)).alias("fold"), "commit", *names.values())

    with ThreadPoolExecutor(FITS) as pool:
        return reduce(DataFrame.unionByName, pool.map(of_fold, folds))


# --- queries ------------------------------------------------------------------------------------


@query(
    "commit_map",
    f"""WITH {ORDERED_SQL}, {RANDOM_PARTS_SQL},
    placed AS (SELECT commit, {part_sql(12)} AS time_partition, CASE WHEN position < floor(CAST(0.8 AS DOUBLE) * n) THEN 'train'
      WHEN position < floor(CAST(0.9 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS "set" FROM ordered)
    SELECT c.commit, c.id, c.priority, u.c_acctbal AS base_score, u.c_mktsegment AS severity, p."set", r."partition", p.time_partition
    FROM changes c LEFT JOIN customer u ON u.c_custkey = c.id JOIN placed p USING (commit) JOIN random_parts r USING (commit)""",
)
def _commit_map(spark, sf):
    commits = change_stream(spark, sf).drop("status")
    adv = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("base_score"), F.col("c_mktsegment").alias("severity")
    )
    return commit_map(commits, adv).drop("date")


@query(
    "raw_changes",
    """SELECT CAST(conv_id AS VARCHAR) AS commit, coalesce(role, '') AS prev_data, coalesce(text, '') AS cur_data FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(role, ''), coalesce(text, '')) = 1""",
)
def _raw(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("commit"), "role", "text")
    return raw_changes(c, {"role": "prev_data", "text": "cur_data"})


def pair_parts(spark, sf):
    """Pairs of turns as changes with all three ways of splitting: time and random parts, and the holdout set."""
    pairs = materialise(change_pairs(spark, sf), "pairs")
    commits = pairs.select("commit", F.col("commit").alias("date"))
    ordered = time_folds(holdout_split(time_order(commits)))
    return spread(pairs), ordered.join(random_folds(commits), "commit")


PAIR_PARTS_SQL = (
    PAIRS_SQL
    + f""",
pair_pos AS (SELECT commit, row_number() OVER (ORDER BY commit) - 1 AS position, count(*) OVER () AS n FROM pairs),
pair_draw AS (SELECT commit, row_number() OVER (ORDER BY md5(commit || '|42'), commit) - 1 AS position, count(*) OVER () AS n FROM pairs),
pair_random AS (SELECT commit, {part_sql(10)} AS random_part FROM pair_draw),
pair_parts AS (SELECT commit, {part_sql(12)} AS time_part, random_part, position < floor(CAST(0.8 AS DOUBLE) * n) AS in_train
  FROM pair_pos JOIN pair_random USING (commit))"""
)
#: Whether a row trains in fold f.i, by split.
TRAINS_SQL = {"time": "time_part <= f.i", "random": "random_part <> f.i", "holdout": "in_train"}
FOLDS = {"time": tuple(range(10)), "random": tuple(range(10)), "holdout": (0,)}


def _files(pairs):
    return pairs.select("commit", F.col("prev_data").alias("prev_file"), F.col("cur_data").alias("cur_file"))


def _sequences_sql(split: str) -> str:
    def side(c: str) -> str:
        return f"""u_{c} AS (SELECT commit, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT commit, regexp_extract_all(coalesce({c}_data, ''), {CODE}) AS t FROM pairs)),
    e_{c} AS (SELECT fold, commit, list(id ORDER BY pos) AS {c}_ids FROM u_{c} JOIN v USING (token) GROUP BY ALL)"""

    n = len(FOLDS[split])
    return f"""WITH {PAIR_PARTS_SQL},
    texts AS (SELECT time_part, random_part, in_train, regexp_extract_all(x, {CODE}) AS t FROM (
      SELECT time_part, random_part, in_train, unnest([coalesce(prev_data, ''), coalesce(cur_data, '')]) AS x FROM pairs JOIN pair_parts USING (commit))),
    toks AS (SELECT time_part, random_part, in_train, unnest(list_distinct(t)) AS token FROM texts),
    v AS (SELECT CAST(f.i AS INTEGER) AS fold, token, CAST(row_number() OVER (PARTITION BY f.i ORDER BY count(*) DESC, token) AS INTEGER) AS id
          FROM toks, range({n}) f(i) WHERE {TRAINS_SQL[split]} GROUP BY f.i, token QUALIFY id <= 10000),
    {side('prev')}, {side('cur')}
    SELECT CAST(f.i AS INTEGER) AS fold, p.commit, {_pad_sql('coalesce(prev_ids, [])', 512, 'pre')} AS prev_features, {_pad_sql('coalesce(cur_ids, [])', 512, 'pre')} AS cur_features
    FROM pairs p CROSS JOIN range({n}) f(i) LEFT JOIN e_prev a ON a.fold = f.i AND a.commit = p.commit LEFT JOIN e_cur b ON b.fold = f.i AND b.commit = p.commit"""


def _bags_sql(split: str) -> str:
    n = len(FOLDS[split])
    bag = lambda c: f"coalesce(list_sort(list({{'i': id, 'n': n}}) FILTER (side = '{c}')), [])"
    return f"""WITH {PAIR_PARTS_SQL},
    toks AS (SELECT time_part, random_part, in_train, commit, side, unnest(regexp_extract_all(x, {CODE})) AS token FROM (
      SELECT time_part, random_part, in_train, commit, 'p' AS side, coalesce(prev_data, '') AS x FROM pairs JOIN pair_parts USING (commit)
      UNION ALL SELECT time_part, random_part, in_train, commit, 'c', coalesce(cur_data, '') FROM pairs JOIN pair_parts USING (commit))),
    v AS (SELECT f.i AS fold, token, CAST(row_number() OVER (PARTITION BY f.i ORDER BY count(*) DESC, token) - 1 AS INTEGER) AS id
          FROM toks, range({n}) f(i) WHERE {TRAINS_SQL[split]} GROUP BY f.i, token QUALIFY id < 10000),
    k AS (SELECT fold, commit, side, id, CAST(count(*) AS DOUBLE) AS n FROM toks JOIN v USING (token) GROUP BY ALL),
    b AS (SELECT fold, commit, {bag('p')} AS p, {bag('c')} AS c FROM k GROUP BY ALL)
    SELECT CAST(f.i AS INTEGER) AS fold, x.commit, list_transform(coalesce(p, []), lambda e: e.i) AS prev_ids, list_transform(coalesce(p, []), lambda e: e.n) AS prev_counts,
      list_transform(coalesce(c, []), lambda e: e.i) AS cur_ids, list_transform(coalesce(c, []), lambda e: e.n) AS cur_counts
    FROM pairs x CROSS JOIN range({n}) f(i) LEFT JOIN b ON b.fold = f.i AND b.commit = x.commit"""


def _sparse(vector: str) -> list:
    """Places and values of a sparse vector, by way of its JSON form."""
    parts = F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), "v struct<indices: array<int>, values: array<double>>")["v"]
    side = vector.replace("_features", "")
    return [parts["indices"].alias(f"{side}_ids"), parts["values"].alias(f"{side}_counts")]


def _register(split: str):
    suffix = "" if split == "time" else f"_{split}"

    @query(f"fold_sequences{suffix}", _sequences_sql(split))
    def _fold_sequences(spark, sf):
        pairs, parts = pair_parts(spark, sf)
        return fold_sequences(pairs, _files(pairs), parts, folds=FOLDS[split], split=split)

    @query(f"fold_bags{suffix}", _bags_sql(split))
    def _fold_bags(spark, sf):
        pairs, parts = pair_parts(spark, sf)
        bags = fold_bags(pairs, _files(pairs), parts, folds=FOLDS[split], split=split)
        return bags.select("fold", "commit", *_sparse("prev_features"), *_sparse("cur_features"))


for _split in FOLDS:
    _register(_split)


@query("fold_embeddings")
def _fold_embeddings(spark, sf):
    pairs, parts = pair_parts(spark, sf)
    out = fold_embeddings(spread(pairs), _files(pairs), parts, size=20)
    vectors = {c: vector_to_array(f"{c}_features") for c in ("prev", "cur")}
    rounded = [F.transform(v, lambda x: F.round(x, 4)).alias(f"{c}_vector") for c, v in vectors.items()]
    return out.select("fold", "commit", *rounded, F.size(vectors["cur"]).alias("width"))
