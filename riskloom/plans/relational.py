"""Sources, projections, joins and reshaping over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.labels import binarise, decode_scores, encode_label
from riskloom.functions.text import text_or_empty
from riskloom.operators.aggregates import (
    count_distinct,
    distinct_values,
    first_per_group,
    most_common,
    smallest_class,
    value_counts,
)
from riskloom.operators.joins import (
    split_join,
    inner_join,
    keep_known,
    left_join,
    left_null_safe,
    missing_from,
    pair_tasks,
    strict_lookup,
    suffix_join,
)
from riskloom.operators.reshape import (
    blank_changes,
    cast_columns,
    columns_like,
    lower_names,
    manual_features,
    match,
    match_pattern,
    parse_dates,
    pick,
    round_columns,
    settings_key,
    split_context,
    union_all,
)
from riskloom.plans.registry import query, table
from riskloom.plans.texts import PAIRS_SQL, change_pairs
from riskloom.plans.views import CHANGES_SQL, change_stream
from riskloom.session import scratch_path
from riskloom.sources.schemas import ddl
from riskloom.sources.tables import (
    append_results,
    dims_from_path,
    experiment_grid,
    feature_dims,
    read_features,
    read_many,
    read_result_files,
    read_table,
    write_csv,
    write_parquet,
)

LINE_COLUMNS = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_returnflag": "string", "l_shipdate": "timestamp",
}
LINE_SCHEMA = ddl(**LINE_COLUMNS)


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_COLUMNS)


LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem"


@query("read_table", LINE_SQL)
def _read_table(spark, sf):
    path = scratch_path(spark, "csv")
    write_csv(lines(spark, sf), path)
    return read_table(spark, path, LINE_SCHEMA)


@query(
    "read_multiline",
    "SELECT conv_id, turn, CASE WHEN text = '' THEN NULL ELSE text END AS text FROM conversations",
)
def _read_multiline(spark, sf):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf, "conversations").select("conv_id", "turn", F.nullif("text", F.lit("")).alias("text")), path)
    return read_table(spark, path, ddl(conv_id="bigint", turn="bigint", text="string"), multiline=True)


@query(
    "read_many",
    f"SELECT DISTINCT l_orderkey, l_returnflag, l_quantity FROM ({LINE_SQL}) WHERE l_orderkey IS NOT NULL",
)
def _read_many(spark, sf):
    cols = ["l_orderkey", "l_returnflag", "l_quantity"]
    some = lines(spark, sf).select(*cols)
    empty = some.filter("l_linenumber = 1").select(*[F.lit(None).cast(t).alias(c) for c, t in some.dtypes])
    paths = [scratch_path(spark, "many") for _ in range(3)]
    for part, path in zip((some.filter("l_linenumber <= 5"), some.filter("l_linenumber >= 3"), empty), paths):
        part.write.parquet(path)
    return read_many(spark, paths)


@query(
    "read_features",
    "SELECT vec_id AS commit, CAST(embedding AS DOUBLE[]) AS prev_features, label FROM embeddings",
)
def _features(spark, sf):
    path = scratch_path(spark, "features")
    e = table(spark, sf, "embeddings")
    wide = e.select(F.col("vec_id").alias("Commit"), F.col("embedding").cast("array<double>").alias("Prev_Features"), F.col("label").alias("Label"))
    write_parquet(wide, path, ["Label"])
    return read_features(spark, path)


@query(
    "append_results",
    "SELECT l_returnflag AS problem, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
)
def _append(spark, sf):
    path = scratch_path(spark, "append")
    rows = lines(spark, sf).select(F.col("l_returnflag").alias("problem"), "l_linenumber", "l_quantity")
    append_results(rows.filter("l_linenumber <= 3"), path)
    append_results(rows.filter("l_linenumber > 3"), path)
    return spark.read.parquet(path).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


PATH_PARTS = "CASE WHEN l_linenumber = 7 THEN 'skip.csv' WHEN l_linenumber % 2 = 0 THEN '_cvss2_auth_' || l_suppkey || '_results.csv' ELSE '_' || l_suppkey || '_results.csv' END"


@query(
    "dims_from_path",
    f"""WITH p AS (SELECT '/out/code_' || l_linestatus || '_word' || {PATH_PARTS} AS path FROM lineitem),
    s AS (SELECT path, string_split(string_split(path, '/')[-1], '_') AS a FROM p)
    SELECT CASE len(a) WHEN 5 THEN 'multitask' ELSE a[4] || '_' || a[5] END AS scenario, a[1] AS feature_type, a[2] AS feature_scope,
           a[3] AS token, CASE len(a) WHEN 5 THEN a[4] ELSE a[6] END AS fold, count(*) AS n
    FROM s WHERE len(a) IN (5, 7) GROUP BY ALL""",
)
def _dims(spark, sf):
    l = table(spark, sf, "lineitem")
    tail = (
        F.when(F.col("l_linenumber") == 7, "skip.csv")
        .when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("_cvss2_auth_"), "l_suppkey", F.lit("_results.csv")))
        .otherwise(F.concat(F.lit("_"), "l_suppkey", F.lit("_results.csv")))
    )
    d = l.select(dims_from_path(F.concat(F.lit("/out/code_"), "l_linestatus", F.lit("_word"), tail)).alias("d"))
    return d.filter(F.col("d").isNotNull()).groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d.*", "n")


@query(
    "feature_dims",
    """WITH p AS (SELECT CASE WHEN l_linenumber = 1 THEN 'manual_' || l_suppkey ELSE 'code_hc_bow_multiclass_' || l_suppkey END AS name FROM lineitem),
    s AS (SELECT string_split(name, '_') AS a FROM p)
    SELECT a[1] AS feature_type, CASE WHEN a[1] = 'manual' THEN a[1] ELSE a[2] END AS feature_scope,
           CASE WHEN a[1] = 'manual' THEN a[1] ELSE a[3] END AS token,
           CAST(CAST(a[len(a)] AS INTEGER) + 1 AS VARCHAR) AS "partition", count(*) AS n FROM s GROUP BY ALL""",
)
def _feature_dims(spark, sf):
    stem = F.when(F.col("l_linenumber") == 1, F.lit("manual_")).otherwise(F.lit("code_hc_bow_multiclass_"))
    name = F.concat(F.lit("in/"), stem, F.col("l_suppkey").cast("string"), F.lit(".pkl"))
    d = table(spark, sf, "lineitem").select(feature_dims(name).alias("d"))
    return d.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d.*", "n")


@query(
    "read_result_files",
    """SELECT l_orderkey AS run, l_quantity AS mcc, 'multitask' AS scenario, 'code' AS feature_type, 'hc' AS feature_scope,
    'word' AS token, CAST(l_linenumber AS VARCHAR) AS fold FROM lineitem""",
)
def _result_files(spark, sf):
    base = scratch_path(spark, "runs")
    name = F.concat(F.lit("code_hc_word_"), F.col("l_linenumber").cast("string"), F.lit("_results.csv"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_quantity").alias("mcc"), name.alias("file"))
    rows.write.partitionBy("file").csv(base, header=True)
    return read_result_files(spark, f"{base}/*", ddl(run="bigint", mcc="double"))


@query(
    "experiment_grid",
    """SELECT DISTINCT n_name AS task, f.i AS fold, s AS sampling FROM nation, range(10) f(i), (VALUES ('none'), ('over'), ('over+')) v(s)""",
)
def _grid(spark, sf):
    names = [r["n_name"] for r in table(spark, sf, "nation").select("n_name").collect()]
    grid = experiment_grid(spark, task=names, fold=list(range(10)), sampling=["none", "over", "over+"])
    return grid.withColumn("fold", F.col("fold").cast("bigint"))


@query(
    "pick_columns",
    "SELECT o_orderkey AS commit, o_orderdate AS date, o_orderpriority AS label FROM orders",
)
def _pick(spark, sf):
    upper = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "O_OrderKey")
    return pick(lower_names(upper), {"o_orderkey": "commit", "o_orderdate": "date", "o_orderpriority": "label"})


@query(
    "fill_text",
    f"WITH {PAIRS_SQL} SELECT commit, coalesce(prev_data, '') AS prev_data, coalesce(cur_data, '') AS cur_data FROM pairs",
)
def _fill(spark, sf):
    return change_pairs(spark, sf).select("commit", *[text_or_empty(c).alias(c) for c in ("prev_data", "cur_data")])


@query(
    "cast_columns",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS INTEGER) AS part,
    TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS mcc FROM orders""",
)
def _casts(spark, sf):
    o = table(spark, sf, "orders")
    part = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    mcc = F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(F.col("o_totalprice").cast("string"))
    return cast_columns(o.select("o_orderkey", part.alias("part"), mcc.alias("mcc")), {"part": "int", "mcc": "double"})


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS date, o_orderkey % 9 = 0 AS date_rejected FROM orders""",
)
def _dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 9 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return parse_dates(table(spark, sf, "orders").select("o_orderkey", text.alias("date")))


MARKED = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '-' ELSE o_orderpriority END"


def marked(spark, sf):
    cwe = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "-").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").withColumn("cwe", cwe)


@query("binarise", f"SELECT o_orderkey, CASE WHEN {MARKED} = '-' THEN 0 ELSE 1 END AS vulnerable FROM orders")
def _binarise(spark, sf):
    return marked(spark, sf).select("o_orderkey", binarise("cwe").alias("vulnerable"))


@query(
    "match_dims",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber IN (1, 3)",
)
def _match(spark, sf):
    rows = match(table(spark, sf, "lineitem"), l_returnflag="A", l_linestatus="F", l_linenumber=[1, 3])
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "match_pattern",
    "SELECT p_partkey, p_brand, p_size FROM part WHERE regexp_matches(p_brand, '#[1-3]')",
)
def _pattern(spark, sf):
    p = table(spark, sf, "part")
    kept = columns_like(p, "p_", exclude=["p_name", "p_type", "p_retailprice"])
    return match_pattern(p.select(*kept), "p_brand", "#[1-3]")


@query(
    "blank_changes",
    f"""WITH {PAIRS_SQL}, b AS (SELECT commit, CASE WHEN length(prev_data) % 3 = 0 THEN '' ELSE prev_data END AS prev_data, cur_data FROM pairs)
    SELECT commit FROM b WHERE coalesce(prev_data, '') = '' AND coalesce(cur_data, '') = ''""",
)
def _blank(spark, sf):
    p = change_pairs(spark, sf)
    prev = F.when(F.char_length("prev_data") % 3 == 0, "").otherwise(F.col("prev_data"))
    return blank_changes(p.withColumn("prev_data", prev)).select("commit")


@query(
    "split_context",
    """SELECT doc_id, CASE WHEN strpos(text, ',') > 0 THEN substring(text, 1, strpos(text, ',') - 1) ELSE text END AS data,
    CASE WHEN strpos(text, ',') > 0 THEN substring(text, strpos(text, ',') + 1) ELSE '' END AS context FROM documents""",
)
def _split(spark, sf):
    return split_context(table(spark, sf, "documents"), "text", "data", "context").select("doc_id", "data", "context")


@query(
    "settings_key",
    "SELECT l_returnflag || ',' || l_linestatus || ',' || l_linenumber AS settings, count(*) AS n FROM lineitem GROUP BY 1",
)
def _settings(spark, sf):
    key = settings_key("l_returnflag", "l_linestatus", "l_linenumber").alias("settings")
    return table(spark, sf, "lineitem").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@query(
    "round_columns",
    """WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
    SELECT o_orderkey, CAST(c // 10 + CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND (c // 10) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10 AS price FROM c""",
)
def _round(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return round_columns(o, 1)


@query("manual_features", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def _manual(spark, sf):
    return manual_features(table(spark, sf, "part"), ["p_size", "p_retailprice"], "p_partkey")


@query(
    "split_join",
    """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 1 ELSE l_suppkey END AS k FROM lineitem),
    r AS (SELECT s_suppkey AS k, s_name FROM supplier UNION ALL SELECT NULL, 'unknown')
    SELECT l_orderkey, l_linenumber, l.k, s_name FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k""",
)
def _split_join(spark, sf):
    """Lines whose supplier is NULL or the first for two thirds of the orders, with the supplier's name."""
    part = F.col("l_orderkey") % 3
    key = F.when(part == 0, None).when(part == 1, F.lit(1)).otherwise(F.col("l_suppkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.cast("bigint").alias("k"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), "s_name")
    none = spark.range(1).select(F.lit(None).cast("bigint").alias("k"), F.lit("unknown").alias("s_name"))
    return split_join(lines, names.unionByName(none), ["k"], null_safe=True)


@query(
    "left_join",
    f"WITH {CHANGES_SQL} SELECT commit, priority, s_name FROM changes LEFT JOIN supplier ON s_suppkey = id",
)
def _left(spark, sf):
    adv = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return left_join(change_stream(spark, sf), adv, ["id"]).select("commit", "priority", "s_name")


@query(
    "advisory_join",
    "SELECT c_custkey AS id, o_orderkey AS commit, c_acctbal AS base_score FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
)
def _advisory(spark, sf):
    commits = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("commit"))
    adv = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("base_score"))
    return left_join(adv, commits, ["id"]).select("id", "commit", "base_score")


NULLED_SQL = """a AS (SELECT o_orderkey AS commit, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS id FROM orders),
b AS (SELECT CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS id, count(*) AS n FROM orders GROUP BY 1)"""


@query("left_null_safe", f"WITH {NULLED_SQL} SELECT a.commit, a.id, b.n FROM a LEFT JOIN b ON a.id IS NOT DISTINCT FROM b.id")
def _null_safe(spark, sf):
    id_ = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("id")
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit"), id_)
    b = a.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return left_null_safe(a, b, ["id"]).select("commit", "id", "n")


@query("inner_join", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _inner(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return inner_join(d, table(spark, sf, "labels"), ["doc_id"])


@query("strict_lookup", "SELECT l.doc_id, l.quality, d.n_chars FROM labels l LEFT JOIN documents d USING (doc_id)")
def _strict(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return strict_lookup(table(spark, sf, "labels").select("doc_id", "quality"), d, "doc_id")


@query("keep_known", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _known(spark, sf):
    return keep_known(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("anti_missing", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _missing(spark, sf):
    return missing_from(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


def _per_segment(spark, sf, column, flag):
    l = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag)
    return l.groupBy("l_suppkey").agg(F.sum(column).alias("value"), F.count(F.lit(1)).alias("n"))


@query(
    "suffix_join",
    """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS value, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    r AS (SELECT l_suppkey, sum(l_quantity) AS value, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT l_suppkey, a.value AS value_ml, a.n AS n_ml, r.value AS value_dl, r.n AS n_dl FROM a RIGHT JOIN r USING (l_suppkey)""",
)
def _suffix(spark, sf):
    a, r = (_per_segment(spark, sf, "l_quantity", f) for f in "AR")
    return suffix_join(a, r, ["l_suppkey"], "right", ("_ml", "_dl"))


@query(
    "pair_tasks",
    """WITH t AS (SELECT l_linestatus AS task, l_suppkey, l_linenumber, sum(l_quantity) AS mcc FROM lineitem GROUP BY ALL)
    SELECT a.task, a.l_suppkey, a.l_linenumber, a.mcc, b.mcc AS mcc_other
    FROM t a JOIN t b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber AND a.task <> b.task""",
)
def _pair(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("task"), "l_suppkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("mcc")
    )
    return pair_tasks(t, "task", ["l_suppkey", "l_linenumber"], ["mcc"])


@query(
    "union_all",
    "SELECT o_orderkey AS key, 'order' AS kind, o_totalprice AS price FROM orders UNION ALL SELECT p_partkey, 'part', NULL FROM part",
)
def _union(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("price"))
    return union_all(o, table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.lit("part").alias("kind")))


@query("value_counts", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _counts(spark, sf):
    return value_counts(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query(
    "most_common",
    """SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""",
)
def _common(spark, sf):
    return most_common(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query(
    "smallest_class",
    """SELECT o_orderstatus, min(n) AS smallest, max(n) AS largest, count(*) AS classes
    FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""",
)
def _smallest(spark, sf):
    return smallest_class(table(spark, sf, "orders"), "o_orderpriority", ["o_orderstatus"])


@query("distinct_values", "SELECT DISTINCT o_orderdate FROM orders")
def _distinct(spark, sf):
    return distinct_values(table(spark, sf, "orders"), "o_orderdate")


@query("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1")
def _count_distinct(spark, sf):
    return count_distinct(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus"])


@query(
    "first_per_group",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def _first(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return first_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "top_tokens",
    "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20",
)
def _top(spark, sf):
    return value_counts(table(spark, sf, "part"), [], "p_type").orderBy(F.desc("n"), "p_type").limit(20)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "label_decode",
    """WITH s AS (SELECT o_orderkey, list_transform(range(5), lambda i: CAST((o_custkey * (i + 3) + o_orderkey) % 7 AS DOUBLE)) AS s,
        (o_custkey % 9) / 8.0::DOUBLE AS p, o_orderpriority FROM orders)
    SELECT o_orderkey, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][list_position(s, list_max(s))] AS many,
           CASE WHEN p > 0.5 THEN 'yes' ELSE 'no' END AS two, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1 AS code FROM s""",
)
def _decode(spark, sf):
    o = table(spark, sf, "orders")
    scores = F.array(*[((F.col("o_custkey") * (i + 3) + F.col("o_orderkey")) % 7).cast("double") for i in range(5)])
    s = o.select("o_orderkey", "o_orderpriority", scores.alias("s"), F.array((F.col("o_custkey") % 9) / 8.0).alias("p"))
    return s.select(
        "o_orderkey",
        decode_scores("s", PRIORITIES).alias("many"),
        decode_scores("p", ["no", "yes"]).alias("two"),
        encode_label("o_orderpriority", PRIORITIES).alias("code"),
    )
