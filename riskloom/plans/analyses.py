"""Queries over experiment results, comparisons of runs, scores and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.tails import erfc_sql, normal_tail_sql
from riskloom.functions.cvss import TASKS, base_score, cvss_error, severity_band, vector_parts
from riskloom.operators.aggregates import spread, worst_per_group
from riskloom.operators.compare import cohen_d, compare_runs, mann_whitney, wilcoxon
from riskloom.operators.metrics import (
    METRICS,
    auc_macro,
    auc_ovr,
    overall_scores,
    score,
    score_tasks,
    wide_report,
)
from riskloom.operators.ranks import average_ranks, keyed_position
from riskloom.operators.reshape import align, melt_results, unpivot_results
from riskloom.operators.results import (
    average_folds,
    best_iteration,
    best_parameters,
    compare_vector,
    optimal_classifiers,
    transfer_folds,
    transfer_table,
    umbrella_levels,
)
from riskloom.plans.forecast import metrics_sql, rounded
from riskloom.plans.registry import query, table
from riskloom.session import materialise
from riskloom.sources.logs import log_rejects, log_times

# --- experiment results -------------------------------------------------------------------------

RESULTS_SQL = """results AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'binary' WHEN 'N' THEN 'multiclass' ELSE 'cvss2_conf' END AS problem,
    CASE WHEN l_linenumber = 7 THEN 'holdout' ELSE CAST(l_linenumber AS VARCHAR) END AS "partition",
    CASE l_linestatus WHEN 'F' THEN 'code' ELSE 'ast' END AS feature_type,
    ['hunk', 'ss', 'hc'][l_suppkey % 3 + 1] AS feature_scope,
    ['bow', 'w2v'][l_suppkey % 2 + 1] AS token,
    ['lr', 'svm', 'rf'][l_partkey % 3 + 1] AS classifier,
    'p' || (l_partkey % 4) AS parameters,
    ['none', 'over', 'over+_1', 'over+_5'][l_orderkey % 4 + 1] AS resampling,
    CAST(count(*) % 100 AS DOUBLE) AS accuracy,
    CAST(sum(CAST(l_quantity AS BIGINT)) % 997 AS DOUBLE) AS f1,
    CASE WHEN sum(CAST(l_quantity AS BIGINT)) % 23 = 0 THEN CAST('NaN' AS DOUBLE)
         ELSE CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 1000 AS DOUBLE) END AS mcc
  FROM lineitem GROUP BY ALL)"""


def results(spark, sf):
    """Line items as validation results; measures are whole numbers held as DOUBLE."""

    def choice(values, column):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))

    dims = {
        "problem": F.when(F.col("l_returnflag") == "A", "binary").when(F.col("l_returnflag") == "N", "multiclass").otherwise("cvss2_conf"),
        "partition": F.when(F.col("l_linenumber") == 7, "holdout").otherwise(F.col("l_linenumber").cast("string")),
        "feature_type": F.when(F.col("l_linestatus") == "F", "code").otherwise("ast"),
        "feature_scope": choice(["hunk", "ss", "hc"], "l_suppkey"),
        "token": choice(["bow", "w2v"], "l_suppkey"),
        "classifier": choice(["lr", "svm", "rf"], "l_partkey"),
        "parameters": F.concat(F.lit("p"), (F.col("l_partkey") % 4).cast("string")),
        "resampling": choice(["none", "over", "over+_1", "over+_5"], "l_orderkey"),
    }
    quantity = F.sum(F.col("l_quantity").cast("bigint"))
    return (
        table(spark, sf, "lineitem")
        .groupBy(*[c.alias(n) for n, c in dims.items()])
        .agg(
            (F.count(F.lit(1)) % 100).cast("double").alias("accuracy"),
            (quantity % 997).cast("double").alias("f1"),
            F.when(quantity % 23 == 0, F.lit(float("nan")))
            .otherwise((F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) % 1000).cast("double"))
            .alias("mcc"),
        )
    )


MEASURES = ["accuracy", "f1", "mcc"]
MEANS_SQL = ", ".join(f"avg({m}) FILTER (NOT isnan({m})) AS {m}" for m in MEASURES)
LEVELS_SQL = """levels AS (SELECT * FROM results UNION ALL
  SELECT * REPLACE ('over+' AS resampling) FROM results WHERE starts_with(resampling, 'over+_'))"""


@query(
    "average_folds",
    f"""WITH {RESULTS_SQL}, {LEVELS_SQL}
    SELECT problem, feature_type, feature_scope, token, resampling, classifier, avg(TRY_CAST("partition" AS DOUBLE)) AS "partition", {MEANS_SQL}
    FROM levels WHERE "partition" <> 'holdout' GROUP BY ALL""",
)
def _average(spark, sf):
    return average_folds(results(spark, sf), MEASURES)


@query(
    "umbrella_levels",
    f"""WITH {RESULTS_SQL},
    own AS (SELECT problem, classifier, resampling, round(avg(mcc) FILTER (NOT isnan(mcc)), 8) AS mcc, count(*) AS n,
                   grouping(problem) AS gp, grouping(classifier) AS gc
            FROM results GROUP BY GROUPING SETS ((problem, classifier, resampling), (problem, resampling), (classifier, resampling), (resampling))),
    any_k AS (SELECT problem, classifier, 'over+' AS resampling, round(avg(mcc) FILTER (NOT isnan(mcc)), 8) AS mcc, count(*) AS n,
                     grouping(problem) AS gp, grouping(classifier) AS gc
              FROM results WHERE starts_with(resampling, 'over+_') GROUP BY CUBE (problem, classifier)),
    whole AS (SELECT problem, classifier, 'all' AS resampling, round(avg(mcc) FILTER (NOT isnan(mcc)), 8) AS mcc, count(*) AS n,
                     grouping(problem) AS gp, grouping(classifier) AS gc
              FROM results GROUP BY CUBE (problem, classifier))
    SELECT CASE WHEN gp = 1 THEN 'overall' ELSE problem END AS problem, CASE WHEN gc = 1 THEN 'all' ELSE classifier END AS classifier,
           resampling, mcc, n
    FROM (SELECT * FROM own UNION ALL SELECT * FROM any_k UNION ALL SELECT * FROM whole)""",
)
def _umbrella(spark, sf):
    return rounded(umbrella_levels(results(spark, sf)))


ALL_DIMS = "problem, feature_type, feature_scope, token, classifier, resampling"


@query(
    "best_per_group",
    f"""WITH {RESULTS_SQL} SELECT * FROM results WHERE NOT isnan(mcc)
    QUALIFY row_number() OVER (PARTITION BY {ALL_DIMS}, "partition" ORDER BY mcc DESC, parameters) = 1""",
)
def _best(spark, sf):
    return best_parameters(results(spark, sf), ["partition", *ALL_DIMS.split(", ")])


@query(
    "worst_per_group",
    f"""WITH {RESULTS_SQL} SELECT * FROM results WHERE NOT isnan(mcc)
    QUALIFY row_number() OVER (PARTITION BY problem, classifier ORDER BY mcc, feature_type, feature_scope, token, parameters, resampling, "partition") = 1""",
)
def _worst(spark, sf):
    ties = ["feature_type", "feature_scope", "token", "parameters", "resampling", "partition"]
    return worst_per_group(results(spark, sf), ["problem", "classifier"], ties)


@query(
    "best_iteration",
    """SELECT l_orderkey AS run, l_linenumber AS epoch, l_discount AS val_mcc, l_suppkey FROM (
      SELECT l_orderkey, l_linenumber, l_discount, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) = 1""",
)
def _iteration(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("val_mcc")
    ).agg(F.max("l_suppkey").alias("l_suppkey"))
    return best_iteration(h, ["run"], "val_mcc", "epoch")


@query(
    "spread",
    f"""WITH {RESULTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY problem, classifier ORDER BY mcc DESC, feature_type, feature_scope, token, parameters, resampling, "partition") AS hi,
      row_number() OVER (PARTITION BY problem, classifier ORDER BY mcc, feature_type, feature_scope, token, parameters, resampling, "partition") AS lo
      FROM results WHERE NOT isnan(mcc))
    SELECT problem, classifier, max(mcc) FILTER (hi = 1) - max(mcc) FILTER (lo = 1) AS mcc_spread, max(f1) FILTER (hi = 1) - max(f1) FILTER (lo = 1) AS f1_spread
    FROM r GROUP BY ALL""",
)
def _spread(spark, sf):
    ties = ["feature_type", "feature_scope", "token", "parameters", "resampling", "partition"]
    return spread(results(spark, sf), ["problem", "classifier"], ties)


def _transfer_sql() -> str:
    pick = "QUALIFY row_number() OVER (PARTITION BY feature_type, feature_scope, token, grp ORDER BY mcc {d}, classifier, parameters) = 1"
    ends = ",\n".join(
        f"{tag}_{end} AS (SELECT * FROM g WHERE problem = '{prob}' AND NOT isnan(mcc) {pick.format(d=d)})"
        for tag, prob in (("s", "binary"), ("t", "multiclass"))
        for end, d in (("hi", "DESC"), ("lo", "ASC"))
    )
    use = "USING (feature_type, feature_scope, token, grp)"
    return f"""WITH {RESULTS_SQL},
    m AS (SELECT problem, feature_type, feature_scope, token, classifier, parameters, avg(CAST("partition" AS DOUBLE)) AS "partition", {MEANS_SQL}
          FROM results WHERE "partition" <> 'holdout' GROUP BY ALL),
    g AS (SELECT *, classifier AS grp FROM m UNION ALL SELECT *, 'all' AS grp FROM m),
    {ends}
    SELECT x.problem, x.feature_type, x.feature_scope, x.token,
      CASE WHEN x.grp = 'all' THEN 'all_(' || x.classifier || ')' ELSE x.classifier END AS classifier, x.parameters, round(x."partition", 8) AS "partition",
      round(x.accuracy, 8) AS accuracy, round(x.f1, 8) AS f1, round(x.mcc, 8) AS mcc,
      round(x.f1 - t_hi.f1, 8) AS f1_difference, round(x.mcc - t_hi.mcc, 8) AS mcc_difference,
      round(t_hi.mcc - t_lo.mcc, 8) AS multiclass_mcc_spread, round(t_hi.f1 - t_lo.f1, 8) AS multiclass_f1_spread,
      round(s_hi.mcc - s_lo.mcc, 8) AS binary_mcc_spread, round(s_hi.f1 - s_lo.f1, 8) AS binary_f1_spread
    FROM s_hi JOIN s_lo {use} JOIN t_hi {use} JOIN t_lo {use}
    JOIN g x ON x.problem = 'multiclass' AND x.feature_type = s_hi.feature_type AND x.feature_scope = s_hi.feature_scope
      AND x.token = s_hi.token AND x.grp = s_hi.grp AND x.classifier = s_hi.classifier AND x.parameters = s_hi.parameters"""


@query("transfer_folds", _transfer_sql())
def _transfer(spark, sf):
    return rounded(transfer_folds(results(spark, sf), MEASURES))


# A wide report: one row per task and feature set, one text column per classifier.
FAMILIES = {"ml": ["LR", "SVM"], "dl": None}
WIDE_COLUMNS = {"LR": 0, "SVM": 1, "CNN": 2, "RNN": 3}
WIDE_SQL = (
    """wide AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'Binary' ELSE 'Multiclass' END AS task,
  'F' || (l_suppkey % 10) AS feature_type, 'S' || l_linenumber AS feature_scope, l_linestatus AS token, """
    + ", ".join(
        f"coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_partkey % 5 = {i}) AS VARCHAR), '-') AS \"{c}\""
        for c, i in WIDE_COLUMNS.items()
    )
    + ", '0' AS \"best DL\" FROM lineitem GROUP BY ALL)"
)
LONG_SQL = f"""long AS (SELECT task, feature_type, feature_scope, token, classifier, CAST(mcc AS DOUBLE) AS mcc
  FROM (UNPIVOT (SELECT * EXCLUDE ("best DL") FROM wide) ON {', '.join(f'"{c}"' for c in WIDE_COLUMNS)} INTO NAME classifier VALUE mcc)
  WHERE mcc <> '-')"""
FAMILY_SQL = """fam AS (SELECT *, 'all' AS family FROM long UNION ALL
  SELECT *, CASE WHEN classifier IN ('LR', 'SVM') THEN 'ml' ELSE 'dl' END FROM long)"""
IDS = ["task", "feature_type", "feature_scope", "token"]


def wide_results(spark, sf):
    l = table(spark, sf, "lineitem")
    cells = [
        F.coalesce(F.sum(F.when(F.col("l_partkey") % 5 == i, F.col("l_quantity").cast("bigint"))).cast("string"), F.lit("-")).alias(c)
        for c, i in WIDE_COLUMNS.items()
    ]
    return l.groupBy(
        F.when(F.col("l_returnflag") == "A", "Binary").otherwise("Multiclass").alias("task"),
        F.concat(F.lit("F"), (F.col("l_suppkey") % 10).cast("string")).alias("feature_type"),
        F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("feature_scope"),
        F.col("l_linestatus").alias("token"),
    ).agg(*cells, F.lit("0").alias("best DL"))


@query("melt_results", f"WITH {WIDE_SQL}, {LONG_SQL} SELECT * FROM long")
def _melt(spark, sf):
    return melt_results(wide_results(spark, sf), IDS)


@query(
    "optimal_classifiers",
    f"""WITH {WIDE_SQL}, {LONG_SQL}, {FAMILY_SQL},
    best AS (SELECT * FROM fam QUALIFY row_number() OVER (PARTITION BY task, feature_type, feature_scope, token, family ORDER BY mcc DESC, classifier) = 1),
    m AS (SELECT task, feature_type, feature_scope, token, """
    + ", ".join(f"max(classifier) FILTER (family = '{f}') AS classifier_{f}, max(mcc) FILTER (family = '{f}') AS mcc_{f}" for f in ("ml", "dl", "all"))
    + " FROM best GROUP BY ALL) SELECT a.*, "
    + ", ".join(f"CASE WHEN a.classifier_{f} = b.classifier_{f} THEN 'Yes' ELSE 'No' END AS {f}_same" for f in ("ml", "dl", "all"))
    + " FROM m a LEFT JOIN m b ON a.task <> b.task AND (a.feature_type, a.feature_scope, a.token) IS NOT DISTINCT FROM (b.feature_type, b.feature_scope, b.token)",
)
def _optimal(spark, sf):
    return optimal_classifiers(wide_results(spark, sf), IDS, FAMILIES)


@query(
    "transfer_table",
    f"""WITH {WIDE_SQL}, {LONG_SQL}, {FAMILY_SQL},
    b AS (SELECT * FROM fam WHERE task = 'Binary' QUALIFY row_number() OVER (PARTITION BY feature_type, feature_scope, token, family ORDER BY mcc DESC, classifier) = 1),
    t AS (SELECT feature_type, feature_scope, token, family, max(mcc) AS max_mcc FROM fam WHERE task = 'Multiclass' GROUP BY ALL)
    SELECT t.*, b.classifier, f.mcc AS transfer_mcc FROM t LEFT JOIN b USING (feature_type, feature_scope, token, family)
    LEFT JOIN fam f ON f.task = 'Multiclass' AND f.feature_type = t.feature_type AND f.feature_scope = t.feature_scope AND f.token = t.token
      AND f.family = t.family AND f.classifier = b.classifier""",
)
def _transfer_table(spark, sf):
    return transfer_table(wide_results(spark, sf), ids=IDS, families=FAMILIES)


SHORT = ["acc", "prec", "rec", "f1", "gmean", "mcc"]
WIDE_TASKS = ["cvss2_conf", "cvss2_auth"]


def _cell(t: int, m: int) -> str:
    return f"CAST(sum((l_partkey + {t}) * (l_suppkey + {m})) % 1000 AS DOUBLE)"


OVERALL = ["accuracy", "precision", "recall", "f1-score", "gmean", "mcc"]


def _unpivot_sql() -> str:
    ids = "SELECT l_linenumber AS run, l_linestatus AS set, l_returnflag AS fold, '{s}' AS scenario, CAST(count(*) AS DOUBLE) AS pred_time, {cells} FROM lineitem GROUP BY ALL"
    parts = []
    for t, s in enumerate(["multitask", *WIDE_TASKS]):
        parts.append(ids.format(s=s, cells=", ".join(f"{_cell(t, i)} AS {m}" for i, m in enumerate(SHORT))))
    return " UNION ALL ".join(parts).replace(" AS set,", ' AS "set",')


def wide_runs(spark, sf):
    def cell(t, m, name):
        return (F.sum((F.col("l_partkey") + t) * (F.col("l_suppkey") + m)) % 1000).cast("double").alias(name)

    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_linenumber").alias("run"), F.col("l_linestatus").alias("set"), F.col("l_returnflag").alias("fold"))
        .agg(
            *[cell(0, i, m) for i, m in enumerate(OVERALL)],
            F.count(F.lit(1)).cast("double").alias("pred_time"),
            *[cell(t + 1, i, f"{s}_{m}") for t, s in enumerate(WIDE_TASKS) for i, m in enumerate(SHORT)],
        )
    )


@query("unpivot_results", _unpivot_sql())
def _unpivot(spark, sf):
    return unpivot_results(wide_runs(spark, sf))


@query(
    "scenario_means",
    f"SELECT scenario, round(avg(pred_time), 8) AS pred_time, {', '.join(f'round(avg({m}), 8) AS {m}' for m in SHORT)} FROM ({_unpivot_sql()}) GROUP BY 1",
)
def _scenario_means(spark, sf):
    return rounded(unpivot_results(wide_runs(spark, sf), average=True))


# --- metrics over label pairs -------------------------------------------------------------------

# Label scales coded in the order key, three values each, in the order of the vector.
CODES = {
    "cvss2_accessvect": ("AV", "LAN", ["LOCAL", "ADJACENT_NETWORK", "NETWORK"]),
    "cvss2_accesscomp": ("AC", "HML", ["HIGH", "MEDIUM", "LOW"]),
    "cvss2_auth": ("Au", "MSN", ["MULTIPLE", "SINGLE", "NONE"]),
    "cvss2_conf": ("C", "NPC", ["NONE", "PARTIAL", "COMPLETE"]),
    "cvss2_integrity": ("I", "NPC", ["NONE", "PARTIAL", "COMPLETE"]),
    "cvss2_avail": ("A", "NPC", ["NONE", "PARTIAL", "COMPLETE"]),
}


def _vector_sql(key: str) -> str:
    return " || '/' || ".join(
        f"'{code}:' || substring('{letters}', CAST({key} // {3**i} % 3 + 1 AS INTEGER), 1)"
        for i, (code, letters, _) in enumerate(CODES.values())
    )


def _vector(key: str):
    return F.concat_ws(
        "/",
        *[
            F.concat(F.lit(f"{code}:"), F.substring(F.lit(letters), (F.floor(F.col(key) / 3**i) % 3 + 1).cast("int"), F.lit(1)))
            for i, (code, letters, _) in enumerate(CODES.values())
        ],
    )


def key_pairs(spark, sf):
    """Each order with the customer's previous order (by date, key); found by place, not by lag."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    placed = keyed_position(o, ["o_orderdate", "o_orderkey"], ["o_custkey"], "at")
    before = placed.select(
        "o_custkey", (F.col("at") + 1).alias("at"), F.col("o_orderkey").alias("prev_key"), F.col("o_orderpriority").alias("prev_priority")
    )
    return placed.join(before, ["o_custkey", "at"])


KEY_PAIRS_SQL = """key_pairs AS (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, o_custkey,
    lag(o_orderkey) OVER w AS prev_key, lag(o_orderpriority) OVER w AS prev_priority
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY prev_key IS NOT NULL)"""
LEVEL_SQL = "CASE {c} WHEN '5-LOW' THEN 'LOW' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '4-NOT SPECIFIED' THEN '-' ELSE 'HIGH' END"
ORDINAL_SQL = (
    KEY_PAIRS_SQL
    + f""",
ordinal AS (SELECT o_orderstatus AS status, {LEVEL_SQL.format(c='o_orderpriority')} AS truth, {LEVEL_SQL.format(c='prev_priority')} AS pred FROM key_pairs)"""
)


def ordinal_pairs(spark, sf):
    def level(c):
        return (
            F.when(F.col(c) == "5-LOW", "LOW").when(F.col(c) == "3-MEDIUM", "MEDIUM").when(F.col(c) == "4-NOT SPECIFIED", "-").otherwise("HIGH")
        )

    return key_pairs(spark, sf).select(
        F.col("o_orderstatus").alias("status"), level("o_orderpriority").alias("truth"), level("prev_priority").alias("pred")
    )


def _scores_sql(average: str) -> str:
    return f"""WITH {ORDINAL_SQL}, {metrics_sql('ordinal', 'status', average)}
    SELECT status, round(accuracy, 8) AS accuracy, round("precision", 8) AS "precision", round(recall, 8) AS recall,
    round(f1, 8) AS f1, round(sqrt("precision" * recall), 8) AS gmean, round(mcc, 8) AS mcc FROM scored"""


@query("confusion_metrics", _scores_sql("macro"))
def _confusion(spark, sf):
    return rounded(score(ordinal_pairs(spark, sf), ["status"]))


@query("weighted_metrics", _scores_sql("weighted"))
def _weighted(spark, sf):
    return rounded(score(ordinal_pairs(spark, sf), ["status"], average="weighted"))


@query("micro_metrics", _scores_sql("micro"))
def _micro(spark, sf):
    return rounded(score(ordinal_pairs(spark, sf), ["status"], average="micro"))


@query(
    "binary_metrics",
    f"""WITH {ORDINAL_SQL}, two AS (SELECT status, CASE WHEN truth = '-' THEN '0' ELSE '1' END AS truth, CASE WHEN pred = '-' THEN '0' ELSE '1' END AS pred FROM ordinal),
    {metrics_sql('two', 'status', 'binary')}
    SELECT status, round(accuracy, 8) AS accuracy, round("precision", 8) AS "precision", round(recall, 8) AS recall,
    round(f1, 8) AS f1, round(sqrt("precision" * recall), 8) AS gmean, round(mcc, 8) AS mcc FROM scored""",
)
def _binary(spark, sf):
    two = ordinal_pairs(spark, sf).select(
        "status", *[F.when(F.col(c) == "-", 0).otherwise(1).alias(c) for c in ("truth", "pred")]
    )
    return rounded(score(two, ["status"], average="binary"))


def task_labels(spark, sf):
    """One column pair per task: labels coded in an order's key and in the previous order's key."""

    def words(key):
        out = {}
        for i, (task, (_, _, names)) in enumerate(CODES.items()):
            place = (F.floor(F.col(key) / 3**i) % 3 + 1).cast("int")
            out[task] = F.element_at(F.array(*[F.lit(n) for n in names]), place)
        band = severity_band(base_score(_vector(key)))
        out["cvss2_severity"] = F.when(F.col(key) % 11 == 0, "-").otherwise(band)
        return out

    p = key_pairs(spark, sf)
    return p.select(
        F.col("o_orderkey").alias("commit"),
        F.col("o_orderstatus").alias("run"),
        *[c.alias(t) for t, c in words("o_orderkey").items()],
        *[c.alias(f"{t}_pred") for t, c in words("prev_key").items()],
    )


def _score_sql(key: str) -> str:
    """Base score of the vector coded in a key, with decimal arithmetic."""
    w = {
        "av": ["0.395", "0.646", "1.000"], "ac": ["0.350", "0.610", "0.710"], "au": ["0.450", "0.560", "0.704"],
        "c": ["0.000", "0.275", "0.660"], "i": ["0.000", "0.275", "0.660"], "a": ["0.000", "0.275", "0.660"],
    }

    def weight(i: int, name: str) -> str:
        a, b, c = w[name]
        return f"(CASE {key} // {3**i} % 3 WHEN 0 THEN {a}::DECIMAL(4,3) WHEN 1 THEN {b}::DECIMAL(4,3) ELSE {c}::DECIMAL(4,3) END)"

    av, ac, au, c, i, a = (weight(n, name) for n, name in enumerate(w))
    impact = f"(10.41 * (1 - (1 - {c}) * (1 - {i}) * (1 - {a})))"
    return (
        f"CAST(round((0.6 * {impact} + 0.4 * (20 * {av} * {ac} * {au}) - 1.5) * "
        f"(CASE WHEN {impact} = 0 THEN 0.000 ELSE 1.176 END), 1) AS DOUBLE)"
    )


def _band_sql(score_sql: str) -> str:
    return f"CASE WHEN {score_sql} < 4 THEN 'LOW' WHEN {score_sql} < 7 THEN 'MEDIUM' WHEN {score_sql} <= 10 THEN 'HIGH' ELSE 'UNKNOWN' END"


def _task_labels_sql() -> str:
    cols = []
    for key, tail in (("o_orderkey", ""), ("prev_key", "_pred")):
        for i, (task, (_, _, names)) in enumerate(CODES.items()):
            cols.append(f"{names!r}[CAST({key} // {3**i} % 3 + 1 AS INTEGER)] AS {task}{tail}")
        cols.append(f"CASE WHEN {key} % 11 = 0 THEN '-' ELSE {_band_sql('s' + tail)} END AS cvss2_severity{tail}")
    return (
        KEY_PAIRS_SQL
        + f""",
scored_pairs AS (SELECT *, {_score_sql('o_orderkey')} AS s, {_score_sql('prev_key')} AS s_pred FROM key_pairs),
task_labels AS (SELECT o_orderkey AS commit, o_orderstatus AS run, {', '.join(cols)} FROM scored_pairs)"""
    )


def _task_pairs_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT run, '{t}' AS task, {t} AS truth, {t}_pred AS pred FROM task_labels" for t in TASKS
    )
    return f"WITH {_task_labels_sql()}, pairs AS ({rows}), {metrics_sql('pairs', 'run, task')}"


SCORED_COLUMNS = """round(accuracy, 8) AS accuracy, round("precision", 8) AS "precision", round(recall, 8) AS recall,
    round(f1, 8) AS f1, round(sqrt("precision" * recall), 8) AS gmean, round(mcc, 8) AS mcc"""


@query("macro_by_task", f"{_task_pairs_sql()} SELECT run, task, {SCORED_COLUMNS} FROM scored")
def _macro(spark, sf):
    return rounded(score_tasks(task_labels(spark, sf), TASKS, ["run"]))


@query(
    "overall_scores",
    f"""{_task_pairs_sql()} SELECT run, round(avg(accuracy), 8) AS accuracy, round(avg("precision"), 8) AS "precision",
    round(avg(recall), 8) AS recall, round(avg(f1), 8) AS f1, round(avg(sqrt("precision" * recall)), 8) AS gmean, round(avg(mcc), 8) AS mcc
    FROM scored GROUP BY run""",
)
def _overall(spark, sf):
    return rounded(overall_scores(score_tasks(task_labels(spark, sf), TASKS, ["run"]), ["run"]))


@query(
    "wide_report",
    f"""{_task_pairs_sql()}, s AS (SELECT run, task, {SCORED_COLUMNS} FROM scored)
    SELECT run, """
    + ", ".join(f'round(avg("{m}"), 8) AS "{"f1-score" if m == "f1" else m}"' for m in METRICS)
    + ", "
    + ", ".join(
        f"max(\"{m}\") FILTER (task = '{t}') AS {t}_{dict(zip(METRICS, ['acc', 'prec', 'rec', 'f1', 'gmean', 'mcc']))[m]}"
        for t in TASKS
        for m in METRICS
    )
    + " FROM s GROUP BY run",
)
def _wide_report(spark, sf):
    scores = rounded(score_tasks(task_labels(spark, sf), TASKS, ["run"]))
    return rounded(wide_report(scores, TASKS, ["run"]))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
AUC_SQL = """long AS (SELECT user_id % 4 AS grp, c AS class, CASE WHEN event_type = c THEN 1 ELSE 0 END AS positive,
  CAST((event_id * (i + 1)) % 17 + CASE WHEN event_type = c THEN i ELSE 0 END AS DOUBLE) AS score
  FROM events, (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) v(c, i)),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY grp, class, score) - 1) / 2.0 AS rk FROM long
      WINDOW w AS (PARTITION BY grp, class ORDER BY score)),
auc AS (SELECT grp, class, (sum(rk) FILTER (positive = 1) - sum(positive) * (sum(positive) + 1) / 2.0)
               / (sum(positive) * (count(*) - sum(positive))) AS auc FROM r GROUP BY ALL)"""


def class_scores_long(spark, sf):
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.when(F.col("event_type") == c, 1).otherwise(0).alias("positive"),
                ((F.col("event_id") * (i + 1)) % 17 + F.when(F.col("event_type") == c, i).otherwise(0)).cast("double").alias("score"),
            )
            for i, c in enumerate(EVENT_TYPES)
        ]
    )
    return table(spark, sf, "events").select((F.col("user_id") % 4).alias("grp"), F.inline(cells))


@query("auc_ovr", f"WITH {AUC_SQL} SELECT grp, class, round(auc, 8) AS auc FROM auc")
def _auc(spark, sf):
    return rounded(auc_ovr(class_scores_long(spark, sf), ["grp"], "class", "positive", "score").drop("defined"))


@query("auc_macro", f"WITH {AUC_SQL} SELECT grp, round(avg(auc), 8) AS auc FROM auc GROUP BY grp")
def _auc_macro(spark, sf):
    per_class = auc_ovr(class_scores_long(spark, sf), ["grp"], "class", "positive", "score")
    return rounded(auc_macro(per_class, ["grp"]))


# --- comparing runs -----------------------------------------------------------------------------

RUNS_SQL = """runs AS (SELECT event_type AS scenario, event_id, CASE WHEN user_id % 5 < 2 THEN 'A' ELSE 'B' END AS side,
  CAST(round(value) AS DOUBLE) AS value FROM events)"""


def runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("scenario"), "event_id",
        F.when(F.col("user_id") % 5 < 2, "A").otherwise("B").alias("side"),
        F.round("value").alias("value"),
    )


@query(
    "average_ranks",
    f"""WITH {RUNS_SQL} SELECT scenario, value, sum(CASE WHEN side = 'A' THEN 1 ELSE 0 END)::BIGINT AS n, count(*) AS ties, min(rk) AS rank
    FROM (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY value) + (count(*) OVER (PARTITION BY scenario, value) - 1) / 2.0 AS rk FROM runs)
    GROUP BY scenario, value""",
)
def _ranks(spark, sf):
    a = F.when(F.col("side") == "A", 1).otherwise(0).cast("bigint")
    work = runs(spark, sf).withColumns({"n": a, "m": 1 - a})
    return average_ranks(work, "value", ["n", "m"], ["scenario"]).drop("m")


def _mw_sql(source: str, keys: str) -> str:
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS rk FROM {source}),
tie AS (SELECT {keys}, sum(CAST(t AS DOUBLE) ** 3 - t) AS tie_sum FROM (SELECT {keys}, value, count(*) AS t FROM {source} GROUP BY ALL) GROUP BY {keys}),
u0 AS (SELECT {keys}, CAST(count(*) FILTER (side = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (side = 'B') AS DOUBLE) AS b,
  sum(rk) FILTER (side = 'A') AS ra, avg(value) FILTER (side = 'A') AS mean_a, avg(value) FILTER (side = 'B') AS mean_b FROM rk GROUP BY {keys}),
u1 AS (SELECT *, ra - a * (a + 1) / 2 AS u, CASE WHEN mean_a < mean_b THEN 'greater' ELSE 'less' END AS alternative,
  sqrt(a * b / 12 * ((a + b + 1) - tie_sum / ((a + b) * (a + b - 1)))) AS s FROM u0 JOIN tie USING ({keys})),
mw AS (SELECT {keys}, CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b, mean_a, mean_b, alternative, u,
  ((CASE alternative WHEN 'greater' THEN u ELSE a * b - u END) - a * b / 2 - 0.5) / s AS z FROM u1)"""


@query(
    "mann_whitney",
    f"""WITH {RUNS_SQL}, {_mw_sql('runs', 'scenario')}
    SELECT scenario, n_a, n_b, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, alternative, round(u, 8) AS u, round(z, 8) AS z, round({normal_tail_sql('z')}, 8) AS p FROM mw""",
)
def _mw(spark, sf):
    return rounded(mann_whitney(runs(spark, sf), ["scenario"]))


@query(
    "rank_sum_exact",
    """WITH RECURSIVE s AS (SELECT s_nationkey AS nation, s_acctbal AS value, s_suppkey % 2 = 0 AS a FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY value) AS rk FROM s),
    g AS (SELECT nation, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, coalesce(sum(rk) FILTER (a), 0) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2 AS u FROM r GROUP BY 1),
    ways(n_a, n_b, i, k, total, n) AS (
      SELECT DISTINCT n_a, n_b, 0, 0, 0, CAST(1 AS DOUBLE) FROM g WHERE least(n_a, n_b) > 0
      UNION ALL SELECT n_a, n_b, i + 1, k + x, total + x * (i + 1), sum(n) FROM ways, (VALUES (0), (1)) t(x) WHERE i < n_a + n_b AND k + x <= n_a GROUP BY ALL),
    u_ways AS (SELECT n_a, n_b, total - n_a * (n_a + 1) / 2 AS v, n FROM ways WHERE i = n_a + n_b AND k = n_a)
    SELECT nation, n_a, n_b, u, CASE WHEN least(n_a, n_b) > 0 THEN round(least(1, 2 * (SELECT sum(n) FILTER (v >= greatest(g.u, g.n_a * g.n_b - g.u)) / sum(n) FROM u_ways w WHERE w.n_a = g.n_a AND w.n_b = g.n_b)), 8) END AS p FROM g""",
)
def _rank_sum_exact(spark, sf):
    """Balances of suppliers with even and odd keys per nation, by the exact distribution."""
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value"), F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("side")
    )
    out = mann_whitney(s, ["nation"], alternative="two-sided", method="exact")
    return rounded(out.select("nation", "n_a", "n_b", "u", "p"))


def _wilcoxon_sql(source: str, keys: str, order: str) -> str:
    k = ", ".join(f"p.{x.strip()}" for x in keys.split(","))
    text = " || '|' || ".join(f"CAST({o.strip()} AS VARCHAR)" for o in order.split(","))
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY {keys}, side) AS mine, count(*) FILTER (side = 'A') OVER (PARTITION BY {keys}) AS na,
  count(*) FILTER (side = 'B') OVER (PARTITION BY {keys}) AS nb FROM {source}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {keys}, side
    ORDER BY CASE WHEN mine > least(na, nb) THEN md5({text} || '|42') ELSE '' END, {order}) AS pos FROM sized),
paired AS (SELECT {keys}, pos, max(value) FILTER (side = 'A') - max(value) FILTER (side = 'B') AS d FROM placed WHERE pos <= least(na, nb) GROUP BY {keys}, pos),
zeros AS (SELECT {keys}, count(*) FILTER (d = 0) AS zeros FROM paired GROUP BY {keys}),
dr AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0 AS rk FROM paired WHERE d <> 0),
dt AS (SELECT {keys}, sum(CAST(t AS DOUBLE) ** 3 - t) AS tie_sum FROM (SELECT {keys}, abs(d) AS x, count(*) AS t FROM paired WHERE d <> 0 GROUP BY ALL) GROUP BY {keys}),
ds AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS up, coalesce(sum(rk) FILTER (d < 0), 0) AS down FROM dr GROUP BY {keys}),
wx AS (SELECT {k}, CAST(n AS BIGINT) AS n, zeros, least(up, down) AS w,
  (least(up, down) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - tie_sum / 2) / 24) AS z
  FROM ds p JOIN dt USING ({keys}) JOIN zeros USING ({keys}))"""


@query(
    "wilcoxon",
    f"WITH {RUNS_SQL}, {_wilcoxon_sql('runs', 'scenario', 'event_id')} SELECT scenario, n, zeros, round(w, 8) AS w, round(z, 8) AS z, round({erfc_sql(f'(abs(z) / {2**0.5!r})')}, 8) AS p FROM wx",
)
def _wilcoxon(spark, sf):
    return rounded(wilcoxon(runs(spark, sf), ["scenario"], ["event_id"]))


@query(
    "signed_rank_exact",
    """WITH RECURSIVE c AS (SELECT c_nationkey AS nation, c_acctbal AS value, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
    d AS (SELECT x.nation, x.value - y.value AS d FROM c x JOIN c y ON y.nation = x.nation AND y.k = x.k + 1 WHERE x.k % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY abs(d)) AS rk FROM d),
    g AS (SELECT nation, count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w FROM r GROUP BY 1),
    ways(n, i, total, m) AS (
      SELECT DISTINCT n, 0, 0, CAST(1 AS DOUBLE) FROM g
      UNION ALL SELECT n, i + 1, total + x * (i + 1), sum(m) FROM ways, (VALUES (0), (1)) t(x) WHERE i < n GROUP BY ALL)
    SELECT nation, n, CAST(w AS DOUBLE) AS w, round(least(1, 2 * (SELECT sum(m) FILTER (total <= g.w) / sum(m) FROM ways x WHERE x.n = g.n AND x.i = g.n)), 8) AS p FROM g""",
)
def _signed_rank_exact(spark, sf):
    """Balances of neighbouring customers per nation, by the exact distribution."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("value"), "c_custkey")
    placed = keyed_position(c, ["c_custkey"], ["nation"], "k")
    # A nation's last customer has no partner if their number is odd.
    sizes = placed.groupBy("nation").agg((F.count("*") - F.count("*") % 2).alias("_n"))
    whole = placed.join(sizes, "nation").filter("k < _n")
    paired = whole.withColumns({"pair": F.expr("k div 2"), "side": F.when(F.col("k") % 2 == 0, "A").otherwise("B")})
    out = wilcoxon(paired.select("nation", "pair", "side", "value"), ["nation"], ["pair"], method="exact")
    return rounded(out.select("nation", "n", "w", "p"))


def _d_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, n_a, n_b, mean_a, mean_b,
    abs(mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS cohen_d FROM (
      SELECT {keys}, count(*) FILTER (side = 'A') AS n_a, count(*) FILTER (side = 'B') AS n_b, avg(value) FILTER (side = 'A') AS mean_a,
      avg(value) FILTER (side = 'B') AS mean_b, var_samp(value) FILTER (side = 'A') AS va, var_samp(value) FILTER (side = 'B') AS vb FROM {source} GROUP BY {keys})"""


@query(
    "cohen_d",
    f"WITH {RUNS_SQL} SELECT scenario, n_a, n_b, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, round(cohen_d, 8) AS cohen_d FROM ({_d_sql('runs', 'scenario')})",
)
def _cohen(spark, sf):
    return rounded(cohen_d(runs(spark, sf), ["scenario"]))


@query(
    "compare_runs",
    f"""WITH base AS (SELECT event_type AS scenario, event_id, CASE WHEN user_id % 5 < 2 THEN 'A' ELSE 'B' END AS side,
      CAST(round(value) AS DOUBLE) AS mcc, CAST(event_id % 13 AS DOUBLE) AS f1 FROM events),
    both_m AS (SELECT scenario, event_id, side, 'mcc' AS metric, mcc AS value FROM base UNION ALL SELECT scenario, event_id, side, 'f1', f1 FROM base),
    runs AS (SELECT scenario, scenario AS own, event_id, side, metric, value FROM both_m UNION ALL SELECT 'overall', scenario, event_id, side, metric, value FROM both_m),
    {_mw_sql('runs', 'scenario, metric')}, {_wilcoxon_sql('runs', 'scenario, metric', 'own, event_id')}, d AS ({_d_sql('runs', 'scenario, metric')})
    SELECT scenario, metric, d.n_a, d.n_b, round(d.mean_a, 8) AS mean_a, round(d.mean_b, 8) AS mean_b, round(cohen_d, 8) AS cohen_d, alternative,
      round(u, 8) AS u, round(mw.z, 8) AS mw_z, round(w, 8) AS w, round(wx.z, 8) AS wilcoxon_z, 'A' AS a, 'B' AS b,
      round({normal_tail_sql('mw.z')}, 8) AS mw_p, round({erfc_sql(f'(abs(wx.z) / {2**0.5!r})')}, 8) AS wilcoxon_p
    FROM d JOIN mw USING (scenario, metric) JOIN wx USING (scenario, metric)""",
)
def _compare(spark, sf):
    base = table(spark, sf, "events").select(
        F.col("event_type").alias("scenario"), "event_id", "user_id",
        F.round("value").alias("mcc"), (F.col("event_id") % 13).cast("double").alias("f1"),
    )
    a, b = base.filter(F.col("user_id") % 5 < 2), base.filter(F.col("user_id") % 5 >= 2)
    return rounded(compare_runs(a, b, ["event_id"]))


@query(
    "align_stats",
    """SELECT scenario, avg(value) AS mean_a, count(*) AS n, max(value) AS top
    FROM (SELECT event_type AS scenario, CAST(event_id AS DOUBLE) AS value FROM events) GROUP BY 1""",
)
def _align(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("scenario"), F.col("event_id").cast("double").alias("value"))
    frames = [
        e.groupBy("scenario").agg(f.alias(n))
        for n, f in {"mean_a": F.avg("value"), "n": F.count(F.lit(1)), "top": F.max("value")}.items()
    ]
    return align(frames, ["scenario"])


# --- CVSS ---------------------------------------------------------------------------------------


@query(
    "cvss_base_score",
    f"SELECT o_orderkey, {_vector_sql('o_orderkey')} AS vector, {_score_sql('o_orderkey')} AS base_score FROM orders",
)
def _base(spark, sf):
    v = table(spark, sf, "orders").select("o_orderkey", _vector("o_orderkey").alias("vector"))
    return v.withColumn("base_score", base_score("vector"))


@query(
    "severity_band",
    f"""SELECT band, count(*) AS n, min(s) AS lowest, max(s) AS highest FROM (
      SELECT s, {_band_sql('s')} AS band FROM (SELECT {_score_sql('o_orderkey')} AS s FROM orders)) GROUP BY 1""",
)
def _band(spark, sf):
    s = table(spark, sf, "orders").select(base_score(_vector("o_orderkey")).alias("s"))
    return s.groupBy(severity_band("s").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("lowest"), F.max("s").alias("highest")
    )


VECTOR_ORDER = [*CODES, "cvss2_severity"]


@query(
    "vector_parts",
    f"""WITH v AS (SELECT o_orderstatus, string_split({_vector_sql('o_orderkey')}, '/') || [{_band_sql('s')}] AS p
                   FROM (SELECT *, {_score_sql('o_orderkey')} AS s FROM orders))
    SELECT o_orderstatus, task, part, count(*) AS n
    FROM (SELECT o_orderstatus, unnest({VECTOR_ORDER!r}) AS task, unnest(p) AS part FROM v) GROUP BY ALL""",
)
def _parts(spark, sf):
    v = table(spark, sf, "orders").select("o_orderstatus", F.inline(vector_parts(_vector("o_orderkey"))))
    return v.groupBy("o_orderstatus", "task", "part").agg(F.count(F.lit(1)).alias("n"))


def _error_sql(task: str) -> str:
    scales = {
        "cvss2_accesscomp": ["LOW", "MEDIUM", "HIGH"], "cvss2_severity": ["LOW", "MEDIUM", "HIGH"],
        "cvss2_conf": ["NONE", "PARTIAL", "COMPLETE"], "cvss2_avail": ["NONE", "PARTIAL", "COMPLETE"],
        "cvss2_integrity": ["NONE", "PARTIAL", "COMPLETE"],
    }
    if task not in scales:
        return f"CASE WHEN {task} = {task}_pred THEN 0 ELSE 1 END"
    s = repr(scales[task])
    return (
        f"CASE WHEN {task} = {task}_pred OR {task} = '-' OR {task}_pred = '-' THEN 0 "
        f"WHEN abs(list_position({s}, {task}) - list_position({s}, {task}_pred)) = 1 THEN 0.5 ELSE 1 END"
    )


@query(
    "cvss_error",
    f"""WITH {_task_labels_sql()} SELECT commit, CAST({' + '.join(f'CASE WHEN {t} = {t}_pred THEN 0 ELSE 1 END' for t in TASKS)} AS DOUBLE) AS score_abs,
    CAST({' + '.join(_error_sql(t) for t in TASKS)} AS DOUBLE) AS score_partial FROM task_labels""",
)
def _error(spark, sf):
    return task_labels(spark, sf).select("commit", cvss_error("abs").alias("score_abs"), cvss_error("partial").alias("score_partial"))


def _vector_rows(spark, sf):
    return key_pairs(spark, sf).select(
        F.col("o_orderstatus").alias("classifier"), _vector("o_orderkey").alias("truth"), _vector("prev_key").alias("pred")
    )


def _compare_vector_sql() -> str:
    parts = f"""vec AS (SELECT o_orderstatus AS classifier, string_split({_vector_sql('o_orderkey')}, '/') || [{_band_sql('s')}] AS t,
      string_split({_vector_sql('prev_key')}, '/') || [{_band_sql('s_pred')}] AS p FROM scored_pairs),
    parts AS (SELECT classifier, unnest({VECTOR_ORDER!r}) AS task, unnest(t) AS truth, unnest(p) AS pred FROM vec),"""
    base = _task_labels_sql()
    return f"""WITH {base}, {parts} {metrics_sql('parts', 'classifier, task')},
    whole AS (SELECT o_orderstatus AS classifier, CAST(count(*) AS DOUBLE) AS f1, CAST(min(o_custkey) AS DOUBLE) AS mcc FROM orders GROUP BY 1),
    single AS (SELECT o_orderstatus AS classifier, {VECTOR_ORDER!r}[CAST(o_custkey % 5 + 1 AS INTEGER)] AS task,
      CAST(count(*) AS DOUBLE) AS f1, CAST(max(o_custkey) AS DOUBLE) AS mcc FROM orders GROUP BY ALL)
    SELECT s.classifier, s.task, round(s.f1, 8) AS f1_individual, round(s.mcc, 8) AS mcc_individual, w.f1, w.mcc,
      coalesce(g.f1, 0) AS f1_task, coalesce(g.mcc, 0) AS mcc_task
    FROM scored s JOIN whole w USING (classifier) LEFT JOIN single g USING (classifier, task)"""


@query("compare_vector", _compare_vector_sql())
def _compare_vector(spark, sf):
    o = table(spark, sf, "orders").withColumn("classifier", F.col("o_orderstatus"))
    whole = o.groupBy("classifier").agg(F.count(F.lit(1)).cast("double").alias("f1"), F.min("o_custkey").cast("double").alias("mcc"))
    task = F.element_at(F.array(*[F.lit(t) for t in VECTOR_ORDER]), (F.col("o_custkey") % 5 + 1).cast("int"))
    single = o.groupBy("classifier", task.alias("task")).agg(
        F.count(F.lit(1)).cast("double").alias("f1"), F.max("o_custkey").cast("double").alias("mcc")
    )
    return rounded(compare_vector(_vector_rows(spark, sf), ["classifier"], whole, single))


# --- logs ---------------------------------------------------------------------------------------

PARTITIONS, RUNS = 4, 3


def log_lines(spark, sf):
    """Events written as training logs: one log per event type, an epoch per event."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("file"), (F.col("user_id") % PARTITIONS).alias("p"),
        (F.floor(F.col("user_id") / PARTITIONS) % RUNS).alias("r"), "event_id", "value",
    )
    run = ["file", "p", "r"]
    sizes = materialise(e.groupBy(*run).agg(F.count(F.lit(1)).alias("n")), "runs")
    e = keyed_position(e, ["event_id"], run, "e").withColumn("e", F.col("e") + 1).join(sizes, run)
    e = e.withColumn("best", (F.col("e") == 1) | (F.floor("value") % 5 == 0))
    epoch = F.array(
        F.concat(F.lit("Epoch "), F.col("e").cast("string"), F.lit("/"), F.col("n").cast("string")),
        F.concat(F.lit("32/32 - "), (F.floor("value") + 1).cast("string"), F.lit("s - loss: 0.5 - acc: 0.25")),
        F.concat(F.lit("Validation time: "), F.format_string("%.2f", "value"), F.lit(" s.")),
        F.when(F.col("best"), F.concat(F.lit("Saving best model at epoch "), F.col("e").cast("string"))),
    )
    kept = F.filter(epoch, lambda x: x.isNotNull())
    head = F.concat(
        F.when((F.col("r") == 0) & (F.col("e") == 1), F.array(F.concat(F.lit("Current partition: "), F.col("p").cast("string")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("e") == 1, F.array(F.concat(F.lit("Run # "), (F.col("r") + 1).cast("string")))).otherwise(F.array().cast("array<string>")),
    )
    tail = F.when(
        F.col("e") == F.col("n"),
        F.array(
            F.lit("Evaluating the best model on the validation set"), F.lit("Validation time: 1.25 s."),
            F.lit("Evaluating the best model on the testing set"), F.concat(F.lit("Validation time: "), F.col("n").cast("string"), F.lit(".5 s.")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    text = e.select("file", "p", "r", "e", F.posexplode(F.concat(head, kept, tail)).alias("at", "line"))
    return keyed_position(text, ["p", "r", "e", "at"], ["file"], "line_no").select("file", "line_no", "line")


LOG_SQL = f"""ev AS (SELECT event_type AS file, CAST(user_id % {PARTITIONS} AS INTEGER) AS "partition", CAST(user_id // {PARTITIONS} % {RUNS} AS INTEGER) AS run,
  event_id, value, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY event_type, user_id % {PARTITIONS}, user_id // {PARTITIONS} % {RUNS} ORDER BY event_id) AS e FROM events),
top AS (SELECT file, "partition", run, CAST(max(e) FILTER (e = 1 OR floor(value) % 5 = 0) AS INTEGER) AS b, CAST(count(*) AS INTEGER) AS n FROM ev GROUP BY ALL),
times AS (SELECT file, "partition", run, avg(floor(value) + 1) AS avg_time_per_epoch, b AS number_of_epoch_at_best_model, n AS number_of_epoch_at_finish,
  CAST(sum(floor(value) + 1) FILTER (e <= b) AS BIGINT) AS total_train_time_at_best_model, CAST(sum(floor(value) + 1) AS BIGINT) AS total_train_time_at_finish,
  sum(cents) FILTER (e <= b) / 100 AS total_val_time_at_best_model, sum(cents) / 100 AS total_val_time_at_finish, n + 0.5::DOUBLE AS final_evaluation_time
  FROM ev JOIN top USING (file, "partition", run) GROUP BY ALL)"""


@query(
    "log_times",
    f"""WITH {LOG_SQL} SELECT file, "partition", run, round(avg_time_per_epoch, 6) AS avg_time_per_epoch, number_of_epoch_at_best_model, number_of_epoch_at_finish,
    total_train_time_at_best_model, total_train_time_at_finish, round(total_val_time_at_best_model, 6) AS total_val_time_at_best_model,
    round(total_val_time_at_finish, 6) AS total_val_time_at_finish, final_evaluation_time,
    round(total_train_time_at_best_model + total_val_time_at_best_model, 6) AS total_time_at_best_model,
    round(total_train_time_at_finish + total_val_time_at_finish, 6) AS total_time_at_finish FROM times""",
)
def _log_times(spark, sf):
    return rounded(log_times(log_lines(spark, sf), PARTITIONS, RUNS), 6)


@query(
    "log_summary",
    f"""WITH {LOG_SQL} SELECT file, CAST(sum("partition") AS BIGINT) AS "partition", CAST(sum(run) AS BIGINT) AS run,
    round(sum(avg_time_per_epoch), 6) AS avg_time_per_epoch,
    CAST(sum(number_of_epoch_at_best_model) AS BIGINT) AS number_of_epoch_at_best_model, CAST(sum(number_of_epoch_at_finish) AS BIGINT) AS number_of_epoch_at_finish,
    CAST(sum(total_train_time_at_best_model) AS BIGINT) AS total_train_time_at_best_model, CAST(sum(total_train_time_at_finish) AS BIGINT) AS total_train_time_at_finish,
    round(sum(total_val_time_at_best_model), 6) AS total_val_time_at_best_model, round(sum(total_val_time_at_finish), 6) AS total_val_time_at_finish,
    sum(final_evaluation_time) AS final_evaluation_time,
    round(sum(total_train_time_at_best_model + total_val_time_at_best_model), 6) AS total_time_at_best_model,
    round(sum(total_train_time_at_finish + total_val_time_at_finish), 6) AS total_time_at_finish FROM times GROUP BY file""",
)
def _log_summary(spark, sf):
    return rounded(log_times(log_lines(spark, sf), PARTITIONS, RUNS, summary="sum"), 6)


@query(
    "log_rejects",
    """SELECT event_type AS file, CAST(user_id % 4 AS INTEGER) AS "partition", CAST(user_id // 4 % 3 AS INTEGER) AS run, 'validation time' AS problem
    FROM events WHERE value = (SELECT max(value) FROM events) GROUP BY ALL""",
)
def _log_rejects(spark, sf):
    lines = log_lines(spark, sf)
    top = table(spark, sf, "events").agg(F.format_string("Validation time: %.2f s.", F.max("value")).alias("line"))
    # The line with the longest validation time is lost.
    broken = lines.join(F.broadcast(top), "line", "left_anti")
    return log_rejects(broken, PARTITIONS, RUNS)
