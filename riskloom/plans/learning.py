"""Resampling, neighbours and learned models over the test tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskloom.functions.text import code_tokens, letter_counts
from riskloom.operators.aggregates import most_common
from riskloom.operators.bags import assemble, zero_fill
from riskloom.operators.embeddings import w2v_fit, w2v_mean
from riskloom.operators.folds import expanding_split, time_folds, time_order
from riskloom.operators.metrics import score, score_tasks
from riskloom.operators.models import batch_predict, external_predict, fit, fit_predict, majority_kmeans, multitask_fit, uniform_baseline
from riskloom.operators.multitask import shared_fit, shared_predict
from riskloom.operators.neighbours import build_cells, knn_vote, nearest, recall
from riskloom.operators.resample import oversample_random, oversample_smote, smote_ladder
from riskloom.plans.experiments import evaluate_one_task, metric_record, result_rows, select_then_test, validate_grid
from riskloom.plans.forecast import metrics_sql, rounded
from riskloom.plans.registry import query, table
from riskloom.plans.views import part_sql
from riskloom.session import materialise, scratch_path, spread
from riskloom.sources.models import load_pipeline, save_model


def vectors(spark, sf):
    """Embeddings as dense features with a class label."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("string").alias("label"),
    )
    return spread(e)


VECTORS_SQL = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS VARCHAR) AS label FROM embeddings)"""
L2 = "sqrt(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - t.x[i]) * (q.x[i] - t.x[i]))))"
L1 = "list_sum(list_transform(range(1, len(q.x) + 1), lambda i: abs(q.x[i] - t.x[i])))"


def _near_sql(distance: str, k: int, same_class: bool = False) -> str:
    where = "q.id <> t.id AND q.label = t.label" if same_class else "q.id <> t.id"
    return f"""near AS (SELECT q.id, t.id AS neighbour, t.label, {distance} AS distance FROM v q JOIN v t ON {where}
      QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY distance, t.id) <= {k})"""


@query(
    "nearest_l2",
    f"""WITH {VECTORS_SQL}, {_near_sql(L2, 11)} SELECT id, neighbour, round(distance, 8) AS distance,
    CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM near""",
)
def _nearest_l2(spark, sf):
    v = vectors(spark, sf)
    return rounded(nearest(v, v, 11, skip_same=True))


@query(
    "nearest_l1",
    f"""WITH {VECTORS_SQL}, {_near_sql(L1, 31)} SELECT id, neighbour, round(distance, 8) AS distance,
    CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM near""",
)
def _nearest_l1(spark, sf):
    v = vectors(spark, sf)
    return rounded(nearest(v, v, 31, metric="l1", skip_same=True))


@query(
    "knn_vote",
    f"""WITH {VECTORS_SQL}, {_near_sql(L2, 11)},
    u AS (SELECT id, label AS pred FROM near GROUP BY id, label QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) = 1),
    w AS (SELECT id, label AS weighted FROM near GROUP BY id, label QUALIFY row_number() OVER (PARTITION BY id
      ORDER BY count(*) FILTER (distance = 0) DESC, sum(CASE WHEN distance > 0 THEN 1 / distance ELSE 0 END) DESC, label) = 1)
    SELECT id, pred, weighted FROM u JOIN w USING (id)""",
)
def _knn_vote(spark, sf):
    v = vectors(spark, sf)
    near = nearest(v, v, 11, payload=["label"], skip_same=True)
    return knn_vote(near).join(knn_vote(near, weights="distance").withColumnRenamed("pred", "weighted"), "id")


@query(
    "nearest_cells",
    """SELECT metric, count(*) AS rows, 11 * count(*) AS wanted, true AS ranked, true AS reached
    FROM embeddings, (VALUES ('l1'), ('l2')) m(metric) WHERE vec_id % 20 = 0 GROUP BY metric""",
)
def _nearest_cells(spark, sf):
    """The candidate mode next to the exact one, for every twentieth id: all get their neighbours, and at least 0.9 of
    the exact ones."""
    v = vectors(spark, sf)
    asked = v.where("id % 20 = 0")
    out = []
    for metric in ("l1", "l2"):
        found = materialise(build_cells(v, 11, metric=metric).nearest(asked, v, 11, metric=metric, skip_same=True), "found")
        exact = nearest(asked, v, 11, metric=metric, skip_same=True)
        got = found.agg(F.countDistinct("id"), F.count("*"), F.max("rank")).first()
        out.append((metric, got[0], got[1], got[2] == 11, recall(found, exact) >= 0.9))
    return spark.createDataFrame(out, "metric string, rows bigint, wanted bigint, ranked boolean, reached boolean")


@query(
    "smote_ladder",
    """WITH c AS (SELECT o_custkey % 50 AS grp, min(n) AS smallest FROM (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) OVER (PARTITION BY o_custkey % 50, o_custkey) AS n FROM orders) GROUP BY 1)
    SELECT grp, smallest, CAST(k AS INTEGER) AS k FROM c, (VALUES (1, 1), (5, 5), (10, 10), (15, 15), (20, 20)) t(k, need)
    WHERE smallest > need OR (k = 1 AND smallest > 1)""",
)
def _ladder(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("grp"), "o_custkey")
    return smote_ladder(o, "o_custkey", ["grp"])


COPIES_SQL = """sized AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS missing FROM v GROUP BY label),
draws AS (SELECT label, n, unnest(range(1, missing + 1)) AS i FROM sized),
slots AS (SELECT label, CAST('0x' || substring(md5(label || '|' || i || '|42'), 1, 15) AS BIGINT) % (n * {k}) AS slot FROM draws),
copies AS (SELECT label, slot, count(*) AS n FROM slots GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS place FROM v)"""


def skewed(v):
    """Two thirds of the rows under one label, so that classes differ much in size."""
    return v.withColumn("label", F.when(F.col("id") % 3 != 0, F.lit("0")).otherwise(F.col("label")))


SKEWED_SQL = VECTORS_SQL.replace("CAST(label AS VARCHAR)", "CASE WHEN vec_id % 3 <> 0 THEN '0' ELSE CAST(label AS VARCHAR) END")


@query(
    "oversample_random",
    f"""WITH {SKEWED_SQL}, {COPIES_SQL.format(k=1)}
    SELECT p.id, p.label, 1 + coalesce(c.n, 0) AS n, round(list_sum(p.x), 8) AS total FROM placed p LEFT JOIN copies c ON c.label = p.label AND c.slot = p.place""",
)
def _random(spark, sf):
    rows = oversample_random(skewed(vectors(spark, sf)), "label", "id")
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    out = rows.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"), F.first(total).alias("total"))
    return rounded(out)


@query(
    "oversample_smote",
    f"""WITH {SKEWED_SQL}, {COPIES_SQL.format(k=5)}, {_near_sql(L2, 5, same_class=True)},
    pairs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM near),
    made AS (SELECT p.id, p.label, r.neighbour, c.slot, p.x AS a, t.x AS b, unnest(range(1, c.n + 1)) AS copy
             FROM copies c JOIN placed p ON p.label = c.label AND p.place = c.slot // 5 JOIN pairs r ON r.id = p.id AND r.rank = c.slot % 5 + 1
             JOIN v t ON t.id = r.neighbour),
    share AS (SELECT *, CAST('0x' || substring(md5(label || '|' || slot || '|' || copy || '|42'), 1, 15) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE) AS u FROM made)
    SELECT id, label, neighbour, copy, list_transform(range(1, 65), lambda i: round(a[i] + u * (b[i] - a[i]), 8)) AS x FROM share
    UNION ALL SELECT id, label, NULL, 0, list_transform(x, lambda e: round(e, 8)) FROM v""",
)
def _smote(spark, sf):
    rows = oversample_smote(skewed(vectors(spark, sf)), "label", "id", "x", 5)
    return rows.select("id", "label", "neighbour", "copy", F.transform("x", lambda v: F.round(v, 8)).alias("x"))


# --- models -------------------------------------------------------------------------------------


def experiment_rows(spark, sf, folds=(8,)):
    """Embeddings with fold and role from the time folds of their ids."""
    v = vectors(spark, sf)
    parts = time_folds(time_order(v.select("id", F.col("id").alias("date")), "id", "date"))
    return materialise(expanding_split(v.join(parts.select("id", "time_partition"), "id"), folds), "rows")


def train_test(spark, sf, fold=9):
    rows = experiment_rows(spark, sf, (fold,))
    return rows.filter("role = 'train'"), rows.filter("role IN ('val', 'test')")


def _scored(predictions, **labels):
    return rounded(score(predictions).withColumns({k: F.lit(v) for k, v in labels.items()}))


@query("logistic")
def _logistic(spark, sf):
    train, test = train_test(spark, sf)
    return _scored(fit_predict("lr", ("1",), train, test, "id", "x"), classifier="lr")


@query("svm_rff")
def _svm(spark, sf):
    train, test = train_test(spark, sf)
    return _scored(fit_predict("svm", ("10",), train, test, "id", "x"), classifier="svm")


@query("forest")
def _forest(spark, sf):
    train, test = train_test(spark, sf)
    return _scored(fit_predict("rf", ("100", "100"), train, test, "id", "x"), classifier="rf")


def toxic_rows(spark, sf):
    """Labelled documents with keyword and length measures; the label is rare."""
    d = spread(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id")
    t = d.select("doc_id", "toxic", "quality", "lang", "n_chars", code_tokens("text").alias("t"), F.col("text"))
    rare = F.array_distinct("t")
    return t.select(
        F.col("doc_id").alias("id"), "toxic", "quality", "lang",
        F.array(
            F.log1p("n_chars"), F.log1p(F.size("t")), F.size(rare) / F.greatest(F.size("t"), F.lit(1)),
            F.log1p(F.size(F.filter("t", lambda w: w.rlike("^[0-9]+$")))),
            F.log1p(F.size(F.filter("t", lambda w: F.char_length(w) == 1))),
            F.char_length(F.regexp_replace("text", "[^\n]", "")) / F.greatest(F.col("n_chars"), F.lit(1)),
        ).alias("x"),
    )


def text_split(spark, sf, fold=9):
    t = toxic_rows(spark, sf)
    parts = time_folds(time_order(t.select("id", F.col("id").alias("date")), "id", "date"))
    rows = materialise(expanding_split(t.join(parts.select("id", "time_partition"), "id"), (fold,)), "rows")
    return rows.filter("role = 'train'"), rows.filter("role IN ('val', 'test')")


@query("boosted_trees")
def _boosted(spark, sf):
    train, test = text_split(spark, sf)
    out = None
    for alg in ("xgb", "lgbm"):
        one = _scored(fit_predict(alg, ("20", "16"), train, test, "id", "x", "quality"), classifier=alg)
        out = one if out is None else out.unionByName(one)
    return out


@query("majority_kmeans")
def _kmeans(spark, sf):
    train, test = train_test(spark, sf)
    return _scored(majority_kmeans(train, test, 10, "id", "x"), clusters=10)


@query("multitask_fit")
def _multitask(spark, sf):
    train, test = text_split(spark, sf)
    tasks = ["quality", "toxic", "lang"]
    return rounded(score_tasks(multitask_fit(train, test, tasks, "id", "x"), tasks))


@query("multitask_mlp")
def _multitask_mlp(spark, sf):
    train, test = text_split(spark, sf)
    tasks = ["quality", "toxic", "lang"]
    return rounded(score_tasks(multitask_fit(train, test, tasks, "id", "x", alg="mlp", parameters=("8",)), tasks))


SEVEN = ["quality", "toxic", "lang", "source", "size", "digits", "lines"]


def seven_tasks(spark, sf):
    """Labelled documents with seven labels, and with measures of the text as features."""
    d = spread(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id")
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    groups = ["e", "a", "i", "n", "s", "t", "r", "u", "d", "z", "w", "q", "äöüß", "éèàçñ", ".,;", "!?", "0123456789", "#*$%&|<>", "\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    share = lambda letters: F.col("_counts")[groups.index(letters)] / n
    d = d.withColumn("_counts", letter_counts(F.col("text"), groups))
    tokens = code_tokens("text")
    x = [F.log1p(F.length(text)), F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1)), *[share(g) for g in groups]]
    return d.select(
        F.col("doc_id").alias("id"), F.array(*[c.cast("double") for c in x]).alias("x"), "quality", "toxic", "lang", "source",
        F.when(F.length(text) < 1000, "short").when(F.length(text) < 3000, "middle").otherwise("long").alias("size"),
        F.when(share("0123456789") > 0.01, "many").otherwise("few").alias("digits"),
        F.when(text.contains("\n"), "several").otherwise("one").alias("lines"),
    )


@query("multitask_shared")
def _multitask_shared(spark, sf):
    """Seven heads from one fit: scores of each task on a third of the documents, and the accuracy of its majority."""
    rows = materialise(seven_tasks(spark, sf), "seven")
    third = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 0
    train, test = rows.where(~third), rows.where(third)
    scores = score_tasks(shared_predict(shared_fit(train, SEVEN, "x"), test, "id", "x"), SEVEN)
    cells = F.inline(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("string").alias("label")) for t in SEVEN]))
    most = most_common(train.select(cells), ["task"], "label")
    # A row per task.
    hits = test.select(cells).withColumnRenamed("label", "truth").join(F.broadcast(most), "task")
    share = hits.groupBy("task").agg(F.avg((F.col("truth").eqNullSafe(F.col("label"))).cast("double")).alias("majority"))
    return rounded(scores.join(share, "task"))


@query(
    "uniform_baseline",
    """WITH c AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS c FROM orders)
    SELECT o_orderkey AS id, CAST(r.i AS INTEGER) AS run, o_orderpriority AS truth,
      c[CAST('0x' || substring(md5(o_orderkey || '|' || r.i || '|42'), 1, 15) AS BIGINT) % len(c) + 1] AS pred
    FROM orders, c, range(10) r(i)""",
)
def _uniform(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return uniform_baseline(o, o, "label", "id")


GRID = {"lr": [("0.1",), ("10",)], "knn": [("11", "uniform", "2"), ("31", "distance", "1")]}


STORE_GRID = {
    "knn": [("11", "uniform", "2"), ("11", "distance", "2")], "uniform": [("0",), ("3",)], "majority": [()],
}

STORE_SQL = f"""WITH {VECTORS_SQL},
placed AS (SELECT v.*, row_number() OVER (ORDER BY id) - 1 AS position, count(*) OVER () AS n FROM v),
parts AS (SELECT id, x, label, {part_sql(12)} AS part FROM placed),
folds AS (SELECT CAST(f.i AS INTEGER) AS fold FROM range(10) f(i)),
near AS (SELECT fold, q.id, t.label, {L2} AS distance FROM folds JOIN parts q ON q.part = fold + 1 JOIN parts t ON t.part <= fold
  QUALIFY row_number() OVER (PARTITION BY fold, q.id ORDER BY distance, t.id) <= 11),
classes AS (SELECT fold, list(DISTINCT label ORDER BY label) AS c FROM folds JOIN parts ON part <= fold GROUP BY fold),
votes AS (SELECT fold, id, label, count(*) AS n, count(*) FILTER (distance = 0) AS z, sum(CASE WHEN distance > 0 THEN 1 / distance ELSE 0 END) AS w FROM near GROUP BY ALL),
top AS (SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, label) AS rk FROM folds JOIN parts ON part <= fold GROUP BY fold, label),
chosen AS (
  SELECT fold, id, label AS pred, 'knn' AS classifier, '11-uniform-2' AS parameters FROM votes QUALIFY row_number() OVER (PARTITION BY fold, id ORDER BY n DESC, label) = 1
  UNION ALL SELECT fold, id, label, 'knn', '11-distance-2' FROM votes QUALIFY row_number() OVER (PARTITION BY fold, id ORDER BY z DESC, w DESC, label) = 1
  UNION ALL SELECT fold, id, c[CAST('0x' || substring(md5(id || '|' || r || '|42'), 1, 15) AS BIGINT) % len(c) + 1], 'uniform', CAST(r AS VARCHAR)
    FROM folds JOIN parts ON part = fold + 1 JOIN classes USING (fold), (VALUES (0), (3)) t(r)
  UNION ALL SELECT fold, id, top.label, 'majority', '' FROM folds JOIN parts ON part = fold + 1 JOIN top USING (fold) WHERE rk = 1),
predictions AS (SELECT chosen.*, label AS truth FROM chosen JOIN parts USING (id)),
{{metrics}},
cells AS (
  SELECT p.fold, p.id, p.classifier, p.parameters, p.truth, p.pred, k.label AS class, p.truth = k.label AS positive,
    CASE parameters WHEN '11-uniform-2' THEN coalesce(v.n, 0) / CAST(11 AS DOUBLE)
      WHEN '11-distance-2' THEN coalesce(v.w, 0) / sum(coalesce(v.w, 0)) OVER (PARTITION BY p.fold, p.id, p.classifier, p.parameters)
      ELSE CASE WHEN p.pred = k.label THEN 1 ELSE 0 END END AS score
  FROM predictions p JOIN (SELECT fold, unnest(c) AS label FROM classes) k USING (fold) LEFT JOIN votes v ON v.fold = p.fold AND v.id = p.id AND v.label = k.label),
areas AS (
  SELECT fold, classifier, parameters, class, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
  FROM cells a JOIN cells b USING (fold, classifier, parameters, class) WHERE a.positive AND NOT b.positive GROUP BY ALL),
macro AS (SELECT fold, classifier, parameters, CASE WHEN count(*) = any_value(len(c)) THEN avg(auc) ELSE 0 END AS auc FROM areas JOIN classes USING (fold) GROUP BY fold, classifier, parameters)
SELECT 'label' AS problem, CAST(fold AS VARCHAR) AS "partition", 'code' AS feature_type, 'hunk' AS feature_scope, 'w2v' AS token, classifier, parameters, 'none' AS resampling,
  round(accuracy, 8) AS accuracy, round("precision", 8) AS "precision", round(recall, 8) AS recall, round(sqrt("precision" * recall), 8) AS gmean, round(coalesce(auc, 0), 8) AS auc,
  round(f1, 8) AS f1, round(mcc, 8) AS mcc
FROM scored LEFT JOIN macro USING (fold, classifier, parameters)"""


@query("experiment_store", STORE_SQL.replace("{metrics}", metrics_sql("predictions", "fold, classifier, parameters").strip()))
def _store(spark, sf):
    """A grid on all folds, kept in a store, in the columns of the results table without its times."""
    rows = experiment_rows(spark, sf, tuple(range(10)))
    out = validate_grid(rows, ["label"], "id", "x", STORE_GRID, ("none",), threads=8)
    return rounded(result_rows(out, "code", "hunk", "w2v").drop("train_time", "pred_time"))


@query("validate_grid")
def _validate(spark, sf):
    rows = experiment_rows(spark, sf, (8, 9))
    out = validate_grid(rows, ["label"], "id", "x", GRID, ("none", "over"))
    return rounded(out.drop("train_time", "pred_time"))


@query("baseline_grid")
def _baselines(spark, sf):
    rows = experiment_rows(spark, sf, (9,))
    grid = {"kmeans": [("2",), ("10",)], "uniform": [("0",), ("1",)]}
    return rounded(validate_grid(rows, ["label"], "id", "x", grid, ("none", "over")).drop("train_time", "pred_time"))


@query("select_then_test")
def _select(spark, sf):
    rows = experiment_rows(spark, sf, (9,))
    validated = materialise(validate_grid(rows, ["label"], "id", "x", GRID, ("none",)), "validated")
    return rounded(select_then_test(rows, validated, "id", "x").drop("train_time", "pred_time"))


@query("evaluate_one_task")
def _one_task(spark, sf):
    rows = experiment_rows(spark, sf, (9,)).withColumn("role", F.when(F.col("role") == "train", "train").otherwise("test"))
    marked = rows.withColumn("label", F.when(F.col("label").isin("0", "1", "2", "3"), "-").otherwise(F.col("label")))
    return rounded(evaluate_one_task(marked, "label", "id", {"lr": ("1",), "knn": ("11", "uniform", "2")}, "x"))


@query(
    "external_predict",
    """SELECT p_partkey AS id, CAST(2 * p_size + 1 AS DOUBLE) AS first, CAST(p_size AS DOUBLE) AS second FROM part""",
)
def _external(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.lit(1.0)).alias("x"))

    def make():
        import numpy as np

        weights = np.array([[2.0, 1.0], [1.0, 0.0]])
        return lambda x: (x @ weights).astype("float32")

    scores = external_predict(p, make, "x")
    return scores.select("id", F.col("scores")[0].cast("double").alias("first"), F.col("scores")[1].cast("double").alias("second"))


@query(
    "model_storage",
    "SELECT doc_id AS id, lang AS truth, true AS same FROM documents JOIN labels USING (doc_id)",
)
def _storage(spark, sf):
    # Measured once; the fit and both predictions read the table.
    rows = materialise(toxic_rows(spark, sf), "rows")
    model = fit("rf", ("5", "8"), rows, "x", "lang")
    path = scratch_path(spark, "model")
    save_model(model, path)
    a, b = (batch_predict(m, rows, "id", "x", "lang") for m in (model, load_pipeline(path)))
    return a.join(b.select("id", F.col("pred").alias("_p")), "id").select("id", "truth", (F.col("pred") == F.col("_p")).alias("same"))


@query(
    "metric_record",
    f"""WITH {VECTORS_SQL},
    placed AS (SELECT v.*, row_number() OVER (ORDER BY id) - 1 AS position, count(*) OVER () AS n FROM v),
    parts AS (SELECT id, label, {part_sql(12)} AS part FROM placed),
    top AS (SELECT label FROM parts WHERE part <= 9 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
    predictions AS (SELECT p.label AS truth, top.label AS pred FROM parts p, top WHERE part IN (10, 11)),
    {metrics_sql('predictions', '').strip()}
    SELECT round(accuracy, 8) AS accuracy, round("precision", 8) AS "precision", round(recall, 8) AS recall, round(f1, 8) AS f1,
      round(sqrt("precision" * recall), 8) AS gmean, round(mcc, 8) AS mcc FROM scored""",
)
def _record(spark, sf):
    """The JSON record of the majority's scores, read back."""
    train, test = train_test(spark, sf)
    record = metric_record(score(fit_predict("majority", (), train, test, "id", "x")))
    names = ["accuracy", "precision", "recall", "f1", "gmean", "mcc"]
    return rounded(record.select(F.from_json("results", ", ".join(f"`{n}` double" for n in names)).alias("r")).select("r.*"))


@query("w2v_mean")
def _w2v(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    model = w2v_fit(d, ["text"], size=50)
    mean = w2v_mean(d, model, ["text"])
    return mean.select("doc_id", F.transform(vector_to_array("text_w2v"), lambda v: F.round(v, 4)).alias("vector"))


@query(
    "assembled_features",
    """SELECT vec_id AS id, 128 AS width, round(2 * list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
)
def _assembled(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("prev_features"))
    both = assemble(e.withColumn("cur_features", F.col("prev_features")), ["prev_features", "cur_features"])
    a = both.select("id", vector_to_array("features").alias("f"))
    return rounded(a.select("id", F.size("f").alias("width"), F.aggregate("f", F.lit(0.0), lambda x, y: x + y).alias("total")), 6)


@query(
    "zero_fill",
    """SELECT vec_id AS id, round(CASE WHEN label = 3 THEN 0 ELSE list_sum(CAST(embedding AS DOUBLE[])) END, 6) AS total, 64 AS width FROM embeddings""",
)
def _zero(spark, sf):
    value = F.when(F.col("label") != 3, array_to_vector(F.col("embedding").cast("array<double>")))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), value.alias("x"))
    a = e.select("id", vector_to_array(zero_fill("x", 64)).alias("f"))
    return rounded(a.select("id", F.size("f").alias("width"), F.aggregate("f", F.lit(0.0), lambda x, y: x + y).alias("total")), 6)
