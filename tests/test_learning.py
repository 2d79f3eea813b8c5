import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.functions.labels import binarise, decode_scores, encode_label
from riskloom.operators import resample
from riskloom.operators.bags import assemble, bow_counts, bow_fit, bow_transform, tfidf, zero_fill
from riskloom.operators import embeddings
from riskloom.operators.embeddings import w2v_fit, w2v_mean
from riskloom.operators.metrics import auc_ovr, score
from riskloom.operators.models import (
    PARAMETERS,
    class_scores,
    external_predict,
    fit,
    fit_predict,
    majority_kmeans,
    multitask_fit,
    scale_gamma,
    uniform_baseline,
)
from riskloom.operators.neighbours import knn_vote, nearest
from riskloom.operators.resample import oversample_random, oversample_smote, smote_ladder
from riskloom.plans.experiments import evaluate_one_task, metric_record, samplings, select_then_test, validate_grid
from riskloom.sources.models import load_pipeline, load_vocabulary, load_word_vectors, save_model, save_vocabulary


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    # Clusters of different density, one far away, and a third of all rows on one point.
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(8, 0.2, (60, 3)), rng.normal(-20, 3, (40, 3)), np.zeros((125, 3))])
    return pd.DataFrame({"id": np.arange(len(x)), "x": x.tolist(), "label": [str(i % 3) for i in range(len(x))]})


def brute(points, k, norm, same_class=False):
    x = np.stack(points["x"])
    out = {}
    for i in range(len(x)):
        d = np.abs(x - x[i]).sum(1) if norm == 1 else np.sqrt(((x - x[i]) ** 2).sum(1))
        ok = [j for j in range(len(x)) if j != i and (not same_class or points["label"][j] == points["label"][i])]
        best = sorted(ok, key=lambda j: (d[j], j))[:k]
        out[i] = [(j, d[j]) for j in best]
    return out


@pytest.mark.parametrize("metric, norm", [("l1", 1), ("l2", 2)])
@pytest.mark.parametrize("block", [16, 4096])
def test_nearest_is_exact(spark, points, metric, norm, block):
    df = spark.createDataFrame(points, "id bigint, x array<double>, label string").repartition(4)
    got = {}
    for r in nearest(df, df, 7, metric=metric, skip_same=True, block=block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    want = brute(points, 7, norm)
    assert len(got) == len(want)
    for i, rows in got.items():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 8))
        assert [j for _, j, _ in sorted(rows)] == [j for j, _ in want[i]]
        assert [d for _, _, d in sorted(rows)] == pytest.approx([d for _, d in want[i]])


def test_nearest_within_groups(spark, points):
    df = spark.createDataFrame(points, "id bigint, x array<double>, label string")
    got = {}
    for r in nearest(df, df, 4, group="label", skip_same=True, block=16).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    want = brute(points, 4, 2, True)
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id int, x array<double>")
    assert nearest(df, df, 5).groupBy("id").count().collect() == nearest(df, df, 2).groupBy("id").count().collect()


def test_votes(spark):
    rows = [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 0.1), (2, "b", 0.0), (2, "a", 0.001), (2, "a", 0.001), (3, "b", 1.0), (3, "a", 1.0)]
    df = spark.createDataFrame(rows, "id int, label string, distance double")
    assert {r["id"]: r["pred"] for r in knn_vote(df).collect()} == {1: "a", 2: "a", 3: "a"}
    assert {r["id"]: r["pred"] for r in knn_vote(df, weights="distance").collect()} == {1: "b", 2: "b", 3: "a"}
    with pytest.raises(ValueError):
        knn_vote(df, weights="other")


@pytest.fixture(scope="module")
def uneven(spark):
    rows = [(i, "a" if i < 60 else "b" if i < 80 else "c", [float(i), float(i % 7)]) for i in range(81)]
    return spark.createDataFrame(rows, "id int, label string, x array<double>").repartition(3)


@pytest.mark.parametrize("block", [10_000, 7])
def test_random_oversampling(uneven, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rows = oversample_random(uneven, "label", "id").collect()
    counts = pd.Series([r["label"] for r in rows]).value_counts().to_dict()
    assert counts == {"a": 60, "b": 60, "c": 60}
    assert sorted(r["id"] for r in rows if r["copy"] == 0) == list(range(81))
    assert len({(r["id"], r["copy"]) for r in rows}) == 180


def test_random_oversampling_is_repeatable(uneven, monkeypatch):
    def ids():
        return sorted((r["id"], r["copy"]) for r in oversample_random(uneven.repartition(5), "label", "id").collect())

    first = ids()
    monkeypatch.setattr(resample, "BLOCK", 5)
    assert ids() == first


def test_smote_fills_classes_between_neighbours(uneven):
    two = uneven.filter("label <> 'c'")
    rows = oversample_smote(two, "label", "id", "x", 5).collect()
    assert pd.Series([r["label"] for r in rows]).value_counts().to_dict() == {"a": 60, "b": 60}
    base = {r["id"]: r["x"] for r in rows if r["copy"] == 0}
    made = [r for r in rows if r["copy"] > 0]
    assert len(made) == 40
    for r in made:
        a, b = np.array(base[r["id"]]), np.array(base[r["neighbour"]])
        span = b - a
        at = (np.array(r["x"]) - a)[0] / span[0]
        assert 0 <= at < 1 and np.allclose(a + at * span, r["x"])
    as_vectors = two.withColumn("x", array_to_vector("x"))
    again = oversample_smote(as_vectors, "label", "id", "x", 5).collect()
    assert sorted((r["id"], r["copy"], r["x"]) for r in again) == sorted((r["id"], r["copy"], r["x"]) for r in rows)
    with pytest.raises(ValueError, match="too few"):
        oversample_smote(uneven, "label", "id", "x", 5)


@pytest.mark.parametrize("size, ks", [(1, []), (5, [1]), (6, [1, 5]), (11, [1, 5, 10]), (20, [1, 5, 10, 15]), (21, [1, 5, 10, 15, 20])])
def test_ladder(spark, size, ks):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * size, "label string")
    assert sorted(r["k"] for r in smote_ladder(df, "label").collect()) == ks
    assert samplings(df, "label", ["none", "over+"]) == ["none"] + [f"over+_{k}" for k in ks]


def test_labels(spark):
    df = spark.createDataFrame([("-", [0.5], [0.2, 0.4, 0.4]), ("x", [0.51], [0.9, 0.0, 0.1])], "l string, p array<double>, s array<double>")
    rows = df.select(binarise("l"), decode_scores("p", ["n", "y"]), decode_scores("s", ["a", "b", "c"]), encode_label("l", ["w", "x"])).collect()
    assert [tuple(r) for r in rows] == [(0, "n", "b", None), (1, "y", "a", 1)]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        c = i % 3
        rows.append((i, "abc"[c], "uv"[c % 2], [float(v) for v in rng.normal(3.0 * c, 0.7, 4)], "train" if i < 160 else "val" if i < 200 else "test"))
    return spark.createDataFrame(rows, "id int, label string, two string, features array<double>, role string")


MODELS = [
    ("lr", ("1",)), ("svm", ("10",)), ("knn", ("11", "distance", "1")), ("rf", ("20", "16")), ("xgb", ("5", "8")),
    ("lgbm", ("5", "8")), ("mlp", ("6",)), ("kmeans", ("6",)),
]


@pytest.mark.parametrize("alg, params", MODELS)
def test_models_beat_the_majority(blobs, alg, params):
    train, test = blobs.filter("role = 'train'"), blobs.filter("role <> 'train'")
    got = score(fit_predict(alg, params, train, test, "id")).first()
    base = score(fit_predict("majority", (), train, test, "id")).first()
    assert got["accuracy"] > 0.85 > base["accuracy"]


@pytest.mark.parametrize("alg, params", [("lr", ("1",)), ("rf", ("20", "16")), ("svm", ("10",))])
def test_fitted_models_feed_the_area_under_the_curve(blobs, alg, params):
    train, test = blobs.filter("role = 'train'"), blobs.filter("role <> 'train'")
    scores = class_scores(fit(alg, params, train), test, "id")
    assert scores.count() == 3 * test.count() and scores.agg(F.sum("positive")).first()[0] == test.count()
    areas = auc_ovr(scores, [], "class", "positive", "score").collect()
    assert {r["class"] for r in areas} == {"a", "b", "c"}
    got = scores.toPandas()
    for r in areas:
        one = got[got["class"] == r["class"]]
        up, down = (one[one["positive"] == v]["score"].to_numpy() for v in (1, 0))
        want = np.mean((up[:, None] > down) + 0.5 * (up[:, None] == down))
        assert r["auc"] == pytest.approx(want) and want > 0.8


def test_kernel_width_is_scaled_by_variance(blobs):
    x = np.array([r["features"] for r in blobs.select("features").collect()])
    assert scale_gamma(blobs, "features") == pytest.approx(1 / (4 * x.var()))
    sparse = blobs.withColumn("features", array_to_vector("features"))
    assert scale_gamma(sparse, "features") == pytest.approx(1 / (4 * x.var()))


def test_two_classes_and_unseen_label(blobs):
    train = blobs.filter("role = 'train' and label <> 'c'")
    test = blobs.filter("role = 'test'")
    rows = fit_predict("lr", ("1",), train, test, "id").collect()
    assert len(rows) == 40
    assert {r["pred"] for r in rows} <= {"a", "b"} and "c" in {r["truth"] for r in rows}


def test_parameter_sets():
    assert {a: len(p) for a, p in PARAMETERS.items()} == {"lr": 5, "svm": 6, "knn": 12, "rf": 9, "xgb": 9, "lgbm": 9}


def test_model_storage(spark, blobs, tmp_path):
    model = fit("svm", ("10",), blobs.filter("role = 'train' and label <> 'c'"))
    save_model(model, str(tmp_path / "m"))
    vec = blobs.withColumn("features", array_to_vector("features"))
    a, b = (m.transform(vec).select("id", "pred").orderBy("id").collect() for m in (model, load_pipeline(str(tmp_path / "m"))))
    assert a == b
    vocab = spark.createDataFrame([("x", 1)], "token string, id int")
    save_vocabulary(vocab, str(tmp_path / "v"))
    assert load_vocabulary(spark, str(tmp_path / "v")).collect() == vocab.collect()


def test_kmeans_uses_global_majority_for_empty_clusters(blobs):
    train = blobs.filter("role = 'train'")
    assert majority_kmeans(train, blobs.filter("role = 'test'"), 50, "id").filter("pred is null").count() == 0


def test_uniform_baseline(blobs):
    rows = uniform_baseline(blobs, blobs, "label", "id", runs=4)
    assert rows.count() == 960 and rows.filter("pred is null").count() == 0
    spread = rows.groupBy("pred").count().collect()
    assert all(250 < r["count"] < 390 for r in spread)
    keyed = uniform_baseline(blobs, blobs, "label", "id", 2, ["two"])
    assert keyed.filter("two = 'v'").select("pred").distinct().count() == 1


def test_multitask(blobs):
    train, test = blobs.filter("role = 'train'"), blobs.filter("role = 'test'")
    one = F.lit("same").alias("flat")
    out = multitask_fit(train.select("*", one), test.select("*", one), ["label", "two", "flat"], "id")
    assert out.columns == ["id", "label", "two", "flat", "label_pred", "two_pred", "flat_pred"]
    assert out.filter("flat_pred <> 'same'").count() == 0 and out.count() == 40


def test_external_model(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "id int, x array<double>")

    def make():
        def predict(x):
            return np.stack([x[:, 0] * 2, x[:, 1]], axis=1).astype("float32")

        return predict

    rows = external_predict(df, make, "x").collect()
    assert all(list(r["scores"]) == [r["id"] * 2.0, 1.0] for r in rows)


def test_grid_select_and_test(blobs):
    data = blobs.withColumn("fold", F.lit(0))
    grid = {"lr": [("0.01",), ("10",)], "knn": [("11", "uniform", "2")]}
    scores = validate_grid(data, ["label"], "id", grid=grid, resampling=["none", "over+_1"])
    assert scores.count() == 3 * 2
    tested = select_then_test(data, scores, "id")
    assert tested.count() == 2 * 2 and tested.filter("mcc > 0.8").count() == 4
    record = metric_record(tested).first()["results"]
    assert record.startswith('{"accuracy":') and "train_time" in record


def test_one_task_comparison(blobs):
    data = blobs.withColumn("fold", F.lit(0)).withColumn("label", F.when(F.col("label") == "a", "-").otherwise(F.col("label")))
    out = {(r["comparison"], r["classifier"]): r for r in evaluate_one_task(data, "label", "id", {"lr": ("1",)}).collect()}
    assert set(out) == {("binary", "lr"), ("multiclass", "lr")}
    assert out[("binary", "lr")]["f1"] > 0.9 and abs(out[("multiclass", "lr")]["mcc_diff"]) < 0.2


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("c1", "a + a b", "x"), ("c2", "b c", None), ("c3", "", "##<END>##\nzz zz")]
    return spark.createDataFrame(rows, "commit string, prev_data string, cur_data string")


def test_bags(texts):
    vocab = bow_fit(texts, ["prev_data", "cur_data"], 4)
    assert [(r["token"], r["id"], r["term_freq"]) for r in vocab.orderBy("id").collect()] == [("a", 0, 2), ("b", 1, 2), ("zz", 2, 2), ("+", 3, 1)]
    rows = {r["commit"]: r for r in bow_transform(texts, vocab, ["prev_data", "cur_data"]).collect()}
    assert rows["c1"]["prev_data_bow"].toArray().tolist() == [2, 1, 0, 1]
    assert rows["c3"]["prev_data_bow"].toArray().tolist() == [0, 0, 0, 0] == rows["c2"]["cur_data_bow"].toArray().tolist()
    long = {(r["commit"], r["id"]): r["n"] for r in bow_counts(texts, vocab, "prev_data", ["commit"]).collect()}
    assert long == {("c1", 0): 2, ("c1", 1): 1, ("c1", 3): 1, ("c2", 1): 1}


def test_zero_fill_and_assemble(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int").withColumn("v", F.when(F.col("id") == 1, array_to_vector(F.array(F.lit(1.0), F.lit(2.0)))))
    filled = df.withColumn("v", zero_fill("v", 2)).withColumn("w", F.col("v"))
    rows = {r["id"]: r["features"].toArray().tolist() for r in assemble(filled, ["v", "w"]).collect()}
    assert rows == {1: [1, 2, 1, 2], 2: [0, 0, 0, 0]}


def test_tfidf_weights(spark):
    df = spark.createDataFrame([(1, "AB ab cd aka"), (2, "cd ef"), (3, None)], "id int, text string")
    got = {(r["id"], r["token"]): r["weight"] for r in tfidf(df, "text", "id", 2).collect()}
    idf = lambda n: np.log(4 / (1 + n)) + 1
    one = np.array([2 * idf(1), idf(2)])
    assert set(got) == {(1, "ab"), (1, "cd"), (2, "cd"), (2, "ef")}
    assert got[(1, "ab")] == pytest.approx(one[0] / np.linalg.norm(one))
    raw = {(r["id"], r["token"]): r["weight"] for r in tfidf(df, "text", "id", 3, 1, 2).collect()}
    assert raw[(1, "ab cd")] == 1 and raw[(1, "ab")] == 2 and raw[(1, "ab ab")] == 1


def test_word_vectors_average_known_words(spark, tmp_path):
    df = spark.createDataFrame([(i, "a b c a b") for i in range(20)] + [(99, "a unknown1"), (100, None)], "id int, t string")
    model = w2v_fit(df, ["t"], size=8, max_words=3)
    rows = {r["id"]: r["t_w2v"].toArray() for r in w2v_mean(df, model, ["t"]).collect()}
    vec = {r["word"]: r["vector"].toArray() for r in model.getVectors().collect()}
    assert set(vec) == {"a", "b", "c"}
    assert np.allclose(rows[99], vec["a"], atol=1e-6) and not rows[100].any()
    save_model(model, str(tmp_path / "w"))
    assert load_word_vectors(str(tmp_path / "w")).getVectors().count() == 3


@pytest.mark.parametrize("variant", [1, 2, 6])
def test_tfidf_in_place_equals_the_joined_form_and_merges_texts_of_a_key(spark, monkeypatch, variant):
    rows = [(1, "AB ab cd aka ef"), (2, "cd ef"), (2, "cd gh ab"), (None, "ab"), (None, "ab cd"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    once = df.where("id IN (1, 4)")
    got = [sorted(map(str, tfidf(d, "text", "id", variant, 1, 2).selectExpr("id", "token", "round(weight, 9) w").collect())) for d in (df, once)]
    monkeypatch.setattr("riskloom.operators.bags.TERMS", 0)
    joined = [sorted(map(str, tfidf(d, "text", "id", variant, 1, 2).selectExpr("id", "token", "round(weight, 9) w").collect())) for d in (df, once)]
    assert got == joined and len(got[0]) > len(got[1]) > 0


def test_tfidf_shuffles_counts_of_terms_and_no_terms_of_documents(spark):
    df = spark.createDataFrame([(i, "ab cd ef") for i in range(40)], "id int, text string")
    plan = tfidf(df, "text", "id", 6, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert tfidf(df, "text", "id", 6, 1, 2).count() == 200


@pytest.mark.parametrize("rows, parts", [(1, 1), (50_000, 1), (50_001, 2), (10_000_000, 200)])
def test_word_vector_parts_grow_with_the_corpus(rows, parts):
    assert embeddings.parts_for(rows) == parts


def test_word_vectors_take_one_pass_whatever_the_size(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SENTENCES", 10)
    seen = {}
    kind = embeddings.Word2Vec
    monkeypatch.setattr(embeddings, "Word2Vec", lambda **args: seen.update(args) or kind(**args))
    df = spark.createDataFrame([("a b c a b",)] * 95, "t string")
    assert w2v_fit(df, ["t"], size=4).getVectors().count() == 3
    assert (seen["numPartitions"], seen["maxIter"]) == (10, 1)


def test_model_storage_measures_documents_once(spark):
    """Fit and predictions read the written measures, not the documents again."""
    from riskloom.plans.learning import _storage

    sf = "/root/testdata/sf0.001"
    got = _storage(spark, sf)
    assert not any("documents.parquet" in f for f in got.inputFiles())
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").count()
    assert got.count() == labelled and got.where("same").count() == labelled


def test_fold_embeddings_returns_the_vectors_it_trains(spark, tmp_path, monkeypatch):
    """The query used to return the length of a vector only, which no training changes."""
    from functools import partial

    from riskloom.plans import preparation

    turns = [(i, t, role, text) for i in range(24) for t, role, text in ((0, "user", f"a b w{i % 3}"), (1, "assistant", "c d a" if i else None))]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(preparation, "fold_embeddings", partial(preparation.fold_embeddings, folds=(0, 9)))
    rows = preparation._fold_embeddings(spark, str(tmp_path)).collect()
    assert sorted({r["fold"] for r in rows}) == [0, 9] and len(rows) == 48 and {r["width"] for r in rows} == {20}
    of = {(r["fold"], r["commit"]): r for r in rows}
    assert all(any(r["prev_vector"]) and len(r["prev_vector"]) == len(r["cur_vector"]) == 20 for r in rows)
    assert all(any(r["cur_vector"]) != (r["commit"] == "0-0") for r in rows)
    assert of[9, "1-0"]["prev_vector"] != of[9, "1-0"]["cur_vector"] and of[9, "1-0"]["prev_vector"] != of[9, "2-0"]["prev_vector"]
    assert of[0, "1-0"]["cur_vector"] != of[9, "1-0"]["cur_vector"]
