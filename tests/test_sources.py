import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.session import broadcast_if_small, materialise, scratch_dir
from riskloom.sources.logs import log_rejects, log_times, read_logs
from riskloom.sources.schemas import ADVISORIES, CHANGES, COMMIT_MAP, COMMITS, RESULTS
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


class Session:
    """A session with given settings, for the choice of the scratch folder."""

    def __init__(self, configured, master):
        self.conf = {} if configured is None else {"spark.checkpoint.dir": configured}
        self.sparkContext = self
        self.master = master
        self.chosen = configured

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, path):
        self.chosen = path


def test_scratch_dir_comes_from_the_session():
    assert scratch_dir(Session("hdfs://shared/scratch/", "yarn")) == "hdfs://shared/scratch"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session(None, "yarn"))
    assert "riskloom-" in scratch_dir(Session(None, "local[2]"))


def test_materialise_pins_rows(spark):
    pinned = materialise(spark.range(100).selectExpr("id", "uuid() as u"))
    assert pinned.collect() == pinned.collect() and pinned.count() == 100


def test_drop_scratch_deletes_own_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    monkeypatch.setattr(session, "scratch_dir", lambda s: str(tmp_path))
    (tmp_path / "other").mkdir()
    materialise(spark.range(3), "mine")
    assert len(list(tmp_path.iterdir())) == 2
    assert session.drop_scratch(spark) == 1
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_broadcast_only_below_the_limit(spark):
    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(broadcast_if_small(spark.range(10), 10)) and not hinted(broadcast_if_small(spark.range(11), 10))


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    rows = [("c1", 'a "quoted", text', "line\nbreak"), ("c2", None, "x,y")]
    df = spark.createDataFrame(rows, CHANGES)
    write_csv(df, str(tmp_path / "t"))
    back = read_table(spark, str(tmp_path / "t"), CHANGES, multiline=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    (tmp_path / "o.csv").write_text('commit,prev_data,cur_data\nc3,"say ""hi""",\n')
    assert tuple(read_table(spark, str(tmp_path / "o.csv"), CHANGES).first()) == ("c3", 'say "hi"', None)


def test_schemas_are_valid(spark):
    for ddl in (COMMITS, ADVISORIES, COMMIT_MAP, RESULTS):
        assert spark.createDataFrame([], ddl).count() == 0


def test_read_many_dedupes_and_drops_empty_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("commit,prev_data,cur_data\nc1,x,y\nc1,x,y\n,,\n")
    (tmp_path / "b.csv").write_text("commit,prev_data,cur_data\nc1,x,y\nc2,,\n")
    rows = read_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], CHANGES).collect()
    assert sorted(r["commit"] for r in rows) == ["c1", "c2"]


def test_feature_tables_prune_folders(spark, tmp_path):
    df = spark.createDataFrame([("c1", [1, 2], 0), ("c2", [], 1)], "Commit string, F array<int>, fold int")
    write_parquet(df, str(tmp_path / "f"), ["fold"])
    back = read_features(spark, str(tmp_path / "f"))
    assert set(back.columns) == {"commit", "f", "fold"} and back.filter("fold = 0").first()["f"] == [1, 2]
    plan = back.filter("fold = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_append_keeps_earlier_rows(spark, tmp_path):
    for n in (1, 2):
        append_results(spark.createDataFrame([("binary", n)], "problem string, n int"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_names(spark):
    paths = ["/o/code_hc_word_3_results.csv", "/o/ast_ss_char_cvss2_auth_7_res.csv", "/o/readme.csv", "/o/file=code_hunk_word_1_r.csv/part-000.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r["d"] and tuple(r["d"]) for r in df.select(dims_from_path("p").alias("d")).collect()]
    assert got == [("multitask", "code", "hc", "word", "3"), ("cvss2_auth", "ast", "ss", "char", "7"), None, ("multitask", "code", "hunk", "word", "1")]
    with pytest.raises(Exception, match="not cvss2"):
        spark.createDataFrame([("a_b_c_d_e_f_g",)], "p string").select(dims_from_path("p")).collect()
    f = spark.createDataFrame([("i/code_ss_w2v_multiclass_7.pkl",), ("i/manual_3.parquet",)], "p string")
    assert [tuple(r["d"]) for r in f.select(feature_dims("p").alias("d")).collect()] == [("code", "ss", "w2v", "8"), ("manual", "manual", "manual", "4")]


def test_result_files_get_dimensions_and_skip_others(spark, tmp_path):
    (tmp_path / "code_hc_word_4_results.csv").write_text("run,mcc\n1,0.5\n")
    (tmp_path / "notes.csv").write_text("run,mcc\n9,0.1\n")
    rows = read_result_files(spark, str(tmp_path), "run int, mcc double").collect()
    assert [(r["run"], r["fold"], r["scenario"]) for r in rows] == [(1, "4", "multitask")]


def test_grid(spark):
    g = experiment_grid(spark, alg=["lr", "rf"], fold=[0, 1, 2])
    assert g.distinct().count() == 6 and g.columns == ["alg", "fold"]


def log_text(partitions=2, runs=2, epochs=3, lose=None):
    out = ["start", "Epoch sizes follow"]
    for p in range(partitions):
        out += ["####", f"Current partition: {p}", "Loading data"]
        for r in range(runs):
            out += ["####", f"Run # {r + 1}", "Training models"]
            for e in range(1, epochs + 1):
                out += [f"Epoch {e}/{epochs}", f"32/32 - {10 * e + r}s - loss: 0.6 - a_loss: 0.1", f"Validation time: {e}.25 s.", ""]
                if e <= 2:
                    out += [f"Saving best model at epoch {e}"]
                else:
                    out += ["Val metric did not increase from the last epoch."]
            out += ["Evaluating the best model on the validation set", "Validation time: 9.5 s.", "Evaluating the best model on the testing set", f"Validation time: {p + r}.5 s."]
    if lose is not None:
        out.remove(lose)
    return "\n".join(out)


def lines_of(spark, tmp_path, **kw):
    (tmp_path / "a.out").write_text(log_text(**kw))
    (tmp_path / "b.out").write_text(log_text())
    return read_logs(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))


def test_log_times(spark, tmp_path):
    rows = {(r["file"], r["partition"], r["run"]): r for r in log_times(lines_of(spark, tmp_path), 2, 2).collect()}
    assert len(rows) == 8
    r = rows[("a.out", 1, 1)]
    assert r["avg_time_per_epoch"] == 21 and r["number_of_epoch_at_best_model"] == 2 and r["number_of_epoch_at_finish"] == 3
    assert r["total_train_time_at_best_model"] == 32 and r["total_train_time_at_finish"] == 63
    assert r["total_val_time_at_best_model"] == 3.5 and r["total_time_at_finish"] == 63 + 6.75
    assert r["final_evaluation_time"] == 2.5
    total = {r["file"]: r["total_train_time_at_finish"] for r in log_times(lines_of(spark, tmp_path), 2, 2, "sum").collect()}
    assert total == {"a.out": 2 * (60 + 63), "b.out": 246}


@pytest.mark.parametrize(
    "lose, problem",
    [("Validation time: 2.25 s.", "validation time"), ("32/32 - 20s - loss: 0.6 - a_loss: 0.1", "epoch time"),
     ("Evaluating the best model on the testing set", "best model evaluation"), ("Epoch 2/3", "epoch order"), ("Run # 2", "number of runs")],
)
def test_broken_logs_are_named(spark, tmp_path, lose, problem):
    lines = lines_of(spark, tmp_path, lose=lose)
    found = {(r["file"], r["problem"]) for r in log_rejects(lines, 2, 2).collect()}
    assert ("a.out", problem) in found and not any(f == "b.out" for f, _ in found)
    with pytest.raises(ValueError, match="broken log"):
        log_times(lines, 2, 2)
    assert log_times(lines, 2, 2, strict=False).filter("file = 'b.out'").count() == 4
    with pytest.raises(ValueError):
        log_times(lines, 2, 2, summary="max")
