"""Training logs: times per file, partition and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.ranks import keyed_position, running_totals
from riskloom.session import materialise

# Texts that mark the structure of a log.
PARTITION_MARK = "Current partition:"
RUN_MARK = "Run # "
EVALUATION_MARK = "Evaluating the best model"
EPOCH_MARK = "Epoch "
LOSS_MARK = "loss: "
VALIDATION_MARK = "Validation time: "
BEST_MARK = "Saving best model at epoch"
NUMBER = r"[-+]?\d*\.\d+|\d+"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with their number within the file.

    Large logs are read in splits; the order of a line is its split's start and its place in it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    return keyed_position(lines, ["_start", "_at"], ["file"], "line_no").select("file", "line_no", "line")


def _segments(lines: DataFrame) -> DataFrame:
    """Lines with the running number of their partition, run, evaluation and epoch block.

    The numbers are distributed running totals per file, so one huge log spreads over tasks.
    """
    def starts(mark: str):
        return F.col("line").contains(mark).cast("bigint")

    marked = lines.select(
        "file", "line_no", "line",
        starts(PARTITION_MARK).alias("m_p"), starts(RUN_MARK).alias("m_r"),
        starts(EVALUATION_MARK).alias("m_v"),
        F.col("line").rlike(f"^{EPOCH_MARK}\\d+/\\d+").cast("bigint").alias("m_e"),
    )
    return running_totals(
        marked, {"p": "m_p", "r": "m_r", "v": "m_v", "e": "m_e"}, ["line_no"], ["file"]
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per epoch or evaluation block, with its numbers."""
    seg = _segments(lines).filter(F.col("p") > 0)
    line = F.col("line")
    has_loss, has_time = line.contains(LOSS_MARK), line.contains(VALIDATION_MARK)
    numbers = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))
    took = F.regexp_extract(F.get(F.split(line, " - "), F.lit(1)), r"^(\d+)s$", 1)
    return seg.groupBy("file", "p", "r", "v", "e").agg(
        F.max(F.when(F.col("m_e") == 1, F.regexp_extract("line", r"Epoch (\d+)/", 1).try_cast("int"))).alias("epoch"),
        F.max(F.when(F.col("m_e") == 1, F.regexp_extract("line", r"Epoch \d+/(\d+)", 1).try_cast("int"))).alias("epochs"),
        F.count(F.when(has_loss, 1)).alias("n_loss"),
        F.count(F.when(has_time, 1)).alias("n_time"),
        F.max(F.when(has_loss, took.try_cast("int"))).alias("epoch_time"),
        F.max(F.when(has_time & (F.size(numbers) == 1), F.get(numbers, F.lit(0)).try_cast("double"))).alias("val_time"),
        F.bool_or(line.contains(BEST_MARK)).alias("is_best"),
    )


def _numbered(lines: DataFrame) -> DataFrame:
    """Blocks with partition and run counted from 0 and the evaluation step within the run."""
    blocks = materialise(_blocks(lines), "logblocks")
    # Lines before the first run of a partition share the run number of the partition before;
    # that number is the base the partition's own runs count from.
    runs = blocks.groupBy("file", "p", "r").agg(F.min("v").alias("_v0"))
    base = runs.groupBy("file", "p").agg(F.min("r").alias("_r0"))
    return (
        blocks.join(runs, ["file", "p", "r"])
        .join(base, ["file", "p"])
        .filter(F.col("r") > F.col("_r0"))
        .withColumns(
            {
                "partition": (F.col("p") - 1).cast("int"),
                "run": (F.col("r") - F.col("_r0") - 1).cast("int"),
                "step": (F.col("v") - F.col("_v0")).cast("int"),
            }
        )
    )


def _run_stats(numbered: DataFrame) -> DataFrame:
    training = (F.col("step") == 0) & F.col("epoch").isNotNull()
    best = F.max(F.when(training & F.col("is_best"), F.col("epoch")))
    runs = numbered.groupBy("file", "partition", "run").agg(best.alias("best_epoch"))
    rows = numbered.join(runs, ["file", "partition", "run"])
    upto = training & (F.col("epoch") <= F.col("best_epoch"))

    def total(cond, column):
        return F.sum(F.when(cond, F.col(column)))

    return rows.groupBy("file", "partition", "run").agg(
        F.avg(F.when(training, F.col("epoch_time"))).alias("avg_time_per_epoch"),
        F.max("best_epoch").alias("number_of_epoch_at_best_model"),
        F.count(F.when(training, 1)).cast("int").alias("number_of_epoch_at_finish"),
        total(upto, "epoch_time").alias("total_train_time_at_best_model"),
        total(training, "epoch_time").alias("total_train_time_at_finish"),
        total(upto, "val_time").alias("total_val_time_at_best_model"),
        total(training, "val_time").alias("total_val_time_at_finish"),
        F.max(F.when(F.col("step") == 2, F.col("val_time"))).alias("final_evaluation_time"),
        # Structure, for the checks.
        F.max("step").alias("_steps"),
        F.min(F.when(training, F.col("epoch"))).alias("_first"),
        F.max(F.when(training, F.col("epoch"))).alias("_last"),
        # Epochs in order run along with the number of their block.
        F.count_distinct(F.when(training, F.col("epoch") - F.col("e"))).alias("_paces"),
        F.count_distinct(F.when(training, F.col("epochs"))).alias("_denominators"),
        F.count(F.when(training & ((F.col("n_loss") != 1) | F.col("epoch_time").isNull()), 1)).alias("_bad_loss"),
        F.count(F.when(training & ((F.col("n_time") != 1) | F.col("val_time").isNull()), 1)).alias("_bad_time"),
        F.sum(F.when(F.col("step") == 2, F.col("n_time"))).alias("_final"),
    )


def _problem():
    return (
        F.when(F.col("_steps") != 2, "best model evaluation")
        .when((F.col("_first") + F.col("number_of_epoch_at_finish") - 1 != F.col("_last")) | (F.col("_paces") > 1), "epoch order")
        .when(F.col("_denominators") != 1, "epoch count")
        .when(F.col("_bad_loss") > 0, "epoch time")
        .when(F.col("_bad_time") > 0, "validation time")
        .when((F.col("_final") != 1) | F.col("final_evaluation_time").isNull(), "final validation time")
        .when(F.col("number_of_epoch_at_best_model").isNull(), "best model")
    )


def log_rejects(lines: DataFrame, partitions: int = 10, runs: int = 10) -> DataFrame:
    """Broken blocks: file, partition, run (NULL for a whole file) and what is wrong."""
    stats = materialise(_run_stats(_numbered(lines)), "logruns")
    return _rejects(stats, partitions, runs)


def _rejects(stats: DataFrame, partitions: int, runs: int) -> DataFrame:
    broken = stats.withColumn("problem", _problem()).filter(F.col("problem").isNotNull())
    counts = stats.groupBy("file", "partition").agg(F.count(F.lit(1)).alias("_n"))
    few = counts.filter(F.col("_n") != runs).select("file", "partition", F.lit(None).cast("int").alias("run"), F.lit("number of runs").alias("problem"))
    files = counts.groupBy("file").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") != partitions)
    none = files.select(
        "file", F.lit(None).cast("int").alias("partition"), F.lit(None).cast("int").alias("run"),
        F.lit("number of partitions").alias("problem"),
    )
    return broken.select("file", "partition", "run", "problem").unionByName(few).unionByName(none)


def log_times(lines: DataFrame, partitions: int = 10, runs: int = 10, summary: str | None = None, strict: bool = True) -> DataFrame:
    """Times per file, partition and run; ``summary`` ('mean' or 'sum') gives one row per file.

    With ``strict`` a broken log raises; otherwise broken runs are left to ``log_rejects``.
    """
    if summary not in (None, "mean", "sum"):
        raise ValueError("summary: 'mean' or 'sum'")
    stats = materialise(_run_stats(_numbered(lines)), "logruns")
    if strict:
        first = _rejects(stats, partitions, runs).first()
        if first is not None:
            raise ValueError(f"broken log: {first.asDict()}")
    good = stats.filter(_problem().isNull()).drop(*[c for c in stats.columns if c.startswith("_")])
    out = good.withColumns(
        {
            "total_time_at_best_model": F.col("total_train_time_at_best_model") + F.col("total_val_time_at_best_model"),
            "total_time_at_finish": F.col("total_train_time_at_finish") + F.col("total_val_time_at_finish"),
        }
    )
    if summary is None:
        return out
    fn = F.avg if summary == "mean" else F.sum
    return out.groupBy("file").agg(*[fn(c).alias(c) for c in out.columns if c != "file"])
