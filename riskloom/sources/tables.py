"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.binding import bind
from riskloom.operators.reshape import lower_names, union_all


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str, multiline: bool = False) -> DataFrame:
    """CSV with a header and a given schema; doubled quotes escape quotes.

    ``multiline`` is needed only where text holds line breaks; such files cannot be split.
    """
    paths = path if isinstance(path, str) else list(path)
    return spark.read.schema(schema).csv(paths, header=True, multiLine=multiline, escape='"')


def read_many(spark: SparkSession, paths: Sequence[str], schema: str | None = None, multiline: bool = False) -> DataFrame:
    """Union of CSV (with ``schema``) or Parquet files without repeated and without empty rows."""
    if schema is not None:
        rows = read_table(spark, list(paths), schema, multiline)
    else:
        rows = union_all(*[spark.read.parquet(p) for p in paths])
    return rows.dropDuplicates().na.drop("all")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with lower-case column names; array and vector columns come back as written."""
    return lower_names(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), compression: str = "gzip") -> None:
    """Overwrite a Parquet table, one folder per value of ``by``.

    Rows are first gathered by folder with a spread of tasks per folder left to AQE, so that a
    large folder is not one task and small ones do not make many files.
    """
    if by:
        df = df.hint("rebalance", *by)
    df.write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(path)


def append_results(df: DataFrame, path: str, by: str = "problem") -> None:
    """Add result rows; earlier rows stay, and there is no header to repeat."""
    df.write.mode("append").partitionBy(by).parquet(path)


def file_name(path: Column) -> Column:
    """Last element of a path. A table folder stands for its part files, with or without ``key=``."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.startswith("part-"))
    return F.regexp_replace(F.element_at(steps, -1), "^[a-z]+=", "")


def dims_from_path(path: Column | str) -> Column:
    """Result dimensions coded in a file name, as a struct; NULL when the name has another form.

    Five parts: type, scope, token, fold, rest. Seven: type, scope, token, ``cvss2``, task, fold,
    rest; the scenario is then ``cvss2_<task>``.
    """
    path = F.col(path) if isinstance(path, str) else path

    def dims(parts: Column) -> Column:
        def at(i: int) -> Column:
            return F.get(parts, F.lit(i))

        def shared(scenario: Column, fold: Column) -> Column:
            return F.struct(
                scenario.alias("scenario"), at(0).alias("feature_type"), at(1).alias("feature_scope"),
                at(2).alias("token"), fold.alias("fold"),
            )

        wrong = F.raise_error(F.concat(F.lit("fourth part is not cvss2: "), F.concat_ws("_", parts)))
        kind = F.when((F.size(parts) == 7) & (at(3) != "cvss2"), wrong.cast("int")).otherwise(F.size(parts))
        return F.when(kind == 5, shared(F.lit("multitask"), at(3))).when(
            kind == 7, shared(F.concat_ws("_", at(3), at(4)), at(5))
        )

    return bind(F.split(file_name(path), "_"), dims)


def feature_dims(path: Column | str) -> Column:
    """Dimensions of a feature file ``type_scope_token_problem_fold.ext``; the partition counts from 1.

    Files of manual features hold only the type and the fold.
    """
    path = F.col(path) if isinstance(path, str) else path

    def dims(parts: Column) -> Column:
        def at(i: int) -> Column:
            return F.get(parts, F.lit(i))

        manual = at(0) == "manual"
        return F.struct(
            at(0).alias("feature_type"),
            F.when(manual, at(0)).otherwise(at(1)).alias("feature_scope"),
            F.when(manual, at(0)).otherwise(at(2)).alias("token"),
            (F.when(manual, at(1)).otherwise(at(4)).cast("int") + 1).cast("string").alias("partition"),
        )

    return bind(F.split(F.get(F.split(file_name(path), "\\."), F.lit(0)), "_"), dims)


def read_result_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result files with the dimensions of their names; files of another form are skipped."""
    rows = spark.read.schema(schema).csv(glob, header=True, escape='"').select("*", F.col("_metadata.file_path").alias("_path"))
    dims = rows.withColumn("_d", dims_from_path("_path")).filter(F.col("_d").isNotNull())
    names = ["scenario", "feature_type", "feature_scope", "token", "fold"]
    return dims.select(
        *[c for c in rows.columns if c != "_path" and c not in names],
        *[F.col(f"_d.{n}").alias(n) for n in names],
    )


def experiment_grid(spark: SparkSession, **dims: Sequence) -> DataFrame:
    """All combinations of the given values, one column per dimension.

    Each dimension is a short literal list; the rows come from exploding them, not from a join.
    """
    out = spark.range(1)
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")
