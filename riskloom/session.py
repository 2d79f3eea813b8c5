"""Session helpers: the shared scratch folder and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only where
    that is unset and the master is local, as in tests.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


_written: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process has written; results read from them are then gone."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the scratch folder and read it back.

    Cuts lineage, survives the loss of an executor, and pins anything that would differ
    between two evaluations (range boundaries, generated ids).
    """
    path = scratch_path(df.sparkSession, label)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Size up to which a measured table is broadcast.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and binaries by their length, nested columns by their JSON form."""

    def of(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(col) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(col))) + 16
        return F.lit(16)

    return sum((F.coalesce(of(f), F.lit(16)) for f in df.schema.fields), F.lit(0)).cast("bigint")


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for ``df`` only after measuring that it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    Beyond that the join is left to Spark (shuffle join, skewed partitions split by AQE).
    """
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Even out a file scan that has fewer partitions than the cluster has slots.

    A small file read as one partition would leave heavy per-row work to one task. A large scan
    has partitions enough and is returned as it is, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
