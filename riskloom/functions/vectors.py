"""Feature columns as arrays (stored) or ML vectors (at the edge of Spark ML)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vector(df: DataFrame, column: str) -> DataFrame:
    if isinstance(df.schema[column].dataType, VectorUDT):
        return df
    return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))


def as_array(df: DataFrame, column: str) -> DataFrame:
    if isinstance(df.schema[column].dataType, VectorUDT):
        return df.withColumn(column, vector_to_array(column))
    return df.withColumn(column, F.col(column).cast("array<double>"))
