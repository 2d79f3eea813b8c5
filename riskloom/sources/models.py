"""Fitted models and vocabularies on shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession


def save_model(model, path: str) -> None:
    """Overwrite a fitted Spark ML model or pipeline."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_word_vectors(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
