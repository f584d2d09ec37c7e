"""Labelled examples for the classifier benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver import schema
from palaver.fixed import EMOTIONS, SEED
from palaver.functions.labels import names_of
from palaver.functions.text import strip
from palaver.operators.sampling import seeded_sample


def prepare_examples(df: DataFrame, vocabulary: Sequence[str] = EMOTIONS) -> DataFrame:
    """``(id, text, labels)``: text stripped, index lists decoded to names."""
    labels = F.col("labels")
    if "int" in dict(df.dtypes)["labels"]:
        labels = names_of(labels, vocabulary)
    return df.select("id", strip(F.col("text")).alias("text"), labels.alias("labels"))


def read_examples(
    spark: SparkSession, path: str, vocabulary: Sequence[str] = EMOTIONS
) -> DataFrame:
    """Examples from JSON lines (``*.json``, ``*.jsonl``) or Parquet."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        df = spark.read.schema(schema.EXAMPLES).json(path)
    else:
        df = spark.read.parquet(path)
    return prepare_examples(df, vocabulary)


def load_splits(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    max_test_samples: int | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Train and test examples; the test side optionally a seeded subset."""
    train, test = read_examples(spark, train_path), read_examples(spark, test_path)
    if max_test_samples is not None:
        test = seeded_sample(test, "id", max_test_samples, seed)
    return train, test
