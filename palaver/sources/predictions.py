"""Prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver import schema
from palaver.functions.labels import decode
from palaver.functions.values import utc_from_instant
from palaver.sources.comments import scan_csv, whole_numbers


def prepare_predictions(df: DataFrame) -> DataFrame:
    """Fill missing labels and sentiment, type the time, add ``emotions`` as an array."""
    out = df
    if "predicted_emotions" in df.columns:
        out = out.withColumn("predicted_emotions", F.coalesce("predicted_emotions", F.lit("")))
        out = out.withColumn("emotions", decode(F.col("predicted_emotions")))
    if "predicted_sentiment" in df.columns:
        out = out.withColumn(
            "predicted_sentiment", F.coalesce("predicted_sentiment", F.lit("neutral"))
        )
    if dict(df.dtypes).get("comment_created_at") == "string":
        # An offset is applied; a time without one is already UTC.
        text = F.col("comment_created_at")
        aware = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(
            F.concat(text, F.lit("+00:00"))
        )
        out = out.withColumn(
            "comment_created_at", utc_from_instant(F.try_to_timestamp(aware))
        )
    return out


def read_predictions_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Predictions from CSV."""
    raw = scan_csv(spark, path, schema.PREDICTIONS_CSV)
    return prepare_predictions(whole_numbers(raw, schema.PREDICTIONS_CSV))


def read_predictions_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Predictions from Parquet, where labels may be joined text or already an array."""
    df = spark.read.parquet(path)
    if "predicted_emotions" not in df.columns and "emotions" in df.columns:
        df = df.withColumn("predicted_emotions", F.array_join("emotions", "|"))
    return prepare_predictions(df)
