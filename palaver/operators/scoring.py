"""Batch scoring with pluggable models, and incremental scoring with a reply cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver import schema
from palaver.fixed import EMOTIONS, MODELS, SCORING_BATCH, THRESHOLD
from palaver.functions.labels import (
    above_threshold,
    digest,
    encode,
    parse_reply,
    prompt,
    sentiment_of,
)
from palaver.operators.common import value_counts
from palaver.operators.models import factory_key, model_of, predictions
from palaver.operators.skew import ROWS_PER_TASK, join_unique

CACHE = T.StructType(
    [
        T.StructField("model_key", T.StringType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("emotions", T.ArrayType(T.StringType())),
    ]
)

# Model batches whose texts and results a task holds as Python objects at a time.
BATCHES_HELD = 32

# Called once per worker process; returns a function from a batch of texts to score rows.
PredictorFactory = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
# Called once per worker process; returns a function from a batch of prompts to reply texts.
ReplierFactory = Callable[[], Callable[[list[str]], Sequence[str]]]


def model_label(model_key: str, kind: str | None = None) -> str:
    """Display label of a known model; an unknown or wrong-kind model raises."""
    if model_key not in MODELS:
        raise ValueError(f"unknown model {model_key!r}; known models: {', '.join(MODELS)}")
    label, known_kind = MODELS[model_key]
    if kind is not None and known_kind != kind:
        raise ValueError(f"model {model_key!r} is of kind {known_kind!r}, not {kind!r}")
    return label


def _apply_batched(
    df: DataFrame,
    column: str,
    factory: Callable[[], Callable[[list[str]], Sequence]],
    output: T.StructField,
    arrow_type: pa.DataType,
    batch_size: int,
) -> DataFrame:
    """Append a column computed by a model from batches of one text column.

    The model is loaded once per worker process, which serves many tasks, and sees texts of
    like length together.  Batches cross as Arrow, and all other columns pass through
    untouched, so rows keep their order and identity without a join.
    """
    key = factory_key(factory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = None
        for whole in batches:
            for start in range(0, whole.num_rows, BATCHES_HELD * batch_size):
                batch = whole.slice(start, BATCHES_HELD * batch_size)
                predict = predict or model_of(key, factory)
                out = predictions(predict, batch.column(column).to_pylist(), batch_size)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(out, type=arrow_type)],
                    names=[*batch.schema.names, output.name],
                )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, output]))


def score_texts(
    df: DataFrame,
    factory: PredictorFactory,
    text: str = "comment_body",
    batch_size: int = SCORING_BATCH,
) -> DataFrame:
    """Append ``probs array<double>``, one score per vocabulary label.

    The factory owns tokenising, including truncation (``fixed.MAX_TOKENS`` is usual).
    """
    field = T.StructField("probs", T.ArrayType(T.DoubleType()))
    return _apply_batched(df, text, factory, field, pa.list_(pa.float64()), batch_size)


def score_comments(
    df: DataFrame,
    factory: PredictorFactory,
    model_key: str = "roberta_samlowe",
    batch_size: int = SCORING_BATCH,
    threshold: float = THRESHOLD,
    vocabulary: Sequence[str] = EMOTIONS,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Cleaned comments to the prediction table.  Narrow: no shuffle.

    ``scorer`` appends ``probs`` in another way than asking the factory's model about every
    row, for example from a ledger.
    """
    label = model_label(model_key, "transformer")
    carried = {f.name: f.dataType for f in df.schema.fields}
    for name, kind in (("post_score", "bigint"), ("subreddit", "string")):
        if name not in carried:
            df = df.withColumn(name, F.lit(None).cast(kind))
    identity = [c for c in schema.PREDICTION_COLUMNS if c in df.columns]
    rows = df.select(*identity)
    scored = scorer(rows) if scorer else score_texts(rows, factory, batch_size=batch_size)
    labelled = scored.withColumn("emotions", above_threshold(F.col("probs"), vocabulary, threshold))
    return labelled.select(
        *identity,
        encode(F.col("emotions")).alias("predicted_emotions"),
        sentiment_of(F.col("emotions")).alias("predicted_sentiment"),
        F.lit(model_key).alias("model_key"),
        F.lit(label).alias("model_label"),
    )


def prompts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(text_sha256, prompt)`` for each distinct text."""
    return (
        df.select(digest(F.col(text)).alias("text_sha256"), F.col(text).alias("text"))
        .groupBy("text_sha256")
        .agg(F.any_value("text").alias("text"))
        .select("text_sha256", prompt(F.col("text")).alias("prompt"))
    )


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """``(text_sha256, text, copies)``; copies are merged before and after the shuffle."""
    return (
        df.select(digest(F.col(text)).alias("text_sha256"), F.col(text).alias("text"))
        .groupBy("text_sha256")
        .agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )


def split_by_cache(
    texts: DataFrame, cache: DataFrame, model: str
) -> tuple[DataFrame, DataFrame]:
    """Texts already answered by the model, with their labels, and those that are not.

    ``cache`` is ``(model_key, text_sha256, emotions)``, one row per pair.
    """
    known = cache.where(F.col("model_key") == model).drop("model_key")
    hits = texts.join(known, "text_sha256", "inner")
    misses = texts.join(known, "text_sha256", "left_anti")
    return hits, misses


def ask(
    texts: DataFrame, factory: ReplierFactory, batch_size: int = SCORING_BATCH
) -> DataFrame:
    """Append ``emotions``: build the prompt, get the reply, parse it."""
    field = T.StructField("raw_response", T.StringType())
    asked = texts.withColumn("_prompt", prompt(F.col("text")))
    replied = _apply_batched(asked, "_prompt", factory, field, pa.string(), batch_size)
    return replied.withColumn("emotions", parse_reply(F.col("raw_response"))).drop(
        "_prompt", "raw_response"
    )


def append_cache(rows: DataFrame, path: str) -> None:
    """Append answers to the cache table, partitioned by model."""
    rows.select("model_key", "text_sha256", "emotions").write.mode("append").partitionBy(
        "model_key"
    ).parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; a pair stored twice by concurrent runs counts once."""
    return (
        spark.read.schema(CACHE)
        .parquet(path)
        .groupBy("model_key", "text_sha256")
        .agg(F.any_value("emotions").alias("emotions"))
    )


def attach_answers(
    df: DataFrame,
    text: str,
    answers: DataFrame,
    spread_by: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Give every row the labels of its text.

    ``answers`` is ``(text_sha256, copies, emotions)``.  A text with very many
    copies is salted; its copies were counted when texts were made distinct.
    """
    return join_unique(
        df.withColumn("text_sha256", digest(F.col(text))),
        answers.select("text_sha256", "emotions"),
        "text_sha256",
        spread_by=spread_by,
        counts=answers.select("text_sha256", "copies"),
        rows_per_task=rows_per_task,
    )


def score_with_cache(
    df: DataFrame,
    text: str,
    model: str,
    factory: ReplierFactory,
    cache_path: str,
    spread_by: str,
    batch_size: int = SCORING_BATCH,
) -> DataFrame:
    """Label every row, asking the model only about texts it has not answered yet.

    Texts are fetched for unanswered questions alone; answers are joined by digest.

    New answers are appended to the cache before use.  A later run, or a repeated
    one, reads them back instead of asking again.
    """
    spark = df.sparkSession
    # An empty append makes sure the folder exists; it adds no row.
    append_cache(spark.createDataFrame([], CACHE), cache_path)
    texts = distinct_texts(df, text)
    _, misses = split_by_cache(texts, read_cache(spark, cache_path), model)
    append_cache(
        ask(misses, factory, batch_size).withColumn("model_key", F.lit(model)), cache_path
    )
    counts = value_counts(df.select(digest(F.col(text)).alias("text_sha256")), "text_sha256")
    answers, _ = split_by_cache(counts, read_cache(spark, cache_path), model)
    return attach_answers(df, text, answers, spread_by)
