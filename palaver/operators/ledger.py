"""Scoring that can be resumed: a ledger of the texts that a model has scored.

Texts are told apart by their SHA-256 and scored once each, in steps.  A step is a job of its
own, whose scores are appended to the ledger when it is done.  A run that fails or is killed
loses at most the step it was in: the next run asks only about texts that the ledger lacks.
Which step a text is in follows from its content, so it does not matter how the rows are
partitioned then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.fixed import SCORING_BATCH
from palaver.functions.labels import digest
from palaver.operators.common import value_counts
from palaver.operators.scoring import PredictorFactory, distinct_texts, score_texts
from palaver.operators.skew import ROWS_PER_TASK, join_unique
from palaver.session import shared_folder

LEDGER = T.StructType(
    [
        T.StructField("model_key", T.StringType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("probs", T.ArrayType(T.DoubleType())),
    ]
)
# Texts that one step scores, and so the most that a failure loses.
TEXTS_PER_STEP = 1_000_000
# Tasks that write a step's texts.
WRITERS = 32


def append_scores(rows: DataFrame, path: str) -> None:
    """Append scores to a ledger, partitioned by model."""
    rows.select(*LEDGER.names).write.mode("append").partitionBy("model_key").parquet(path)


def read_ledger(spark: SparkSession, path: str, model_key: str) -> DataFrame:
    """``(text_sha256, probs)`` of a model; a text that two runs scored at once counts once."""
    rows = spark.read.schema(LEDGER).parquet(path).where(F.col("model_key") == model_key)
    return rows.groupBy("text_sha256").agg(F.any_value("probs").alias("probs"))


def fill_ledger(
    df: DataFrame,
    text: str,
    factory: PredictorFactory,
    model_key: str,
    path: str,
    batch_size: int = SCORING_BATCH,
    texts_per_step: int = TEXTS_PER_STEP,
    steps: int | None = None,
    most_steps: int | None = None,
) -> int:
    """Score the texts that the ledger at ``path`` lacks; returns how many were.

    ``steps`` sets the number of steps instead of ``texts_per_step``; with ``most_steps`` the
    run ends after as many.  A null text is not scored.  Another model, or another version of
    one, needs another ``model_key``.
    """
    spark = df.sparkSession
    # An empty append makes sure the folder exists; it adds no row.
    append_scores(spark.createDataFrame([], LEDGER), path)
    known = spark.read.schema(LEDGER).parquet(path).where(F.col("model_key") == model_key)
    texts = distinct_texts(df.where(F.col(text).isNotNull()), text)
    missing = texts.join(known.select("text_sha256"), "text_sha256", "left_anti")
    spread = F.xxhash64("text_sha256")
    todo = shared_folder(spark, "todo")
    if steps is None:
        narrow = df.where(F.col(text).isNotNull()).select(digest(F.col(text)).alias("text_sha256"))
        open_ = narrow.distinct().join(known.select("text_sha256"), "text_sha256", "left_anti")
        steps = -(-open_.count() // texts_per_step)
    if not steps:
        return 0
    step = F.pmod(spread, F.lit(steps)).cast("int").alias("step")
    numbered = missing.select("text_sha256", "text", step)
    dealt = numbered.repartition("step", F.pmod(F.shiftright(spread, 20), F.lit(WRITERS)))
    dealt.write.partitionBy("step").parquet(todo)
    rows = spark.read.schema("text_sha256 string, text string, step int").parquet(todo)
    done = sorted(r["step"] for r in rows.select("step").distinct().collect())[:most_steps]
    for number in done:
        part = rows.where(F.col("step") == number).drop("step")
        scored = score_texts(part, factory, "text", batch_size)
        append_scores(scored.withColumn("model_key", F.lit(model_key)), path)
    return rows.where(F.col("step").isin(done)).count() if done else 0


def score_with_ledger(
    df: DataFrame,
    factory: PredictorFactory,
    model_key: str,
    path: str,
    spread_by: str,
    text: str = "comment_body",
    batch_size: int = SCORING_BATCH,
    texts_per_step: int = TEXTS_PER_STEP,
    steps: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Append ``probs`` as ``scoring.score_texts`` does, from a ledger that is filled first.

    A null text has null scores.  A text of very many rows is spread by ``spread_by``.
    """
    fill_ledger(df, text, factory, model_key, path, batch_size, texts_per_step, steps)
    keyed = df.withColumn("text_sha256", digest(F.col(text)))
    counts = value_counts(keyed.select("text_sha256"), "text_sha256")
    scores = read_ledger(df.sparkSession, path, model_key)
    joined = join_unique(
        keyed, scores, "text_sha256", spread_by, counts=counts, rows_per_task=rows_per_task
    )
    return joined.select(*df.columns, "probs")
