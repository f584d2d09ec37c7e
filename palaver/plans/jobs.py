"""The two end-to-end jobs: score a comment file, and benchmark models."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.fixed import EXPERIMENT_PREFIXES, SCORING_BATCH, THRESHOLD
from palaver.operators.cleaning import CleaningOptions, clean
from palaver.operators.evaluation import (
    emotion_labels,
    evaluate_emotions,
    evaluate_sentiment,
    sentiment_labels,
)
from palaver.operators.ledger import score_with_ledger
from palaver.operators.sampling import first_rows
from palaver.operators.scoring import PredictorFactory, model_label, score_comments
from palaver.operators.training import Runner, run_models, with_truth
from palaver.sources.comments import read_comments_csv, read_comments_parquet
from palaver.sources.examples import load_splits
from palaver.sources.sinks import read_run, write_benchmark, write_evaluation, write_run


def experiment_name(model_key: str, now: datetime | None = None) -> str:
    """Default name of a scoring run: model prefix and time."""
    prefix = EXPERIMENT_PREFIXES.get(model_key, f"reddit_{model_key}")
    return f"{prefix}_{now or datetime.now():%Y%m%d_%H%M%S}"


def score_dataset(
    spark: SparkSession,
    dataset: str,
    root: str,
    factory: PredictorFactory,
    model_key: str = "roberta_samlowe",
    experiment: str | None = None,
    max_samples: int | None = None,
    batch_size: int = SCORING_BATCH,
    threshold: float = THRESHOLD,
    options: CleaningOptions = CleaningOptions(),
    ledger: str | None = None,
) -> DataFrame:
    """Read, clean, score and store a comment table; returns the stored predictions.

    ``dataset`` is a CSV path when it ends in ``.csv``, else Parquet.  Nothing left
    after cleaning is an error, raised before a record of the run is written.  With a
    ``ledger``, a shared path, a run that failed is resumed by running the job again: texts
    whose scores are in the ledger are not scored again.
    """
    label = model_label(model_key, "transformer")
    read: Callable = read_comments_csv if dataset.endswith(".csv") else read_comments_parquet
    comments = clean(read(spark, dataset), options)
    if max_samples is not None:
        order = "ingest_order" if "ingest_order" in comments.columns else "comment_id"
        comments = first_rows(comments, max_samples, order)
    experiment = experiment or experiment_name(model_key)

    def from_ledger(rows: DataFrame) -> DataFrame:
        return score_with_ledger(
            rows, factory, model_key, ledger, "comment_id", batch_size=batch_size
        )

    scorer = from_ledger if ledger else None
    scored = score_comments(comments, factory, model_key, batch_size, threshold, scorer=scorer)
    rows = write_run(scored, root, experiment, dataset, model_key, label, options, threshold)
    if rows == 0:
        raise ValueError("no comments left after cleaning")
    return read_run(spark, root, experiment)


def benchmark(
    spark: SparkSession,
    runners: dict[str, Runner],
    train_path: str,
    test_path: str,
    output: str,
    max_test_samples: int | None = None,
    run_id: str | None = None,
    resume: bool = False,
) -> DataFrame:
    """Run models on a labelled test set, store per-model results and the summary.

    With ``resume`` and the ``run_id`` of a run that failed, models that had answered the same
    examples are not run again.
    """
    train, test = load_splits(spark, train_path, test_path, max_test_samples)
    folder = f"{output.rstrip('/')}/{run_id or format(datetime.now(), '%Y%m%d_%H%M%S')}"
    predictions, summary = run_models(
        runners, train, test, f"{folder}/predictions", resume=resume
    )
    rows = with_truth(predictions, test, list(runners)).persist()
    try:
        tables = {
            "emotions": (evaluate_emotions(rows, by=["model"]), emotion_labels(rows, by=["model"])),
            "sentiment": (evaluate_sentiment(rows, ["model"]), sentiment_labels(rows, ["model"])),
        }
        for task, (metrics, per_label) in tables.items():
            # All models are evaluated together; what is written per model is small.
            metrics, per_label = metrics.persist(), per_label.persist()
            for key in runners:
                own = [t.where(F.col("model") == key).drop("model") for t in (metrics, per_label)]
                write_evaluation(folder, key, task, *own)
            metrics.unpersist()
            per_label.unpersist()
    finally:
        rows.unpersist()
    write_benchmark(folder, summary)
    return summary
