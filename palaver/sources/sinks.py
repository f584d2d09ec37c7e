"""Writers and the run registry."""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palaver import schema
from palaver.fixed import THRESHOLD
from palaver.operators.cleaning import CleaningOptions

PREDICTIONS, RUNS = "predictions", "runs"
CSV_WRITE = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_run(
    predictions: DataFrame,
    root: str,
    experiment: str,
    dataset: str,
    model_key: str,
    model_label: str,
    options: CleaningOptions = CleaningOptions(),
    threshold: float = THRESHOLD,
) -> int:
    """Write one run's predictions and its metadata row; returns the rows written.

    Rows are counted while they are written.  Every attempt has a folder of its own, and
    the metadata row, written last, names it; the newest row of an experiment counts.  So
    a repeated run replaces its predecessor at once, and one that fails or has no rows
    leaves no record and changes nothing that can be read.
    """
    spark = predictions.sparkSession
    seen = Observation()
    started = time.perf_counter()
    counted = predictions.observe(seen, F.count(F.lit(1)).alias("rows"))
    folder = f"{PREDICTIONS}/experiment={experiment}/attempt={uuid.uuid4().hex}"
    counted.write.parquet(f"{root}/{folder}")
    rows = seen.get["rows"]
    if rows == 0:
        return 0
    record = (
        experiment,
        datetime.now(timezone.utc).replace(tzinfo=None),
        dataset,
        model_key,
        model_label,
        rows,
        round(time.perf_counter() - started, 2),
        tuple(asdict(options)[f.name] for f in schema.RUNS["cleaning"].dataType.fields),
        threshold,
        folder,
        RUNS,
    )
    spark.createDataFrame([record], schema.RUNS).coalesce(1).write.mode("append").json(
        f"{root}/{RUNS}"
    )
    return rows


def read_run(spark: SparkSession, root: str, experiment: str) -> DataFrame:
    """The predictions of an experiment's newest run; no other run is read."""
    run = run_metadata(spark, root).where(F.col("experiment") == experiment).first()
    if run is None:
        raise ValueError(f"no run of {experiment!r} below {root}")
    rows = spark.read.parquet(f"{root}/{run['predictions_file']}")
    return rows.withColumn("experiment", F.lit(experiment))


def run_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The newest metadata row of every run; none where nothing has run yet."""
    try:
        runs = spark.read.schema(schema.RUNS).json(f"{root}/{RUNS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        runs = spark.createDataFrame([], schema.RUNS)
    newest = F.max_by(F.struct(*runs.columns), "created_at_utc").alias("run")
    return runs.groupBy(F.col("experiment").alias("_e")).agg(newest).select("run.*")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs that have predictions, newest first; no prediction file is opened."""
    return run_metadata(spark, root).orderBy(F.desc("created_at_utc"), "experiment")


def write_evaluation(
    folder: str, model_key: str, task: str, summary: DataFrame, per_label: DataFrame
) -> None:
    """Per-class CSV and summary JSON of one model and task (``emotions``, ``sentiment``)."""
    base = f"{folder}/model={model_key}"
    export_csv(per_label.coalesce(1), f"{base}/{task}_per_class")
    known = [c for c in summary.columns if c != "task"]
    summary.select(*known).coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", False
    ).json(f"{base}/{task}_summary")


def write_benchmark(folder: str, summary: DataFrame) -> None:
    """The combined summary of all models."""
    export_csv(summary.coalesce(1), f"{folder}/benchmark_summary")


def export_csv(df: DataFrame, path: str) -> None:
    """Any result table as CSV with a header; arrays become joined text."""
    flat = [
        F.array_join(name, "|").alias(name) if kind == "array<string>" else F.col(name)
        for name, kind in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").options(**CSV_WRITE).csv(path)
