"""TF-IDF features and one independent logistic regression per label."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from palaver.fixed import EMOTIONS, MODELS, THRESHOLD, WORD_SET
from palaver.operators.common import single
from palaver.operators.evaluation import align, benchmark_summary
from palaver.operators.vocabulary import MAX_FEATURES, MIN_DOCUMENTS, frequent_terms

MAX_ITERATIONS = 1000
TOLERANCE = 1e-4
ROWS_PER_FIT_TASK = 5_000


def tfidf_weights(
    examples: DataFrame,
    text: str = "text",
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``(term, df, tf, idf)`` of the terms that count.

    Terms of at least ``min_documents`` texts, the ``max_features`` most frequent of them,
    ties by term; ``idf`` is ln((n+1)/(df+1)) + 1.  Most terms are too rare to count and are
    not shuffled; see ``vocabulary``.
    """
    return frequent_terms(examples, text, max_features, min_documents)


def fit_tfidf(
    examples: DataFrame,
    text: str = "text",
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
) -> PipelineModel:
    """Words and word pairs, weighted tf * (ln((n+1)/(df+1)) + 1), rows of unit length.

    The vocabulary, at most ``max_features`` terms, is all that reaches the driver.
    """
    terms = tfidf_weights(examples, text, max_features, min_documents).collect()
    if not terms:
        raise ValueError("no term occurs in enough texts")
    words = RegexTokenizer(
        inputCol=text,
        outputCol="_words",
        pattern=f"[{WORD_SET}]{{2,}}",
        gaps=False,
        toLowercase=True,
    )
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    grams = SQLTransformer(
        statement="SELECT *, concat(_words, _pairs) AS _grams FROM __THIS__"
    )
    counts = CountVectorizerModel.from_vocabulary(
        [row.term for row in terms], inputCol="_grams", outputCol="_counts"
    )
    weights = Vectors.dense([row.idf for row in terms])
    weighted = ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weighted")
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="features")
    tidy = SQLTransformer(
        statement="SELECT * EXCEPT (_words, _pairs, _grams, _counts, _weighted) FROM __THIS__"
    )
    return PipelineModel([words, pairs, grams, counts, weighted, unit, tidy])


@dataclass(frozen=True)
class LabelModels:
    """Fitted features and, per label, a model or a constant answer."""

    features: PipelineModel
    models: dict[str, LogisticRegressionModel | bool]

    def predict(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        """Append the predicted labels in vocabulary order.  Stays in the JVM."""
        out = self.features.transform(df)
        chosen = []
        for i, (label, model) in enumerate(self.models.items()):
            if isinstance(model, bool):
                if model:
                    chosen.append(F.lit(label))
                continue
            named = model.copy()
            named.setPredictionCol(f"_p{i}")
            named.setRawPredictionCol("").setProbabilityCol("")
            out = named.transform(out)
            chosen.append(F.when(F.col(f"_p{i}") == 1.0, label))
        labels = F.array_compact(F.array(*chosen)) if chosen else F.array().cast("array<string>")
        return out.withColumn(output, labels.cast("array<string>")).select(*df.columns, output)


def _without_summary(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """Drop the training summary, which ties the model to the session.

    Tasks receive the model; with its summary they would receive the session too,
    which cannot be serialized once the session has observed metrics.
    """
    nothing = SparkContext._active_spark_context._jvm.scala.Option.empty()
    model._java_obj.setSummary(nothing)
    return model


def fit_label_models(
    examples: DataFrame,
    vocabulary: Sequence[str] = EMOTIONS,
    text: str = "text",
    labels: str = "labels",
    c: float = 1.0,
    max_iterations: int = MAX_ITERATIONS,
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    parallel_fits: int = 8,
) -> LabelModels:
    """Fit one binary model per label; a label all or no examples have is constant.

    The penalty is C = ``c`` in the sum-of-losses convention.  Features are kept for
    the fits, which then only read them.
    """
    features = fit_tfidf(examples, text, max_features, min_documents)
    rows = features.transform(examples).select("features", labels)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = rows.agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.count_if(F.array_contains(labels, name)).alias(f"_{i}")
                for i, name in enumerate(vocabulary)
            ],
        ).first()
        n = totals["n"]
        # Every task returns a gradient as wide as the vocabulary, so tasks should not
        # be smaller than that is worth.
        packed = rows.coalesce(max(1, -(-n // ROWS_PER_FIT_TASK)))

        def fit(numbered: tuple[int, str]) -> LogisticRegressionModel | bool:
            i, name = numbered
            positive = totals[f"_{i}"]
            if positive in (0, n):
                return positive > 0
            # One estimator per fit, as they run side by side.
            learner = LogisticRegression(
                regParam=1.0 / (c * n),
                standardization=False,
                maxIter=max_iterations,
                tol=TOLERANCE,
                threshold=THRESHOLD,
            )
            target = F.array_contains(labels, name).cast("double").alias("label")
            return _without_summary(learner.fit(packed.select("features", target)))

        # The fits are independent; running several at once keeps executors busy
        # while another fit waits for its driver step.
        with ThreadPool(parallel_fits) as pool:
            fitted = pool.map(fit, enumerate(vocabulary))
    finally:
        rows.unpersist()
    return LabelModels(features, dict(zip(vocabulary, fitted)))


def optimality(
    fitted: LabelModels, examples: DataFrame, labels: str = "labels", c: float = 1.0
) -> DataFrame:
    """``(label, n, positives, constant, gradient)`` of models on the rows they were fitted on.

    ``gradient`` is the norm of the penalised loss's gradient, 0 for a constant model; near 0
    the fit is optimal.  Features are unpacked to arrays, so this is meant for small
    vocabularies.
    """
    rows = fitted.features.transform(examples).select("features", labels)
    n = rows.count()
    out = None
    for name, model in fitted.models.items():
        truth = F.array_contains(labels, name).cast("double")
        head = rows.agg(
            F.lit(name).alias("label"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.array_contains(labels, name)).alias("positives"),
            F.lit(isinstance(model, bool)).alias("constant"),
        )
        norm = F.lit(0.0)
        if not isinstance(model, bool):
            judged = model.transform(rows.withColumn("_truth", truth))
            error = F.get(vector_to_array("probability"), F.lit(1)) - F.col("_truth")
            cells = judged.select(
                error.alias("error"),
                F.posexplode(F.concat(vector_to_array("features"), F.array(F.lit(1.0)))),
            )
            # The last cell is the intercept, which carries no penalty.
            weights = F.lit([*map(float, model.coefficients.toArray()), 0.0])
            slopes = cells.groupBy("pos").agg((F.sum(F.col("error") * F.col("col")) / n).alias("s"))
            penalty = F.get(weights, F.col("pos")) / (c * n)
            norm = single(slopes.agg(F.sqrt(F.sum((F.col("s") + penalty) ** 2))))
        row = head.withColumn("gradient", norm)
        out = row if out is None else out.unionByName(row)
    return out


NOTE = "model string, mark string, seconds double"
# A runner takes (train, test) and returns test rows as (id, predicted).
Runner = Callable[[DataFrame, DataFrame], DataFrame]


def run_models(
    runners: dict[str, Runner],
    train: DataFrame,
    test: DataFrame,
    folder: str,
    labels: dict[str, str] | None = None,
    resume: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Run models one after another; returns their predictions and the summary table.

    ``runners`` maps model keys, usually ``fixed.DEFAULT_MODELS``, to functions.
    Each model's predictions are written below ``folder`` (a shared path) and read
    back, which both times the run and keeps a lost executor from redoing it.  A model that is
    done leaves a note of its time and of the examples' content; with ``resume``, models with
    a note of the same content are not run again.
    """
    spark = test.sparkSession
    labels = labels or {key: label for key, (label, _) in MODELS.items()}
    unknown = sorted(set(runners) - set(labels))
    if unknown:
        raise ValueError(f"unknown models: {unknown}; known models: {', '.join(labels)}")
    tables, seconds = [], []
    root = folder.rstrip("/")
    mark = f"{content_mark(train)} {content_mark(test)}"
    finished = _finished(spark, f"{root}/_finished", mark) if resume else {}
    for key, runner in runners.items():
        started = time.perf_counter()
        path = f"{root}/{key}"
        if key not in finished:
            runner(train, test).select("id", "predicted").write.mode("overwrite").parquet(path)
            finished[key] = round(time.perf_counter() - started, 2)
            note = spark.createDataFrame([(key, mark, finished[key])], NOTE)
            note.coalesce(1).write.mode("append").parquet(f"{root}/_finished")
        seconds.append((key, finished[key]))
        tables.append(
            spark.read.parquet(path).select(
                F.lit(key).alias("model"), F.lit(labels[key]).alias("model_label"), "id", "predicted"
            )
        )
    predictions = tables[0]
    for table in tables[1:]:
        predictions = predictions.unionByName(table)
    judged = with_truth(predictions, test, list(runners))
    runtimes = spark.createDataFrame(seconds, "model string, runtime_sec double")
    return predictions, benchmark_summary(judged, runtimes)


def content_mark(df: DataFrame) -> str:
    """Number of rows and a checksum of them, in any order; equal for equal rows."""
    hashed = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(hashed.cast("decimal(38, 0)"))).first()
    return " ".join(map(str, row))


def _finished(spark: SparkSession, path: str, mark: str) -> dict[str, float]:
    """Models that have answered examples of that content, with the last time it took."""
    # An empty append makes sure the folder exists; it adds no note.
    spark.createDataFrame([], NOTE).write.mode("append").parquet(path)
    notes = spark.read.schema(NOTE).parquet(path).where(F.col("mark") == mark)
    return {r["model"]: r["seconds"] for r in notes.collect()}


def with_truth(predictions: DataFrame, test: DataFrame, models: Sequence[str]) -> DataFrame:
    """Predictions of several models with the labels of their examples.

    Every model of the list must answer every example once; anything else raises, so that
    an incomplete run cannot pass for a good one.
    """
    named = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    truth = test.select("id", F.col("labels").alias("truth"), named)
    return align(truth, predictions, ["model", "id"])
