"""Multi-label and sentiment metrics.

All metrics are sums over comments that depend only on the (truth, prediction)
pair of label sets.  So comments are first counted per distinct pair, combined
map-side, and every metric is a weighted sum over that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.fixed import EMOTIONS, SENTIMENTS
from palaver.functions.labels import label_set, sentiment_of, string_array
from palaver.functions.values import ratio
from palaver.operators.common import single

TRUTH, PREDICTED = "truth", "predicted"


def align(
    truth: DataFrame, predictions: DataFrame, key: str | Sequence[str] = "id"
) -> DataFrame:
    """Join ``(key, truth)`` with ``(key, predicted)``; both sides must match one to one.

    A key that is missing on a side, or null, raises, and so does one that a side repeats.
    Each side is grouped by key first, which shows repeats and spreads the join evenly.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def once(side: DataFrame, mark: str) -> DataFrame:
        others = [F.any_value(c).alias(c) for c in side.columns if c not in keys]
        return side.groupBy(*keys).agg(*others, F.count(F.lit(1)).alias(mark))

    both = once(truth, "_t").join(once(predictions, "_p"), keys, "full_outer")
    matched = F.coalesce((F.col("_t") == 1) & (F.col("_p") == 1), F.lit(False))
    at = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    message = F.concat(F.lit("truth and predictions do not match one to one at "), at)
    # Every column carries the check, so that no filter on one of them can skip it.
    return both.select(
        *[
            F.when(matched, F.col(c)).otherwise(F.raise_error(message)).alias(c)
            for c in both.columns
            if c not in ("_t", "_p")
        ]
    )


def pair_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., truth, predicted, n)``: comments per pair of label sets."""
    return df.groupBy(
        *by,
        label_set(F.col(TRUTH)).alias(TRUTH),
        label_set(F.col(PREDICTED)).alias(PREDICTED),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(
    pairs: DataFrame, vocabulary: Sequence[str] = EMOTIONS, by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., label_no, label, tp, fp, fn, support)`` over a fixed vocabulary.

    Labels outside the vocabulary are ignored; labels never used count as 0.
    """
    names = string_array(vocabulary)
    if not by:
        # A pair that weighs nothing keeps every label in the result of an empty table.
        none = string_array([])
        pairs = pairs.unionByName(
            pairs.sparkSession.range(1).select(
                none.alias(TRUTH), none.alias(PREDICTED), F.lit(0).cast("bigint").alias("n")
            )
        )
    cells = pairs.select(
        *by, TRUTH, PREDICTED, "n", F.posexplode(names).alias("label_no", "label")
    )
    actual = F.array_contains(TRUTH, F.col("label"))
    guessed = F.array_contains(PREDICTED, F.col("label"))

    def count(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    return cells.groupBy(*by, "label_no", "label").agg(
        count(actual & guessed).alias("tp"),
        count(~actual & guessed).alias("fp"),
        count(actual & ~guessed).alias("fn"),
        count(actual).alias("support"),
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(2 * precision * recall, precision + recall)


def per_label_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, precision, recall, f1, support)`` in vocabulary order."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.orderBy(*by, "label_no").select(
        *by,
        "label",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        "support",
    )


def _pooled(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro and micro F1, and the number of wrong cells, per model."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    # F1 scores are added in vocabulary order, so the sum never varies in its last digit.
    scores = F.transform(
        F.array_sort(
            F.collect_list(
                F.struct("label_no", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
            )
        ),
        lambda entry: entry["f1"],
    )
    total = F.aggregate(scores, F.lit(0.0), lambda acc, f1: acc + f1)
    return counts.groupBy(*by).agg(
        ratio(total, F.count(F.lit(1))).alias("macro_f1"),
        _f1(tp, fp, fn).alias("micro_f1"),
        (fp + fn).alias("wrong"),
    )


def _overlap(pairs: DataFrame, vocabulary: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Row count, subset matches, overlapping rows and mean Jaccard per model.

    Subset equality looks at the vocabulary only; overlap looks at the sets as given.
    """
    names = string_array(vocabulary)
    n = F.col("n")
    common, either = F.array_intersect(TRUTH, PREDICTED), F.array_union(TRUTH, PREDICTED)
    # Summed as decimals: exact, hence independent of the order of rows.
    jaccard = F.when(F.size(either) == 0, F.lit(1).cast("decimal(20,18)")).otherwise(
        (F.size(common) / F.greatest(F.size(either), F.lit(1))).cast("decimal(20,18)")
    )
    same = F.array_intersect(TRUTH, names) == F.array_intersect(PREDICTED, names)
    touches = (F.size(common) > 0) | (F.size(either) == 0)
    rows = F.sum("n")
    return pairs.groupBy(*by).agg(
        F.coalesce(rows, F.lit(0)).alias("n"),
        ratio(F.sum(F.when(same, n).otherwise(0)), rows).alias("accuracy"),
        ratio(F.sum(jaccard * n), rows).alias("mean_jaccard"),
        ratio(F.sum(F.when(touches, n).otherwise(0)), rows).alias("at_least_one_match"),
    )


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two tables of one row per model (or one row at all) side by side."""
    if by:
        return left.join(right, list(by), "inner")
    row = single(right.select(F.struct(*right.columns)))
    return left.withColumn("_row", row).select(*left.columns, "_row.*")


def sentiment_pairs(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pair counts of emotion sets as pair counts of one-element sentiment sets."""
    return pairs.groupBy(
        *by,
        F.array(sentiment_of(F.col(TRUTH))).alias(TRUTH),
        F.array(sentiment_of(F.col(PREDICTED))).alias(PREDICTED),
    ).agg(F.sum("n").alias("n"))


def _task_metrics(
    pairs: DataFrame, vocabulary: Sequence[str], by: Sequence[str], task: str
) -> DataFrame:
    pooled = _pooled(confusion_counts(pairs, vocabulary, by), by)
    overlap = _overlap(pairs, vocabulary, by)
    loss = ratio(F.col("wrong"), F.col("n") * len(vocabulary))
    return _beside(overlap, pooled, by).select(
        *by,
        F.lit(f"{task}_{len(vocabulary)}").alias("task"),
        "macro_f1",
        "micro_f1",
        "accuracy",
        loss.alias("hamming_loss"),
        "at_least_one_match",
        "mean_jaccard",
    )


def _emotion_metrics(
    pairs: DataFrame, vocabulary: Sequence[str], by: Sequence[str]
) -> DataFrame:
    return _task_metrics(pairs, vocabulary, by, "emotions")


def _sentiment_metrics(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    missing = F.lit(None).cast("double")
    return _task_metrics(sentiment_pairs(pairs, by), SENTIMENTS, by, "sentiment").withColumns(
        {"hamming_loss": missing, "at_least_one_match": missing, "mean_jaccard": missing}
    )


def evaluate_emotions(
    df: DataFrame, vocabulary: Sequence[str] = EMOTIONS, by: Sequence[str] = ()
) -> DataFrame:
    """One row per model: macro and micro F1, subset accuracy, Hamming loss, overlap.

    ``df`` holds ``truth`` and ``predicted`` label arrays, one row per comment.
    """
    return _emotion_metrics(pair_counts(df, by), vocabulary, by)


def evaluate_sentiment(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per model over the three sentiment classes; 0 on empty input."""
    return _sentiment_metrics(pair_counts(df, by), by)


def emotion_labels(
    df: DataFrame, vocabulary: Sequence[str] = EMOTIONS, by: Sequence[str] = ()
) -> DataFrame:
    """Per-label metrics of the emotion task."""
    return per_label_metrics(confusion_counts(pair_counts(df, by), vocabulary, by), by)


def sentiment_labels(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-label metrics of the sentiment task."""
    pairs = sentiment_pairs(pair_counts(df, by), by)
    return per_label_metrics(confusion_counts(pairs, SENTIMENTS, by), by)


def weakest_labels(metrics: DataFrame, n: int = len(EMOTIONS)) -> DataFrame:
    """Per-label metrics, lowest F1 first."""
    return metrics.orderBy(F.asc("f1"), F.asc("label")).limit(n)


def benchmark_summary(
    df: DataFrame, runtimes: DataFrame | None = None, digits: int | None = 4
) -> DataFrame:
    """One row per ``(model, model_label)`` with both tasks' headline metrics.

    ``df`` holds all models' rows; both tasks read the same pair counts.  ``runtimes`` is an
    optional ``(model, runtime_sec)``.
    """
    by = ["model", "model_label"]
    pairs = pair_counts(df, by)
    emotions = _emotion_metrics(pairs, EMOTIONS, by).select(
        *by,
        F.col("macro_f1").alias("emotion_macro_f1"),
        F.col("micro_f1").alias("emotion_micro_f1"),
        F.col("accuracy").alias("emotion_subset_accuracy"),
        F.col("at_least_one_match").alias("emotion_at_least_one_match"),
        F.col("mean_jaccard").alias("emotion_mean_jaccard"),
        F.col("hamming_loss").alias("emotion_hamming_loss"),
    )
    sentiment = _sentiment_metrics(pairs, by).select(
        *by,
        F.col("macro_f1").alias("sentiment_macro_f1"),
        F.col("micro_f1").alias("sentiment_micro_f1"),
        F.col("accuracy").alias("sentiment_accuracy"),
    )
    table = _beside(emotions, sentiment, by)
    if runtimes is None:
        table = table.withColumn("runtime_sec", F.lit(None).cast("double"))
    else:
        table = table.join(F.broadcast(runtimes), "model", "left")
    metrics = [c for c in table.columns if c.startswith(("emotion_", "sentiment_"))]
    if digits is not None:
        table = table.withColumns({c: F.round(c, digits) for c in metrics})
    return table.select(*by, "runtime_sec", *metrics)
