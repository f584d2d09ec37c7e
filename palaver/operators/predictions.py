"""Analysis of predicted emotions and sentiment.

Label statistics start from counts per distinct label set: comments share few
label sets, so map-side combining leaves a table of a few thousand rows at most,
and everything that explodes labels or pairs works on that table, not on comments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.fixed import EMOTIONS, PREVIEW_ROWS, SCORE_BINS, SENTIMENTS
from palaver.functions.labels import decode, group_of, label_set, string_array
from palaver.functions.values import month_key, percent, ratio
from palaver.operators.common import bin_of, empty, single, top, value_counts
from palaver.operators.sampling import post_scores

ALL = "All"
_SENTIMENT_RANK = {name: rank for rank, name in enumerate(SENTIMENTS)}
_BIN_RANK = {label: rank for rank, (label, _, _) in enumerate(SCORE_BINS)}


def _labels(df: DataFrame) -> Column:
    """The label list, decoded from its storage form where no array is at hand."""
    return F.col("emotions") if "emotions" in df.columns else decode(F.col("predicted_emotions"))


def _rank(column: str, ranks: dict[str, int]) -> Column:
    entries = [F.lit(part) for pair in ranks.items() for part in pair]
    return F.element_at(F.create_map(*entries), F.col(column))


def label_sets(df: DataFrame, *keys: Column) -> DataFrame:
    """``(keys..., labels, n)``: comments per distinct label set."""
    return df.groupBy(*keys, label_set(_labels(df)).alias("labels")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _label_counts(sets: DataFrame) -> DataFrame:
    """``(emotion, comments)`` of observed labels.

    The outer form of explode adds no filter on the label set.  One would be pushed
    into the count per label set, which then could not be shared with the total.
    """
    exploded = sets.select(F.explode_outer("labels").alias("emotion"), "n")
    known = exploded.where(F.col("emotion").isNotNull())
    return known.groupBy("emotion").agg(F.sum("n").alias("comments"))


def _most_frequent(sets: DataFrame, n: int) -> Column:
    """The n most frequent labels as an array, most frequent first."""
    best = top(_label_counts(sets), n, F.desc("comments"), F.asc("emotion"))
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("comments")).alias("order"), F.col("emotion")))
    )
    return single(best.agg(F.transform(ranked, lambda entry: entry["emotion"]).alias("labels")))


def emotion_frequency(df: DataFrame, n: int = 28) -> DataFrame:
    """``(emotion, comments, share)`` of observed labels, most frequent first."""
    sets = label_sets(df)
    total = single(sets.agg(F.sum("n")))
    return top(_label_counts(sets), n, F.desc("comments"), F.asc("emotion")).withColumn(
        "share", ratio(F.col("comments"), total)
    )


def _vocabulary_counts(df: DataFrame) -> DataFrame:
    """``(emotion, comments, share)`` for all 28 labels, in vocabulary order.

    28 conditional counts in one global aggregate: zeros need no join.
    """
    labels = _labels(df)
    return _counted_shares(
        df, "emotion", [(name, F.array_contains(labels, name)) for name in EMOTIONS]
    )


def _counted_shares(df: DataFrame, name: str, cases: Sequence[tuple[str, Column]]) -> DataFrame:
    """Per case the comments that meet its test and their share of all comments."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(test).alias(f"_{i}") for i, (_, test) in enumerate(cases)],
    )
    entries = [
        F.struct(
            F.lit(label).alias(name),
            F.col(f"_{i}").alias("comments"),
            ratio(F.col(f"_{i}"), F.col("_n")).alias("share"),
        )
        for i, (label, _) in enumerate(cases)
    ]
    return counted.select(F.inline(F.array(*entries)))


def emotion_frequency_all(df: DataFrame) -> DataFrame:
    """All 28 labels, also those never predicted, most frequent first."""
    return top(_vocabulary_counts(df), len(EMOTIONS), F.desc("comments"), F.asc("emotion"))


def emotions_with_group(df: DataFrame) -> DataFrame:
    """All 28 labels with their sentiment group; ambiguous labels report as neutral."""
    grouped = _vocabulary_counts(df).withColumn("sentiment_group", group_of(F.col("emotion")))
    return top(
        grouped, len(EMOTIONS), F.asc("sentiment_group"), F.desc("comments"), F.asc("emotion")
    )


def group_hits(df: DataFrame) -> DataFrame:
    """``(sentiment_group, comments)``: label hits summed per sentiment group."""
    grouped = _vocabulary_counts(df).withColumn("sentiment_group", group_of(F.col("emotion")))
    return grouped.groupBy("sentiment_group").agg(F.sum("comments").alias("comments"))


def headline_emotions(df: DataFrame) -> DataFrame:
    """One row: comments scored, vocabulary labels seen, top label and its share."""
    sets = label_sets(df)
    total = single(sets.agg(F.coalesce(F.sum("n"), F.lit(0))))
    counts = _label_counts(sets)
    first = F.min_by("emotion", F.struct((-F.col("comments")).alias("c"), F.col("emotion")))
    return counts.agg(
        F.count_if(F.col("emotion").isin(*EMOTIONS)).alias("emotions_seen"),
        first.alias("top_emotion"),
        F.coalesce(F.max("comments"), F.lit(0)).alias("_top"),
    ).select(
        total.alias("comments_scored"),
        "emotions_seen",
        "top_emotion",
        ratio(F.col("_top"), total).alias("top_share"),
    )


def monthly_emotion_trend(
    df: DataFrame, emotions: Sequence[str] | None = None, n: int = 8
) -> DataFrame:
    """``(month, emotion, comments)`` for each observed month and selected label.

    Labels are the given ones, else the n most frequent over all comments.  Cells
    without a comment are 0.
    """
    if "comment_created_at" not in df.columns:
        return empty(df, "month string, emotion string, comments bigint")
    sets = label_sets(df, month_key(F.col("comment_created_at")).alias("month"))
    chosen = _most_frequent(sets, n) if emotions is None else string_array(list(emotions))
    # Every set meets every chosen label, so each observed month has each label.
    cells = sets.select("month", "labels", "n", F.explode_outer(chosen).alias("emotion"))
    cells = cells.where(F.col("emotion").isNotNull())
    hits = F.sum(F.when(F.array_contains("labels", F.col("emotion")), F.col("n")).otherwise(0))
    return (
        cells.groupBy("month", "emotion")
        .agg(hits.alias("comments"), F.count("month").alias("_dated"))
        .where(F.col("_dated") > 0)
        .drop("_dated")
        .orderBy("month", "emotion")
    )


def _month_share(trend: DataFrame) -> DataFrame:
    """Each row's part of its month's total; null when the total is 0."""
    total = F.sum("comments").over(Window.partitionBy("month"))
    return trend.withColumn(
        "share", F.try_divide(F.col("comments").cast("double"), total.cast("double"))
    )


def monthly_emotion_share(
    df: DataFrame, emotions: Sequence[str] | None = None, n: int = 8
) -> DataFrame:
    """The trend with each label's share of the *selected* labels in the month."""
    return _month_share(monthly_emotion_trend(df, emotions, n))


def emotion_cooccurrence(df: DataFrame, n: int = 20) -> DataFrame:
    """``(emotion_a, emotion_b, comments, pair)``: labels predicted together."""
    sets = label_sets(df).where(F.size("labels") > 1)
    first = sets.select("n", "labels", F.posexplode("labels").alias("at", "emotion_a"))
    pairs = first.select(
        "n",
        "emotion_a",
        F.explode(F.slice("labels", F.col("at") + 2, F.size("labels"))).alias("emotion_b"),
    )
    counts = pairs.groupBy("emotion_a", "emotion_b").agg(F.sum("n").alias("comments"))
    return top(
        counts, n, F.desc("comments"), F.asc("emotion_a"), F.asc("emotion_b")
    ).withColumn("pair", F.concat_ws(" + ", "emotion_a", "emotion_b"))


def emotion_cooccurrence_matrix(df: DataFrame, top_n: int = 12) -> DataFrame:
    """``(emotion_a, emotion_b, comments)``: symmetric over the top labels, zeros kept.

    The diagonal holds each label's own count.
    """
    sets = label_sets(df)
    axis = _most_frequent(sets, top_n)
    # Cut to the axis there are at most 2**top_n sets, however many labels were seen.
    cut = (
        sets.select(F.array_intersect("labels", axis).alias("labels"), "n")
        .groupBy("labels")
        .agg(F.sum("n").alias("n"))
    )
    cells = cut.select("n", "labels", axis.alias("axis"))
    cells = cells.select("n", "labels", "axis", F.explode_outer("axis").alias("emotion_a"))
    cells = cells.where(F.col("emotion_a").isNotNull())
    cells = cells.select("n", "labels", "emotion_a", F.explode("axis").alias("emotion_b"))
    both = F.array_contains("labels", F.col("emotion_a")) & F.array_contains(
        "labels", F.col("emotion_b")
    )
    return cells.groupBy("emotion_a", "emotion_b").agg(
        F.sum(F.when(both, F.col("n")).otherwise(0)).alias("comments")
    )


def matrix_wide(matrix: DataFrame, emotions: Sequence[str]) -> DataFrame:
    """One row and one column per label, in the given order."""
    order = F.array_position(string_array(list(emotions)), F.col("emotion"))
    return (
        matrix.groupBy(F.col("emotion_a").alias("emotion"))
        .pivot("emotion_b", list(emotions))
        .agg(F.sum("comments"))
        .na.fill(0)
        .orderBy(order)
    )


def labels_per_comment(df: DataFrame) -> DataFrame:
    """``(labels_per_comment, comments)`` on the stored form; no label counts as 1."""
    parts = F.size(F.split("predicted_emotions", "[|]"))
    return value_counts(
        df.where(F.col("predicted_emotions").isNotNull()).select(parts.alias("labels_per_comment")),
        "labels_per_comment",
        name="comments",
    ).orderBy("labels_per_comment")


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """``(sentiment, comments, share)``: always the three classes, in fixed order."""
    cases = [(name, F.col("predicted_sentiment") == name) for name in SENTIMENTS]
    return _counted_shares(df, "sentiment", cases)


def with_percent(df: DataFrame, digits: int, name: str = "share_pct") -> DataFrame:
    """Add the share as a rounded percentage, for display."""
    return df.withColumn(name, percent(F.col("share"), digits))


def rounded(df: DataFrame, digits: int = 4, columns: Sequence[str] = ("share",)) -> DataFrame:
    """Round shares for display; operators themselves return full precision."""
    return df.withColumns({name: F.round(name, digits) for name in columns})


def monthly_sentiment_trend(df: DataFrame) -> DataFrame:
    """``(month, predicted_sentiment, comments)``, observed cells only."""
    if "comment_created_at" not in df.columns:
        return empty(df, "month string, predicted_sentiment string, comments bigint")
    known = df.where(
        F.col("comment_created_at").isNotNull() & F.col("predicted_sentiment").isNotNull()
    )
    month = month_key(F.col("comment_created_at")).alias("month")
    return value_counts(
        known.select(month, "predicted_sentiment"),
        "month",
        "predicted_sentiment",
        name="comments",
    ).orderBy("month", "predicted_sentiment")


def monthly_sentiment_share(df: DataFrame) -> DataFrame:
    """The trend with each sentiment's share of its month."""
    return _month_share(monthly_sentiment_trend(df))


def monthly_sentiment_table(df: DataFrame) -> DataFrame:
    """``(month, negative, neutral, positive)``, zeros kept."""
    if "comment_created_at" not in df.columns:
        return empty(df, "month string, negative bigint, neutral bigint, positive bigint")
    return (
        df.where(F.col("comment_created_at").isNotNull())
        .groupBy(month_key(F.col("comment_created_at")).alias("month"))
        .agg(*_sentiment_columns())
        .orderBy("month")
    )


def _sentiment_columns() -> list[Column]:
    return [F.count_if(F.col("predicted_sentiment") == name).alias(name) for name in SENTIMENTS]


def sentiment_by_score_bucket(df: DataFrame) -> DataFrame:
    """``(score_bucket, negative, neutral, positive)`` for observed buckets."""
    if "comment_score" not in df.columns:
        return empty(df, "score_bucket string, negative bigint, neutral bigint, positive bigint")
    bucket = bin_of(F.col("comment_score"), SCORE_BINS)
    return top(
        df.groupBy(bucket.alias("score_bucket"))
        .agg(*_sentiment_columns())
        .where(F.col("score_bucket").isNotNull()),
        len(SCORE_BINS),
        _rank("score_bucket", _BIN_RANK),
    )


def _score_by_sentiment(df: DataFrame, column: str, *measures: Column) -> DataFrame:
    """Measures of a score per sentiment, from counts per distinct score.

    The first aggregate combines equal scores map-side, so a hot sentiment reaches
    its task as one row per distinct score.
    """
    scores = value_counts(
        df.where(F.col("predicted_sentiment").isNotNull()), "predicted_sentiment", column
    ).withColumnRenamed(column, "x")
    return scores.groupBy("predicted_sentiment").agg(*measures)


def _in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(
        F.asc_nulls_last(_rank("predicted_sentiment", _SENTIMENT_RANK)), "predicted_sentiment"
    )


def _measure(kind: str) -> Column:
    """A weighted measure over ``x`` with multiplicity ``copies``."""
    x, copies = F.col("x"), F.col("copies")
    known = F.coalesce(F.sum(F.when(x.isNotNull(), copies)), F.lit(0))
    return {
        "count": known,
        "mean": F.try_divide(F.sum(x * copies).cast("double"), known.cast("double")),
        "median": F.percentile(x, F.lit(0.5), copies),
        "min": F.min(x),
        "max": F.max(x),
    }[kind]


def avg_score_by_sentiment(df: DataFrame) -> DataFrame:
    """``(predicted_sentiment, mean_score, comments)``; comments with a score count."""
    if "comment_score" not in df.columns:
        return empty(df, "predicted_sentiment string, mean_score double, comments bigint")
    return _in_order(
        _score_by_sentiment(
            df,
            "comment_score",
            _measure("mean").alias("mean_score"),
            _measure("count").alias("comments"),
        )
    )


def score_spread_by_sentiment(df: DataFrame) -> DataFrame:
    """Min, max, mean and median comment score per sentiment that has scores."""
    if "comment_score" not in df.columns:
        return empty(
            df,
            "predicted_sentiment string, min_score bigint, max_score bigint, "
            "mean_score double, median_score double",
        )
    known = df.where(
        F.col("comment_score").isNotNull() & F.col("predicted_sentiment").isin(*SENTIMENTS)
    )
    return _in_order(
        _score_by_sentiment(
            known,
            "comment_score",
            *[_measure(k).alias(f"{k}_score") for k in ("min", "max", "mean", "median")],
        )
    )


def avg_post_score_by_sentiment(df: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """``(predicted_sentiment, mean_post_score, median_post_score, comments)``.

    Predictions without a score take it from ``posts``, the source table.  They are counted
    per post and sentiment before that join, so no post is hot in it.
    """
    if "post_score" not in df.columns and posts is not None:
        counted = value_counts(
            df.where(F.col("predicted_sentiment").isNotNull()), "predicted_sentiment", "post_id"
        )
        joined = counted.join(post_scores(posts), "post_id", "left")
        scores = joined.groupBy("predicted_sentiment", F.col("post_score").alias("x")).agg(
            F.sum("copies").alias("copies")
        )
        return _in_order(scores.groupBy("predicted_sentiment").agg(*_post_measures()))
    if "post_score" not in df.columns:
        return empty(
            df,
            "predicted_sentiment string, mean_post_score double, "
            "median_post_score double, comments bigint",
        )
    return _in_order(_score_by_sentiment(df, "post_score", *_post_measures()))


def _post_measures() -> list[Column]:
    return [
        _measure("mean").alias("mean_post_score"),
        _measure("median").alias("median_post_score"),
        _measure("count").alias("comments"),
    ]


def filter_predictions(
    df: DataFrame, sentiment: str | None = None, emotion: str | None = None
) -> DataFrame:
    """Rows of one sentiment and/or with one label; ``None`` or "All" does not filter."""
    if sentiment and sentiment != ALL:
        df = df.where(F.col("predicted_sentiment") == sentiment)
    if emotion and emotion != ALL:
        df = df.where(F.array_contains(_labels(df), emotion))
    return df


COMMENT_PREVIEW = (
    "post_title",
    "comment_body",
    "comment_score",
    "comment_author",
    "comment_length",
    "post_score",
    "comment_created_at",
)
PREDICTION_PREVIEW = (
    "comment_body",
    "predicted_emotions",
    "predicted_sentiment",
    "comment_score",
    "comment_author",
    "comment_created_at",
)


def preview(
    df: DataFrame,
    columns: Sequence[str] = COMMENT_PREVIEW,
    rows: int = PREVIEW_ROWS,
    order_by: Sequence[str] = ("comment_id",),
) -> DataFrame:
    """The first rows of the display columns the table has."""
    shown = [name for name in columns if name in df.columns]
    return top(df, rows, *[F.col(name) for name in order_by]).select(*shown)
