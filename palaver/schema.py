"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

COMMENTS = T.StructType(
    [
        T.StructField("period", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("post_title", T.StringType()),
        T.StructField("post_url", T.StringType()),
        T.StructField("post_hint", T.StringType()),
        T.StructField("post_score", T.LongType()),
        T.StructField("post_num_comments", T.LongType()),
        T.StructField("post_created_utc", T.DoubleType()),
        T.StructField("post_selftext", T.StringType()),
        T.StructField("comment_id", T.StringType()),
        T.StructField("comment_body", T.StringType()),
        T.StructField("comment_score", T.LongType()),
        T.StructField("comment_author", T.StringType()),
        T.StructField("comment_created_utc", T.DoubleType()),
    ]
)

# Column order of a scored comment, shared by the scorer and the CSV reader.
PREDICTION_COLUMNS = (
    "comment_id",
    "post_id",
    "comment_body",
    "comment_score",
    "comment_author",
    "comment_created_at",
    "post_score",
    "subreddit",
    "predicted_emotions",
    "predicted_sentiment",
    "model_key",
    "model_label",
)

PREDICTIONS_CSV = T.StructType(
    [
        T.StructField(
            name,
            T.LongType() if name in ("comment_score", "post_score") else T.StringType(),
        )
        for name in PREDICTION_COLUMNS
    ]
)

EXAMPLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("created_at_utc", T.TimestampNTZType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("model_key", T.StringType()),
        T.StructField("model_label", T.StringType()),
        T.StructField("comments_scored", T.LongType()),
        T.StructField("runtime_sec", T.DoubleType()),
        T.StructField(
            "cleaning",
            T.StructType(
                [
                    T.StructField("remove_automoderator", T.BooleanType()),
                    T.StructField("remove_deleted", T.BooleanType()),
                    T.StructField("strip_urls", T.BooleanType()),
                    T.StructField("remove_empty", T.BooleanType()),
                    T.StructField("min_comment_length", T.LongType()),
                    T.StructField("dedupe_comments", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("predictions_file", T.StringType()),
        T.StructField("metadata_file", T.StringType()),
    ]
)
