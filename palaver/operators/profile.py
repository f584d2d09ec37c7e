"""Profile of a comment table: summary, volume, distributions, authors, posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.fixed import AUTOMOD_AUTHOR, HISTOGRAM_BINS, LENGTH_BINS, SCORE_BINS
from palaver.functions.values import month_key, ratio, weekday_name
from palaver.operators.common import (
    bin_tests,
    empty,
    first_value,
    input_order,
    single,
    tally,
    top,
    value_counts,
)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row with the 14 headline figures; means and medians are 0 without rows.

    Four grouping sets (length, words, post, author) share one scan and one
    shuffle.  Distinct counts and exact medians are then read off the distinct
    values, so no task ever sees the rows behind a popular value.
    """
    have = set(df.columns)

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    narrow = df.select(
        column("comment_length", "bigint").alias("length"),
        column("comment_word_count", "bigint").alias("words"),
        column("post_id", "string").alias("post"),
        column("comment_author", "string").alias("author"),
        column("post_created_at", "timestamp_ntz").alias("post_at"),
        column("comment_created_at", "timestamp_ntz").alias("comment_at"),
        column("post_score", "bigint").alias("post_score"),
        column("comment_score", "bigint").alias("comment_score"),
    )
    sets = [[F.col(name)] for name in ("length", "words", "post", "author")]
    parts = narrow.groupingSets(sets, "length", "words", "post", "author").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.min("post_at").alias("post_start"),
        F.max("post_at").alias("post_end"),
        F.min("comment_at").alias("comment_start"),
        F.max("comment_at").alias("comment_end"),
        F.sum("post_score").alias("post_sum"),
        F.count("post_score").alias("post_n"),
        F.sum("comment_score").alias("comment_sum"),
        F.count("comment_score").alias("comment_n"),
    )
    by_length = F.col("level") == 0b0111
    by_words = F.col("level") == 0b1011
    by_post = (F.col("level") == 0b1101) & F.col("post").isNotNull()
    by_author = (F.col("level") == 0b1110) & F.col("author").isNotNull()

    def over(test: Column, value: str) -> Column:
        return F.when(test, F.col(value))

    def median(test: Column, value: str, weight: Column) -> Column:
        return F.coalesce(
            F.percentile(over(test, value), F.lit(0.5), F.when(test, weight).otherwise(0)),
            F.lit(0.0),
        )

    def mean(total: Column, count: Column) -> Column:
        return ratio(F.sum(total), F.sum(count))

    rows = F.sum(over(by_length, "n"))
    automod = F.sum(over(by_author & (F.col("author") == AUTOMOD_AUTHOR), "n"))
    return parts.agg(
        F.coalesce(rows, F.lit(0)).alias("comments"),
        F.count_if(by_post).alias("posts"),
        F.count_if(by_author).alias("authors"),
        F.min("post_start").alias("post_start"),
        F.max("post_end").alias("post_end"),
        F.min("comment_start").alias("comment_start"),
        F.max("comment_end").alias("comment_end"),
        median(by_length, "length", F.col("n")).alias("median_comment_length"),
        mean(over(by_length, "length") * F.col("n"), over(by_length, "n")).alias(
            "mean_comment_length"
        ),
        median(by_words, "words", F.col("n")).alias("median_words"),
        median(by_post, "n", F.lit(1)).alias("median_comments_per_post"),
        mean(over(by_length, "post_sum"), over(by_length, "post_n")).alias("mean_post_score"),
        mean(over(by_length, "comment_sum"), over(by_length, "comment_n")).alias(
            "mean_comment_score"
        ),
        ratio(automod, rows).alias("automod_share"),
    )


def monthly_volume(df: DataFrame) -> DataFrame:
    """``(month, comments, posts)``: comments with an id and distinct posts per month."""
    if "comment_created_at" not in df.columns:
        return empty(df, "month string, comments bigint, posts bigint")
    # Per (month, post) first: the distinct count becomes a plain count, and a hot
    # month is combined before any shuffle.
    per_post = (
        df.where(F.col("comment_created_at").isNotNull())
        .groupBy(month_key(F.col("comment_created_at")).alias("month"), "post_id")
        .agg(F.count("comment_id").alias("comments"))
    )
    return (
        per_post.groupBy("month")
        .agg(F.sum("comments").alias("comments"), F.count("post_id").alias("posts"))
        .orderBy("month")
    )


def weekday_volume(df: DataFrame) -> DataFrame:
    """``(weekday, comments)``, Monday first; a day without comments is absent."""
    if "comment_created_at" not in df.columns:
        return empty(df, "weekday string, comments bigint")
    day = F.weekday("comment_created_at")
    return (
        df.where(F.col("comment_created_at").isNotNull())
        .groupBy(day.alias("_day"))
        .agg(F.count("comment_id").alias("comments"))
        .orderBy("_day")
        .select(weekday_name(F.col("_day")).alias("weekday"), "comments")
    )


def length_bins(df: DataFrame) -> DataFrame:
    """``(bin, count)`` of comment length; longer than 10 000 is left out."""
    return tally(df, "bin", "count", bin_tests(F.col("comment_length"), LENGTH_BINS))


def score_bins(df: DataFrame) -> DataFrame:
    """``(bin, count)`` of comment score; outside (-100, 1000] is left out."""
    if "comment_score" not in df.columns:
        return empty(df, "bin string, count bigint")
    return tally(df, "bin", "count", bin_tests(F.col("comment_score"), SCORE_BINS))


def length_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, bin_start, bin_end, count)``: equal widths over [min, max], last bin closed.

    Range and bins both come from the counts per distinct length, so the text is
    scanned once.  If all lengths agree the range is widened by a half each way.
    """
    # Doubled lengths keep the half-unit widening in integers.
    lengths = value_counts(
        df.where(F.col("comment_length").isNotNull()).select(
            (F.col("comment_length").cast("bigint") * 2).alias("x")
        ),
        "x",
    )
    # The total keeps the counts in this branch of the plan, so that both branches
    # are the same up to the shuffle and Spark runs it once.
    limits = lengths.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("copies").alias("n"))
    widen = (F.col("lo") == F.col("hi")).cast("bigint")
    limits = limits.select(
        F.struct((F.col("lo") - widen).alias("lo"), (F.col("hi") + widen).alias("hi"), "n")
    )
    limit = single(limits)
    position = F.least(
        F.call_function(
            "div",
            (F.col("x") - limit["lo"]) * bins,
            limit["hi"] - limit["lo"],
        ),
        F.lit(bins - 1),
    )
    counted = lengths.select("copies", position.alias("at")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("at") == i, F.col("copies"))), F.lit(0)).alias(f"_{i}")
            for i in range(bins)
        ]
    )
    counted = counted.withColumn("range", limit).where(F.col("range.n") > 0)
    entries = F.array(
        *[F.struct(F.lit(i).alias("bin"), F.col(f"_{i}").alias("count")) for i in range(bins)]
    )
    width = (F.col("range.hi") - F.col("range.lo")) / F.lit(2.0 * bins)
    start = F.col("range.lo") / F.lit(2.0)
    return counted.select("range", F.inline(entries)).select(
        "bin",
        (start + F.col("bin") * width).alias("bin_start"),
        (start + (F.col("bin") + 1) * width).alias("bin_end"),
        "count",
    )


def top_authors(df: DataFrame, n: int = 15) -> DataFrame:
    """``(comment_author, comments, mean_score)``, most comments first."""
    if "comment_author" not in df.columns:
        return empty(df, "comment_author string, comments bigint, mean_score double")
    authors = (
        df.where(F.col("comment_author").isNotNull())
        .groupBy("comment_author")
        .agg(F.count("comment_id").alias("comments"), F.avg("comment_score").alias("mean_score"))
    )
    return top(authors, n, F.desc("comments"), F.asc("comment_author"))


def post_stats(df: DataFrame) -> DataFrame:
    """``(post_id, post_score, comments)`` for every post with an id.

    Should rows disagree on a post's score, the first one in input order that has one
    counts.
    """
    score = first_value("post_score", input_order(df), known=True)
    return (
        df.where(F.col("post_id").isNotNull())
        .groupBy("post_id")
        .agg(score.alias("post_score"), F.count("comment_id").alias("comments"))
    )


def top_posts(df: DataFrame, n: int = 10) -> DataFrame:
    """``(post_id, post_title, comments, post_score)``, most comments first.

    The score is the first one in input order that the post's rows have.
    """
    score = first_value("post_score", input_order(df), known=True)
    posts = (
        df.where(F.col("post_id").isNotNull() & F.col("post_title").isNotNull())
        .groupBy("post_id", "post_title")
        .agg(F.count("comment_id").alias("comments"), score.alias("post_score"))
    )
    return top(posts, n, F.desc("comments"), F.asc("post_id"), F.asc("post_title"))
