"""Seeded samples, weekly quotas, per-post caps and post-comment assembly.

Every random choice is an order by ``md5(id || seed)``: repeatable, independent of
partitioning, and the same in any engine that has MD5.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.fixed import COMMENTS_PER_POST, SCATTER_POINTS, SEED, TARGET_POSTS, VISUAL_HINTS
from palaver.operators.common import (
    first_per_key,
    first_value,
    input_order,
    limit_per_key,
    single,
    top,
    value_counts,
)
from palaver.operators.skew import join_unique

# Samples up to this many rows are drawn by one heap per partition.
HEAP_ROWS = 100_000
_DIGITS = 4


def shuffle_key(id_column: str, seed: int) -> Column:
    """Pseudo-random position of a row; a missing id counts as empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.md5(F.concat(text, F.lit(str(seed))))


def seeded_sample(df: DataFrame, id_column: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows at random, or all rows when there are no more than n.

    Rows without an id take part; ties fall to a hash of the row.  A small sample is one
    pass with a heap of n rows per partition.  A large one would bring too many rows to
    one task: its rows are first counted per leading hash digits, which needs the ids
    alone; groups that the sample takes whole are filtered where they are, and only the
    one group in which it ends is ranked.
    """
    place = shuffle_key(id_column, seed)
    order = [place, F.col(id_column), F.xxhash64(*df.columns)]
    if n <= HEAP_ROWS:
        return top(df, n, *order)
    start = F.substring(place, 1, _DIGITS)
    counts = df.select(start.alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    # At most 16**_DIGITS rows, whatever the size of the table.
    reached = counts.select(
        "start", "n", F.sum("n").over(Window.orderBy("start")).alias("so_far")
    )
    ends = reached.where(F.col("so_far") >= n).orderBy("start").limit(1)
    last = F.coalesce(single(ends.select("start")), F.lit("g"))
    wanted = n - single(ends.select(F.col("so_far") - F.col("n")))
    rank = F.row_number().over(Window.orderBy(*order))
    ended = df.where(start == last).withColumn("_rank", rank)
    return df.where(start < last).unionByName(
        ended.where(F.col("_rank") <= wanted).drop("_rank")
    )


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an explicit order."""
    return top(df, n, *[F.col(name) for name in order])


def scatter_points(
    df: DataFrame,
    id_column: str = "comment_id",
    max_points: int = SCATTER_POINTS,
    seed: int = SEED,
) -> DataFrame:
    """Rows with a post score and a sentiment, sampled down to ``max_points``."""
    known = df.where(F.col("post_score").isNotNull() & F.col("predicted_sentiment").isNotNull())
    return seeded_sample(known, id_column, max_points, seed)


def visual_posts(posts: DataFrame, hints: Sequence[str] = VISUAL_HINTS) -> DataFrame:
    """Posts whose hint is one of the visual kinds."""
    return posts.where(F.col("post_hint").isin(*hints))


WEEK = timedelta(days=7)


def _instant(moment: datetime) -> Column:
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")


def week_count(start: datetime, end: datetime) -> int:
    """Number of 7-day slices from start to end, the last one possibly short."""
    return -(-(end - start) // WEEK)


def week_of(timestamp: Column, start: datetime) -> Column:
    """Index of the 7-day slice a time falls into."""
    days = F.extract(F.lit("DAY"), timestamp - _instant(start))
    return F.floor(days / WEEK.days).cast("int")


def weekly_sample(
    posts: DataFrame,
    start: datetime,
    end: datetime,
    target: int = TARGET_POSTS,
    hints: Sequence[str] | None = VISUAL_HINTS,
    seed: int = SEED,
) -> DataFrame:
    """Sample posts evenly over the weeks of a period.

    ``posts`` needs ``post_id``, ``post_created_at`` and, for a hint filter,
    ``post_hint``.  A post id counts once, in its earliest week.  Each week gives
    ``target // weeks`` posts and the first ``target % weeks`` weeks one more.

    Copies of a post id at one time count as the one whose row has the least hash.

    A period has few weeks, so ranking by week would bring a week's posts to one task.  A
    week's posts are counted per leading hash digits instead, which shows in which group of
    digits its quota ends.  Groups before that one are taken where they are; of that one the
    first posts are, and each task hands on no more of them than the quota.
    """
    weeks = week_count(start, end)
    base, extra = divmod(target, weeks)
    created = F.col("post_created_at")
    inside = posts.where(
        F.col("post_id").isNotNull()
        & (created >= _instant(start))
        & (created < _instant(end))
    )
    if hints is not None:
        inside = visual_posts(inside, hints)
    placed = (
        inside.transform(
            first_per_key,
            ["post_id"],
            [F.col("post_created_at"), F.xxhash64(*inside.columns)],
        )
        .withColumn("week", week_of(created, start))
        .withColumn("_place", shuffle_key("post_id", seed))
        .withColumn("_start", F.substring("_place", 1, _DIGITS))
    )
    quota = F.when(F.col("week") < extra, base + 1).otherwise(base)
    # At most 16**_DIGITS rows a week.
    so_far = F.sum("n").over(Window.partitionBy("week").orderBy("_start"))
    reached = value_counts(placed, "week", "_start", name="n").withColumn("so_far", so_far)
    crossing = F.col("so_far").between(quota, quota + F.col("n") - 1)
    ends = reached.where(crossing).select(
        F.col("week").alias("_week"),
        F.col("_start").alias("_last"),
        (quota - F.col("so_far") + F.col("n")).alias("_wanted"),
    )
    # One row a week, and the period says how many weeks there are.
    judged = placed.where(quota > 0).join(
        F.broadcast(ends), F.col("week") == F.col("_week"), "left"
    )
    # A week without an end has fewer posts than its quota.
    whole = F.col("_last").isNull() | (F.col("_start") < F.col("_last"))
    rank = F.row_number().over(Window.partitionBy("week").orderBy("_place", "post_id"))
    ended = judged.where(F.col("_start") == F.col("_last")).withColumn("_rank", rank)
    ended = ended.where((F.col("_rank") <= base + 1) & (F.col("_rank") <= F.col("_wanted")))
    return judged.where(whole).unionByName(ended.drop("_rank")).select(*posts.columns, "week")


def cap_comments(comments: DataFrame, limit: int = COMMENTS_PER_POST) -> DataFrame:
    """At most ``limit`` comments per post, best score first, then by id."""
    order = [F.desc_nulls_last("comment_score"), F.col("comment_id")]
    return limit_per_key(comments, ["post_id"], order, limit)


def assemble(
    posts: DataFrame,
    comments: DataFrame,
    limit: int = COMMENTS_PER_POST,
    period: str | None = None,
    subreddit: str | None = None,
    max_posts: int | None = None,
) -> DataFrame:
    """One row per (post, comment): post columns repeated, posts without comments gone.

    Comments are capped before the join, so no post brings more than ``limit``
    rows to it.  With ``max_posts``, comments of other posts are dropped before they
    are ranked; Spark broadcasts the posts' ids if they prove few.
    """
    if max_posts is not None:
        comments = comments.join(posts.select("post_id"), "post_id", "left_semi")
    rows = posts.join(cap_comments(comments, limit), "post_id", "inner")
    if "post_selftext" in posts.columns:
        rows = rows.withColumn("post_selftext", F.coalesce("post_selftext", F.lit("")))
    if period is not None:
        rows = rows.withColumn("period", F.lit(period))
    if subreddit is not None:
        rows = rows.withColumn("subreddit", F.lit(subreddit))
    return rows


def attach_post_scores(
    predictions: DataFrame, posts: DataFrame, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Add ``post_score`` from the source table, unless it is there or cannot be.

    The source may repeat a post once per comment.  Its first row in the given order, or
    else in input order, counts.  A post with a huge share of the predictions is salted.
    """
    if not _can_attach(predictions, posts):
        return predictions
    return join_unique(predictions, post_scores(posts, order_by), "post_id", spread_by="comment_id")


def _can_attach(predictions: DataFrame, posts: DataFrame) -> bool:
    return (
        "post_score" not in predictions.columns
        and "post_id" in predictions.columns
        and {"post_id", "post_score"} <= set(posts.columns)
    )


def post_scores(posts: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """``(post_id, post_score)``: the score in each post's first row."""
    score = first_value("post_score", input_order(posts, order_by))
    known = posts.where(F.col("post_id").isNotNull())
    return known.groupBy("post_id").agg(score.alias("post_score"))
