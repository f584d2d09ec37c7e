"""Comment cleaning: the filter pipeline and its funnel.

The steps run in a fixed order: deduplicate, drop bots, drop deleted, strip
URLs, drop empty, drop short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver import fixed
from palaver.functions import text as X
from palaver.functions.values import ratio
from palaver.operators.common import compute_once, first_per_key, input_order
from palaver.sources.comments import with_text_metrics


@dataclass(frozen=True)
class CleaningOptions:
    """Which steps run, and the minimum length (0 turns that step off)."""

    remove_automoderator: bool = True
    remove_deleted: bool = True
    strip_urls: bool = True
    remove_empty: bool = True
    min_comment_length: int = 0
    dedupe_comments: bool = True


def _with_body(df: DataFrame) -> DataFrame:
    return df.withColumn("comment_body", F.coalesce("comment_body", F.lit("")))


def is_bot(author: Column) -> Column:
    """Exact match with a bot name; a missing author is not a bot."""
    return F.coalesce(author.isin(*fixed.BOT_AUTHORS), F.lit(False))


def is_deleted(body: Column) -> Column:
    """The whole body is a deletion marker, up to case and outer whitespace."""
    return F.lower(X.strip(body)).isin(*fixed.DELETED_MARKERS)


def is_empty(body: Column) -> Column:
    """Nothing but whitespace."""
    return X.strip(body) == ""


def dedupe_comments(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of every comment id; missing ids count as one id."""
    return first_per_key(df, ["comment_id"], input_order(df, order_by))


def remove_bots(df: DataFrame) -> DataFrame:
    return df.where(~is_bot(F.col("comment_author")))


def remove_deleted(df: DataFrame) -> DataFrame:
    return df.where(~is_deleted(F.col("comment_body")))


def strip_body_urls(df: DataFrame) -> DataFrame:
    """Strip URLs from the body and refresh the text metrics."""
    stripped = compute_once(df, "comment_body", X.strip_urls(F.col("comment_body")))
    return with_text_metrics(stripped, collapsed=True)


def remove_empty(df: DataFrame) -> DataFrame:
    return df.where(~is_empty(F.col("comment_body")))


def remove_short(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("comment_length") >= n)


def clean(
    df: DataFrame,
    options: CleaningOptions = CleaningOptions(),
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The cleaning pipeline as one lazy plan with a single shuffle, on comment id.

    A missing body counts as empty, here and in the funnel.
    """
    df = _with_body(df)
    if options.dedupe_comments and "comment_id" in df.columns:
        df = dedupe_comments(df, order_by)
    if options.remove_automoderator and "comment_author" in df.columns:
        df = remove_bots(df)
    if options.remove_deleted:
        df = remove_deleted(df)
    if options.strip_urls:
        df = strip_body_urls(df)
    if options.remove_empty:
        df = remove_empty(df)
    if options.min_comment_length > 0:
        df = remove_short(df, options.min_comment_length)
    return df


def measure_bodies(df: DataFrame, options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """The cleaned bodies' metrics and ``body_kept`` in place of the bodies.

    For ``clean_measured``, where no text is wanted: rows are narrow before they are shuffled.
    A body is judged by itself, so this may also be done before rows are joined or copied.
    """
    df = _with_body(df)
    df = df.withColumn("body_kept", ~F.lit(options.remove_deleted) | ~is_deleted(F.col("comment_body")))
    df = strip_body_urls(df) if options.strip_urls else with_text_metrics(df)
    kept = F.col("body_kept")
    if options.remove_empty:
        kept = kept & ~is_empty(F.col("comment_body"))
    if options.min_comment_length > 0:
        kept = kept & (F.col("comment_length") >= options.min_comment_length)
    return df.withColumn("body_kept", kept).drop("comment_body")


def clean_measured(
    df: DataFrame,
    options: CleaningOptions = CleaningOptions(),
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``clean`` without their bodies, from rows of ``measure_bodies``."""
    if options.dedupe_comments and "comment_id" in df.columns:
        df = dedupe_comments(df, order_by)
    if options.remove_automoderator and "comment_author" in df.columns:
        df = remove_bots(df)
    return df.where("body_kept").drop("body_kept")


def cleaning_funnel(
    df: DataFrame,
    options: CleaningOptions = CleaningOptions(),
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """``(step_no, step, rows)`` after every enabled step, from one pass.

    Each row is reduced, next to the scan, to the number of the step that would
    drop it.  Only that number travels with the comment id; no text is shuffled.
    """
    survives = 99
    df = _with_body(df)
    order = input_order(df, order_by)
    body = F.col("comment_body")
    if options.strip_urls:
        df = compute_once(df, "_text", X.strip_urls(body))
        text, length = F.col("_text"), F.length("_text")
    else:
        text, length = body, F.col("comment_length")

    dedupe = options.dedupe_comments and "comment_id" in df.columns
    steps: list[tuple[str, int]] = []
    tests: list[tuple[int, Column]] = []
    if options.remove_automoderator and "comment_author" in df.columns:
        steps.append((fixed.FUNNEL_BOTS, 1))
        tests.append((1, is_bot(F.col("comment_author"))))
    if options.remove_deleted:
        steps.append((fixed.FUNNEL_DELETED, 2))
        tests.append((2, is_deleted(body)))
    if options.strip_urls:
        steps.append((fixed.FUNNEL_URLS, 2))
    if options.remove_empty:
        steps.append((fixed.FUNNEL_EMPTY, 3))
        tests.append((3, is_empty(text)))
    if options.min_comment_length > 0:
        label = fixed.FUNNEL_MIN_LENGTH.format(n=options.min_comment_length)
        steps.append((label, 4))
        tests.append((4, F.coalesce(length < options.min_comment_length, F.lit(True))))
    steps.append((fixed.FUNNEL_FINAL, 4))

    dropped_at = F.coalesce(*[F.when(test, at) for at, test in tests], F.lit(survives))
    key = F.col("comment_id") if dedupe else F.lit(None)
    staged = df.select(
        key.alias("_key"),
        (order[0] if len(order) == 1 else F.struct(*order)).alias("_order"),
        dropped_at.alias("_dropped_at"),
    )
    if dedupe:
        kept = staged.groupBy("_key").agg(
            F.count(F.lit(1)).alias("_copies"),
            F.min_by("_dropped_at", "_order").alias("_dropped_at"),
        )
        raw = F.coalesce(F.sum("_copies"), F.lit(0))
        steps.insert(0, (fixed.FUNNEL_DEDUPE, 0))
    else:
        kept, raw = staged, F.count(F.lit(1))

    counted = kept.agg(
        raw.alias("_raw"),
        *[F.count_if(F.col("_dropped_at") > at).alias(f"_{i}") for i, (_, at) in enumerate(steps)],
    )
    rows = [("_raw", fixed.FUNNEL_RAW)] + [(f"_{i}", label) for i, (label, _) in enumerate(steps)]
    entries = [
        F.struct(
            F.lit(no).alias("step_no"), F.lit(label).alias("step"), F.col(name).alias("rows")
        )
        for no, (name, label) in enumerate(rows)
    ]
    return counted.select(F.inline(F.array(*entries)))


def removed_rows(funnel: DataFrame) -> DataFrame:
    """``(raw_rows, clean_rows, removed, removed_pct)``; the percentage is 0 for no rows."""
    raw = F.max(F.when(F.col("step") == fixed.FUNNEL_RAW, F.col("rows")))
    final = F.max(F.when(F.col("step") == fixed.FUNNEL_FINAL, F.col("rows")))
    return funnel.agg(raw.alias("raw_rows"), final.alias("clean_rows")).select(
        "raw_rows",
        "clean_rows",
        (F.col("raw_rows") - F.col("clean_rows")).alias("removed"),
        (ratio(F.col("raw_rows") - F.col("clean_rows"), F.col("raw_rows")) * 100).alias(
            "removed_pct"
        ),
    )
