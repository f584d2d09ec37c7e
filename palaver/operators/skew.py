"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
KEYLESS_SALTS = 4096


def hot_keys(counts: DataFrame, key: str, copies: str, rows_per_task: int) -> DataFrame:
    """Keys with more rows than one task should take, and how many salts each needs.

    At most ``rows / rows_per_task`` keys can qualify, so the result is small by
    construction: a million keys for 10**12 rows.
    """
    return counts.where(F.col(copies) > rows_per_task).select(
        key, F.ceil(F.col(copies) / rows_per_task).cast("int").alias("_salts")
    )


def join_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join rows to a table that has at most one row per key.

    Hot keys get a salt: their left rows are spread by a hash of ``spread_by``
    over several sub-keys and only their right rows are repeated, once per salt.
    Rows without a key match nothing and are spread likewise; all other keys join as
    usual.  ``counts`` is ``(key, copies)`` when the caller
    has already counted the left keys; otherwise one narrow count is planned.
    The hot-key table is small; whether to broadcast it is left to Spark, which knows
    its size.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    hot = hot_keys(counts.where(F.col(key).isNotNull()), key, "copies", rows_per_task)
    salts = F.coalesce("_salts", F.lit(1))
    spread = F.when(F.col(key).isNull(), F.lit(KEYLESS_SALTS)).otherwise(salts)
    salted_left = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), spread).cast("int"))
        .drop("_salts")
    )
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
