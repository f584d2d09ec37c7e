"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a cost for a key from a hash of shard and key, ``-ln(u) / weight``; the
key goes where the cost is least.  A shard's costs do not depend on the other shards, so
one more shard takes keys only into itself, and each shard's share is its weight's share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import fold

# Slices per shard for numbering its rows; a task numbers one slice at a time.
SLICES = 1024


def shard_costs(key: Column, weights: Sequence[float]) -> Column:
    """``array<struct<cost, shard>>`` of a key, one entry per shard."""
    text = key.cast("string")

    def cost(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), text), 11)
        unit = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct(
            (-F.log(unit) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")
        )

    return F.array(*[cost(shard, weight) for shard, weight in enumerate(weights)])


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key, from 0; equal costs go to the lower number.

    A null key has a shard of its own choosing like any other key.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("give at least one shard, and positive weights")
    return F.array_min(shard_costs(key, weights))["shard"]


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], name: str = "shard"
) -> DataFrame:
    """Add the shard of each row.  No shuffle; every other column stays.

    A column that already has the new name is replaced.  Repeated rows share a shard.
    """
    return df.withColumn(name, shard_of(F.col(key), weights))


def number_rows(
    rows: DataFrame, shard: str, order: Sequence[str], slices: int = SLICES
) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 inside each shard.

    A shard is cut into slices by a hash of its rows.  Rows are numbered inside a slice
    and raised by the rows of the slices before, so no task takes a whole shard.  Equal
    rows are counted before the shuffle, travel as one and are expanded at the end; they
    take neighbouring slots.  The table of slices has at most shards times ``slices`` rows
    and is broadcast for that reason.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    counted = counted.withColumn(
        "_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")
    )
    by_slice = Window.partitionBy(shard, "_slice").orderBy(*rows.columns)
    numbered = counted.withColumn(
        "_before",
        F.sum("_copies").over(by_slice.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_copies"),
    )
    # Taken from the numbered rows, so that both branches read one shuffle of one scan.
    totals = numbered.groupBy(shard, "_slice").agg(
        F.max(F.col("_before") + F.col("_copies")).alias("_rows")
    )
    earlier = Window.partitionBy(shard).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        F.col(shard).alias("_of"),
        F.col("_slice").alias("_from"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
    )
    # Null-safe, so that no filter for nulls makes the branches differ.
    same = F.col(shard).eqNullSafe(F.col("_of")) & F.col("_slice").eqNullSafe(F.col("_from"))
    placed = numbered.join(F.broadcast(starts), same)
    return placed.select(
        *rows.columns,
        F.explode(
            F.sequence(
                F.col("_start") + F.col("_before"),
                F.col("_start") + F.col("_before") + F.col("_copies") - 1,
            )
        ).alias("slot"),
    )


def shard_table(docs: DataFrame, shards: int, weights: Sequence[float] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every document.

    ``size`` is the UTF-8 length of the text plus 8 and ``text_crc32`` its unsigned
    checksum; a null text counts as empty.  ``grown_shard`` is the shard under one shard
    more, of the mean weight.  A null id is a key like any other.  Repeated rows share a
    shard and take a slot each.  Columns beyond ``doc_id`` and ``text`` are not read.
    """
    weights = list(weights or [1.0] * shards)
    grown = [*weights, sum(weights) / len(weights)]
    costs = shard_costs(F.col("doc_id"), grown)
    placed = docs.select(
        "doc_id",
        (F.octet_length(fold(F.col("text"))) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(fold(F.col("text"))).cast("bigint").alias("text_crc32"),
        F.array_min(F.slice(costs, 1, len(weights)))["shard"].alias("shard"),
        F.array_min(costs)["shard"].alias("grown_shard"),
    )
    numbered = number_rows(placed, "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
