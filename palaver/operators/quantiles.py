"""Exact quantiles of a column whose distinct values do not fit a task.

Each round counts the rows of every group by bins and keeps the one bin that holds the wanted
rank.  Bins rise with the values, so the rank inside a bin is the rank less the rows of lower
bins.  The first round bins by sign and magnitude, the others by equal steps between a bin's
least and largest value.  When a bin holds few rows, or one value only, the rank is read off.
So a task holds a group's bins or a bin's few rows, never a group's distinct values.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators.common import empty
from palaver.session import shared_folder

# Bins of a round, and rows of a bin that are sorted at last.
BINS, SORTED_ROWS = 4096, 100_000
# Ranges of targets that are broadcast; more are joined.
BROADCAST_RANGES = 100_000


def _magnitude(x: Column) -> Column:
    """A whole number that rises with x: its sign and binary exponent."""
    power = F.floor(F.log2(F.abs(x))) + 1100
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(
        F.signum(x).cast("bigint") * power
    )


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for one, other in zip(left, right, strict=True):
        out = out & F.col(one).eqNullSafe(F.col(other))
    return out


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, f"{purpose}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored(df: DataFrame) -> DataFrame:
    return _written(df, "ranks")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float]
) -> DataFrame:
    """``(by..., n, q)`` per group: its rows with a value, and an array of the quantiles.

    Between two ranks the quantile is interpolated, as ``percentile`` does.  Null and NaN do
    not count; groups without a value are left out.  Groups may be null.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("x")
    ).where(F.col("x").isNotNull() & ~F.isnan("x"))
    # Every round reads the rows, so what they are derived from is worked out once.
    rows = _written(rows, "values")
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(q))).alias("at"))
            for i, q in enumerate(quantiles)
        ]
    )
    targets = totals.withColumn("t", F.explode(wanted)).select(
        *keys, "n", "lo", "hi", "t.i", "t.at",
        F.explode(F.array(F.floor("t.at"), F.ceil("t.at"))).alias("k"),
    )
    state = [*keys, "n", "i", "at", "k"]
    targets = targets.distinct().select(
        *state, "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.col("n").alias("inside")
    )
    targets = _stored(targets)
    if targets.isEmpty():
        kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
        return empty(df, ", ".join([*kinds, "n bigint", "q array<double>"]))
    first = True
    while True:
        wide = (F.col("inside") > SORTED_ROWS) & (F.col("lo") < F.col("hi"))
        if targets.where(wide).isEmpty():
            break
        held = _inside(rows, targets.where(wide), keys)
        step = F.least(
            F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS),
            F.lit(BINS - 1).cast("bigint"),
        )
        bin_ = _magnitude(F.col("x")) if first else step
        counted = held.groupBy(*keys, "lo", "hi", bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("x").alias("low"), F.max("x").alias("high")
        )
        lower = Window.partitionBy(*keys, "lo", "hi").orderBy("bin")
        lower = lower.rowsBetween(Window.unboundedPreceding, -1)
        summed = counted.select(
            *[F.col(k).alias(f"{k}_") for k in keys],
            F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "c", "low", "high",
            F.coalesce(F.sum("c").over(lower), F.lit(0)).alias("under"),
        )
        at = F.col("k") - F.col("before")
        narrowed = targets.where(wide).join(
            summed, _same([*keys, "lo", "hi"], [*[f"{k}_" for k in keys], "lo_", "hi_"])
        )
        narrowed = narrowed.where((F.col("under") <= at) & (at < F.col("under") + F.col("c")))
        narrowed = narrowed.select(
            *state, F.col("low").alias("lo"), F.col("high").alias("hi"),
            (F.col("before") + F.col("under")).alias("before"), F.col("c").alias("inside"),
        )
        targets = _stored(targets.where(~wide).unionByName(narrowed))
        first = False
    single = targets.where("lo = hi").select(*state, F.col("lo").alias("x"))
    rank = F.row_number().over(Window.partitionBy(*keys, "lo", "hi").orderBy("x")) - 1
    ranked = _inside(rows, targets.where("lo < hi"), keys).withColumn("r", rank)
    ranked = ranked.select(
        *[F.col(k).alias(f"{k}_") for k in keys], F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "r", "x"
    )
    read = targets.where("lo < hi").join(
        ranked,
        _same([*keys, "lo", "hi"], [*[f"{k}_" for k in keys], "lo_", "hi_"])
        & (F.col("k") - F.col("before") == F.col("r")),
    )
    found = single.unionByName(read.select(*state, "x"))
    low, high = F.min("x"), F.max("x")
    share = F.first("at") - F.floor(F.first("at"))
    each = found.groupBy(*keys, "n", "i").agg((low + (high - low) * share).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return each.groupBy(*keys, "n").agg(listed.alias("q")).select(
        *[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "q"
    )


def _inside(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the range of their group that they fall in; ranges of a group are disjoint."""
    ranges = targets.select(*[F.col(k).alias(f"{k}_") for k in keys], "lo", "hi").distinct()
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    near = _same(keys, [f"{k}_" for k in keys]) & F.col("x").between(F.col("lo"), F.col("hi"))
    return rows.join(ranges, near).select(*keys, "x", "lo", "hi")
