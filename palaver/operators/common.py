"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one task of a scan may work on, however few tasks there are.
TASK_ROWS = 10_000


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a costly column that is evaluated exactly once per row.

    A filter on a projected column is pushed below the projection, where the
    optimizer repeats the column's expression.  It is not pushed below a generator,
    so the value goes through one that yields a single row.
    """
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The same rows, dealt by the key where few tasks of the scan hold most of them.

    A file of one row group is read by one task, which would also do all work next to the scan.
    Counting rows reads no column.  A later join or grouping by the key shuffles no further.
    """
    tasks = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    most, rows = tasks.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if most > max(TASK_ROWS, 2 * rows / cores) else df


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows in an order.  Runs as a per-partition heap, not a full sort."""
    return df.orderBy(*order).limit(n)


def single(df: DataFrame) -> Column:
    """The value of a one-row, one-column result, as a scalar subquery."""
    return df.scalar()


def empty(df: DataFrame, ddl: str) -> DataFrame:
    """An empty result of the given schema, for a table that lacks a column."""
    return df.sparkSession.createDataFrame([], ddl)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key; null keys count as equal.

    Spark cuts every key to one row inside each input partition before the
    shuffle, so a key shared by very many rows never reaches one task whole.
    """
    return limit_per_key(df, key, order, 1)


def limit_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """Keep the first n rows of each key, cut per partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def input_order(df: DataFrame, order_by: Sequence[str] | None = None) -> list[Column]:
    """Input order: the given columns, else ``ingest_order``, else a hash of the row."""
    if order_by is None and "ingest_order" in df.columns:
        order_by = ["ingest_order"]
    if order_by is None:
        return [F.xxhash64(*df.columns)]
    return [F.col(name) for name in order_by]


def first_value(name: str, order: Sequence[Column], known: bool = False) -> Column:
    """A column's value in the first row of a group, or in the first row that has one."""
    place = F.struct(*order)
    return F.min_by(name, F.when(F.col(name).isNotNull(), place) if known else place)


def value_counts(df: DataFrame, *values: str, name: str = "copies") -> DataFrame:
    """Rows per distinct combination of values."""
    return df.groupBy(*values).agg(F.count(F.lit(1)).alias(name))


def bin_tests(value: Column, bins: Sequence[tuple[str, int, int]]) -> list[tuple[str, Column]]:
    """Per bin its label and the test low < value <= high."""
    return [(label, (value > low) & (value <= high)) for label, low, high in bins]


def bin_of(value: Column, bins: Sequence[tuple[str, int, int]]) -> Column:
    """Label of the value's bin; null outside all bins."""
    return F.coalesce(*[F.when(test, label) for label, test in bin_tests(value, bins)])


def tally(df: DataFrame, name: str, count: str, cases: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per case with the number of input rows that meet its condition.

    All cases are counted in one global aggregate, which ships one row per input
    partition, and cases that never occur come out as 0 without a join.
    """
    counted = df.agg(*[F.count_if(test).alias(f"_{i}") for i, (_, test) in enumerate(cases)])
    return unpivot(counted, name, count, [label for label, _ in cases])


def unpivot(one_row: DataFrame, name: str, count: str, labels: Sequence[str]) -> DataFrame:
    """Columns ``_0, _1, ...`` of a one-row result as labelled rows."""
    pairs = [
        F.struct(F.lit(label).alias(name), F.col(f"_{i}").alias(count))
        for i, label in enumerate(labels)
    ]
    return one_row.select(F.inline(F.array(*pairs)))
