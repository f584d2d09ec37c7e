"""Mix sources to target weights by systematic sampling.

Each source has a target, and each of its documents the same expected number of copies,
target over size.  Prefix sums of the expected copies inside the source, moved by one
random offset, cross whole numbers; a document is taken once per number it crosses.
Documents stand in order of size, so the sample's sizes follow the source's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import checkpointed, fold, own_names, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
# Slices of a source: the square root of its rows over this, so that neither a slice nor
# the table of slices grows in proportion to the data.
SLICE_FACTOR = 8
# Most sources whose table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def fraction(text: Column) -> Column:
    """A number in [0, 1) from a text; the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """``(source, source_no, source_rows, source_size, target)`` per source.

    ``sized`` has ``source`` and ``size``.  Sources in code point order, null last, take
    the weights in turn and share the whole size.  No target exceeds ``most`` times its
    source's size; what is cut off goes to the others by weight.  In order of limit per
    weight, the level at which the first source fits is the common level of all that are
    not cut off, so no iteration is needed.  An empty table gives an empty table.
    """
    sources = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    listed = sources.withColumn("source_no", number).withColumns(
        {
            "_weight": F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.col("source_no") % len(weights) + 1).cast("int"),
            ),
            "_limit": F.col("source_size") * F.lit(float(most)),
        }
    )
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), "source_no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(
        F.sum("_limit").over(before), F.lit(0.0)
    )
    weight_left = F.sum("_weight").over(everything) - F.coalesce(
        F.sum("_weight").over(before), F.lit(0.0)
    )
    levels = listed.withColumn("_level", left / weight_left)
    fits = F.col("_level") * F.col("_weight") <= F.col("_limit")
    # Levels rise up to the first source that fits and do not rise after it.
    level = F.max(F.when(fits, F.col("_level"))).over(everything)
    return levels.withColumn("_common", level).select(
        "source",
        "source_no",
        "source_rows",
        "source_size",
        F.least(F.col("_common") * F.col("_weight"), F.col("_limit")).alias("target"),
    )


def with_copies(
    docs: DataFrame,
    keep: Sequence[str],
    seed: int = 0,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_COPIES,
) -> DataFrame:
    """The columns ``keep`` with ``_size``, ``_source_size``, ``_target``, ``_copies``.

    A size is a number of words; a null text has none.  The order inside a source, and so
    the result, depends on the rows alone, not on their partitions: size, then a hash of
    id, source and text.  Sources are cut into slices by that hash, each sorted by itself
    and raised by the documents of the slices before; every other slice runs from long to
    short, so neighbouring slices meet at like sizes.  Rows with a null id or source take
    part like others; repeated rows are drawn each for itself.
    """
    rows = docs.select(
        *[F.col(c) for c in keep],
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
        F.md5(F.concat_ws("|", fold(F.col("doc_id")), fold(F.col("source")), fold(F.col("text"))))
        .alias("_key"),
    )
    narrow = "text" not in keep
    if narrow:
        rows = checkpointed(rows)
    sizes = rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    sources = checkpointed(source_targets(sizes, weights, most))
    few = sources.count() <= BROADCAST_SOURCES
    per_source = sources.select(
        F.col("source").alias("_name"),
        F.col("source_no").alias("_no"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0)
        .alias("_rate"),
        F.ceil(F.sqrt("source_rows") / SLICE_FACTOR).cast("bigint").alias("_slices"),
        fraction(F.concat(F.lit(f"{seed}|"), fold(F.col("source")))).alias("_offset"),
    )
    per_source = F.broadcast(per_source) if few else per_source
    joined = rows.join(per_source, F.col("_source").eqNullSafe(F.col("_name")))
    sliced = joined.withColumn(
        "_slice", F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") % F.col("_slices")
    )
    counts = sliced.groupBy("_no", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_no").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        F.col("_no").alias("_start_no"),
        F.col("_slice").alias("_start_slice"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
    )
    by_size = F.when(F.col("_slice") % 2 == 0, F.col("_size")).otherwise(-F.col("_size"))
    place = F.row_number().over(Window.partitionBy("_no", "_slice").orderBy(by_size, "_key"))
    ranked = sliced.withColumn("_place", place).join(
        starts,
        (F.col("_no") == F.col("_start_no")) & (F.col("_slice") == F.col("_start_slice")),
    )
    last = F.col("_start") + F.col("_place")

    def crossed(documents: Column) -> Column:
        return F.floor(documents.cast("double") * F.col("_rate") + F.col("_offset"))

    copies = F.least(crossed(last) - crossed(last - 1), F.ceil(F.col("_rate")))
    return ranked.select(
        *keep, "_size", "_source_size", "_target", copies.cast("bigint").alias("_copies")
    )


def mixing_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` of every document."""
    return with_copies(docs, ["doc_id"], seed).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
        F.col("_copies").alias("copies"),
    )


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed documents: every row as often as it is drawn, with its own columns.

    They may have any names.
    """
    rows = own_names(docs, ("doc_id", "text", "source"))
    drawn = with_copies(rows, rows.columns, seed).where(F.col("_copies") > 0)
    copies = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(*rows.columns).toDF(*docs.columns)
