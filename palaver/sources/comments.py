"""Comment tables: CSV and Parquet readers that give the same columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver import schema
from palaver.functions.text import word_count, word_count_collapsed
from palaver.functions.values import utc_from_epoch

CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "enforceSchema": False,
    "mode": "FAILFAST",
}


def with_text_metrics(df: DataFrame, collapsed: bool = False) -> DataFrame:
    """(Re)compute ``comment_length`` in code points and ``comment_word_count``.

    ``collapsed`` promises bodies whose whitespace is single inner spaces, whose
    words can be counted without splitting.
    """
    count = word_count_collapsed if collapsed else word_count
    return df.withColumns(
        {
            "comment_length": F.length("comment_body"),
            "comment_word_count": count(F.col("comment_body")),
        }
    )


def prepare_comments(df: DataFrame, null_tokens: Sequence[str] = ()) -> DataFrame:
    """Loaded form of a raw comment table: no null body, UTC times, text metrics.

    A body equal to one of ``null_tokens`` is read as missing.  None are by
    default, so a comment that just says "None" keeps its text.
    """
    body = F.coalesce("comment_body", F.lit(""))
    if null_tokens:
        body = F.when(body.isin(*null_tokens), "").otherwise(body)
    out = df.withColumn("comment_body", body)
    for kind in ("post", "comment"):
        if f"{kind}_created_utc" in df.columns:
            out = out.withColumn(
                f"{kind}_created_at", utc_from_epoch(F.col(f"{kind}_created_utc"))
            )
    return with_text_metrics(out)


def scan_csv(spark: SparkSession, path: str | Sequence[str], known: T.StructType) -> DataFrame:
    """A CSV scan typed by the known schema; an unknown column is text.

    Only header names are read from the data, never types.  Whole numbers are read as
    decimals: writers that promote a column with gaps store 5 as ``5.0``, and no digit of
    a long number may be lost.
    """
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    kinds = {
        field.name: T.DecimalType(38, 9) if field.dataType == T.LongType() else field.dataType
        for field in known
    }
    wide = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return spark.read.options(**CSV_OPTIONS).schema(wide).csv(path)


def whole_numbers(df: DataFrame, known: T.StructType) -> DataFrame:
    """Cast the columns that the known schema holds as whole numbers.

    A fraction raises, as does a number beyond 64 bits.
    """
    longs = {field.name for field in known if field.dataType == T.LongType()}

    def whole(name: str) -> Column:
        value = F.col(name)
        message = F.concat(F.lit(f"{name} is not a whole number: "), value.cast("string"))
        return F.when(value == F.floor(value), F.floor(value).cast("bigint")).when(
            value.isNotNull(), F.raise_error(message).cast("bigint")
        )

    return df.withColumns({n: whole(n) for n in df.columns if n in longs})


def read_comments_csv(
    spark: SparkSession, path: str | Sequence[str], null_tokens: Sequence[str] = ()
) -> DataFrame:
    """Comments from CSV.  Bodies may hold quotes and line breaks.

    ``ingest_order`` records the input position, for operators that keep the
    first of several rows.  A file whose records span lines cannot be split, so
    large inputs should come as many files, or as Parquet.
    """
    raw = (
        scan_csv(spark, path, schema.COMMENTS)
        .select("*", "_metadata.file_path", F.monotonically_increasing_id().alias("row"))
        .withColumn("ingest_order", F.struct("file_path", "row"))
        .drop("file_path", "row")
    )
    return prepare_comments(whole_numbers(raw, schema.COMMENTS), null_tokens)


def read_comments_parquet(
    spark: SparkSession, path: str | Sequence[str], null_tokens: Sequence[str] = ()
) -> DataFrame:
    """Comments from Parquet: the scan reads only the columns a query uses."""
    return prepare_comments(spark.read.parquet(path), null_tokens)
