"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Words are maximal runs without space, tab, line feed, vertical tab, form feed, return.
WORD = re.compile("[^\x20\x09-\x0d]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0d]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table; the schema is declared, so planning opens no file."""
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def crc_of(value: object) -> int:
    """CRC-32 of a value as text; of the empty text for null."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def fold(column: Column) -> Column:
    """Text with null as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(column: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD_SQL)), F.lit(0)).cast("bigint")


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[dict[str, list]], Iterator[dict[str, list]]]],
    rows: int = 512,
) -> DataFrame:
    """Map Arrow batches in slices of at most ``rows`` rows.

    ``make`` runs once per task and returns a function from the slice's columns to
    column dictionaries.  Slices bound the Python objects that a task holds beside the
    session's Arrow batch.
    """
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        step = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                step = step or make()
                piece = batch.slice(start, rows)
                for out in step(piece.to_pydict()):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, target)


def own_names(docs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """The same columns in the same order, with plain names for all but the first of ``needed``.

    Operators name columns of their own; under plain names no column of the input can clash
    with them.  ``toDF(*docs.columns)`` of the result's columns gives the names back.
    """
    left, names = list(needed), []
    for i, name in enumerate(docs.columns):
        names.append(name if name in left else f"extra_{i}")
        left = [n for n in left if n != name]
    return docs.toDF(*names)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with the lineage cut.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, as in
    tests, a folder below the warehouse is used, which a cluster shares too.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(shared or f"{warehouse}/_checkpoints")
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a Parquet table below the shared checkpoint folder, and read back.

    For tables as large as the corpus's vocabulary, which Parquet holds in a fraction of
    a checkpoint's space.
    """
    session = df.sparkSession
    root = session.conf.get("spark.checkpoint.dir", None) or (
        f"{session.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    )
    path = f"{root}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)
