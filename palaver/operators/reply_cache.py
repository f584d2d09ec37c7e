"""A reply cache whose probes cost as much as what is asked for.

Answers lie in buckets by the first digits of their text's digest.  A probe reads only the
buckets that the asked digests fall in, and of those only the digests that pass a Bloom filter
of the asked ones go into a shuffle.  So a probe's shuffles follow the number of texts asked
about and not the size of the cache.

Appends are folders of their own.  Compaction merges them into a new base and then writes a
note that names it and what it absorbed; readers go by the last note, so a compaction that
fails changes nothing, and appends made meanwhile stay.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.labels import digest
from palaver.operators.common import value_counts
from palaver.operators.scoring import (
    SCORING_BATCH,
    ReplierFactory,
    ask,
    attach_answers,
    distinct_texts,
)

ROWS = "text_sha256 string, emotions array<string>, model_key string, bucket string"
NOTE = "version bigint, base string, absorbed array<string>"
# Hex digits of a bucket's name.
DIGITS = 2
# Bits of the filter per asked digest, their least and largest number in all, and hashes.
BITS_EACH, LEAST_BITS, MOST_BITS, HASHES = 12, 1 << 12, 1 << 26, 5


def _places(value: Column, bits: int) -> list[Column]:
    """The bits of a digest, one per hash."""
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom_filter(digests: DataFrame, bits: int, column: str = "text_sha256") -> Column:
    """The filter's bits as an array of 64-bit words, a scalar of the query.

    Every word, set or not, is a row; they meet in one task, which at the largest size are
    ``MOST_BITS`` / 64, and are sorted there.
    """
    places = digests.select(F.explode(F.array(*_places(F.col(column), bits))).alias("place"))
    word = F.floor(F.col("place") / 64).alias("word")
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int")
    )
    words = places.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    zero = F.lit(0).cast("bigint").alias("bits")
    every = digests.sparkSession.range(bits // 64).select(F.col("id").alias("word"), zero)
    filled = every.unionByName(words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return filled.agg(listed.alias("all")).select(F.col("all.bits")).scalar()


def passes(value: Column, words: Column, bits: int) -> Column:
    """Whether all bits of a digest are set; true for every digest of the filter."""
    # Written out, as a scalar of the query cannot stand inside a lambda.
    out = F.lit(True)
    for place in _places(value, bits):
        word = F.get(words, F.floor(place / 64).cast("int"))
        out = out & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    return out


def bits_for(digests: int) -> int:
    """Size of a filter over so many digests: a power of two."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < BITS_EACH * digests:
        bits *= 2
    return bits


@dataclass(frozen=True)
class ReplyCache:
    """Answers by model and text, below a shared folder."""

    spark: SparkSession
    path: str

    def append(self, answers: DataFrame) -> None:
        """Add ``(model_key, text_sha256, emotions)``; a pair that is there counts once.

        A bucket's rows meet in one task, so a folder has one file per bucket and model.
        """
        rows = answers.select(
            "text_sha256",
            "emotions",
            "model_key",
            F.substring("text_sha256", 1, DIGITS).alias("bucket"),
        )
        name = f"append-{uuid.uuid4().hex}"
        dealt = rows.repartition("bucket")
        dealt.write.partitionBy("model_key", "bucket").parquet(f"{self.path}/{name}")

    def _folders(self) -> list[str]:
        """Folders that hold the cache now: the base and the appends it has not absorbed."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        found = [s.getPath() for s in system.listStatus(root)]
        done = {p.getName() for p in found if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
        note = self._note() if "notes" in done else None
        appends = sorted(n for n in done if n.startswith("append-"))
        if note is None:
            return appends
        return [note["base"], *[n for n in appends if n not in note["absorbed"]]]

    def _note(self):
        notes = self.spark.read.schema(NOTE).parquet(f"{self.path}/notes")
        return notes.orderBy(F.desc("version")).first()

    def rows(self, model: str | None = None) -> DataFrame:
        """``(model_key, text_sha256, emotions, bucket)`` as stored; pairs may repeat."""
        return self._read(self._folders(), model)

    def _read(self, folders: list[str], model: str | None) -> DataFrame:
        table = self.spark.createDataFrame([], ROWS)
        for name in folders:
            # The base path makes the folders' names columns again.
            part = self.spark.read.schema(ROWS).parquet(f"{self.path}/{name}")
            table = table.unionByName(part)
        if model is not None:
            table = table.where(F.col("model_key") == model)
        return table.select("model_key", "text_sha256", "emotions", "bucket")

    def probe(self, digests: DataFrame, model: str) -> DataFrame:
        """``(text_sha256, emotions)`` of those of ``digests`` that the model has answered.

        ``digests`` has distinct ``text_sha256``; it is read three times.
        """
        known = self.rows(model)
        asked = digests.select("text_sha256")
        bucket = F.substring("text_sha256", 1, DIGITS).alias("bucket")
        # At most 16 to the power of DIGITS names.
        sizes = asked.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()
        names = [r["bucket"] for r in sizes if r["bucket"] is not None]
        if not names:
            return known.where("false").select("text_sha256", "emotions")
        bits = bits_for(sum(r["n"] for r in sizes))
        near = known.where(F.col("bucket").isin(names)).where(
            passes(F.col("text_sha256"), bloom_filter(asked, bits), bits)
        )
        hits = near.join(asked, "text_sha256", "left_semi")
        return hits.groupBy("text_sha256").agg(F.any_value("emotions").alias("emotions"))

    def compact(self) -> int:
        """Merge all folders into one base without repeats; returns its rows.

        Rows are sorted by digest inside a bucket, so that readers can skip parts of files.
        """
        folders = self._folders()
        merged = (
            self._read(folders, None)
            .groupBy("model_key", "text_sha256")
            .agg(F.any_value("emotions").alias("emotions"))
            .withColumn("bucket", F.substring("text_sha256", 1, DIGITS))
            .repartition("bucket")
            .sortWithinPartitions("model_key", "bucket", "text_sha256")
        )
        base = f"base-{uuid.uuid4().hex}"
        rows = merged.select("text_sha256", "emotions", "model_key", "bucket")
        rows.write.partitionBy("model_key", "bucket").parquet(f"{self.path}/{base}")
        last = self._note() if any(f.startswith("base-") for f in folders) else None
        absorbed = sorted({*folders, *(last["absorbed"] if last else ())})
        note = [((last["version"] if last else 0) + 1, base, absorbed)]
        notes = self.spark.createDataFrame(note, NOTE).coalesce(1)
        notes.write.mode("append").parquet(f"{self.path}/notes")
        return self._read([base], None).count()


def score_with_reply_cache(
    df: DataFrame,
    text: str,
    model: str,
    factory: ReplierFactory,
    cache: ReplyCache,
    spread_by: str,
    batch_size: int = SCORING_BATCH,
) -> DataFrame:
    """Label every row, asking the model only about texts that the cache has no answer to.

    As ``scoring.score_with_cache``, with probes that follow the rows.  New answers are
    appended before use.
    """
    narrow = value_counts(df.select(digest(F.col(text)).alias("text_sha256")), "text_sha256")
    known = cache.probe(narrow, model)
    misses = distinct_texts(df, text).join(known.select("text_sha256"), "text_sha256", "left_anti")
    asked = ask(misses, factory, batch_size).withColumn("model_key", F.lit(model))
    cache.append(asked.select("model_key", "text_sha256", "emotions"))
    answers = narrow.join(cache.probe(narrow, model), "text_sha256")
    return attach_answers(df, text, answers, spread_by)
