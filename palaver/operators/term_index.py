"""Term search by a positional index instead of a scan of all texts.

The index has every word of every comment: the comment's number, the word's position, and what
stands between it and its neighbours.  A row has a word's occurrences between the same gaps in
some texts, so far fewer rows than occurrences are shuffled and sorted.  Numbers follow the
order in which matches are shown, so that the first matches are those of the least numbers.  A
search reads only the buckets of the term's words; the texts shown are fetched by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.fixed import WORD_SET
from palaver.operators.common import single, top
from palaver.operators.terms import matching_comments

SHOWN = ("post_title", "comment_body", "comment_score", "comment_author")
OCCURRENCES = "word string, before string, after string, doc array<bigint>, pos array<int>"
POSTINGS = f"{OCCURRENCES}, bucket int"
# Buckets of words, and parts that the rows of one are written in: their product is the number of
# files, each of which takes a while to open.
BUCKETS, PARTS = 64, 8
# Words whose occurrences are gathered at a time, and occurrences in a row of the index.
WORDS_GATHERED, MOST_IN_ROW = 500_000, 10_000
# Words of a term and the gaps between them; the outer gaps may be empty.
_WORDS = re.compile(r"[^\W]+")


@dataclass(frozen=True)
class TermIndex:
    """An index below a shared folder."""

    spark: SparkSession
    path: str

    def build(
        self, comments: DataFrame, text: str = "comment_body", order_by: Sequence[str] = ("comment_id",)
    ) -> None:
        """Write the index of some comments; they are read once and stored with their numbers.

        Matches are shown in the order of ``order_by``.  A null text has no words.  The rows of
        a frequent word are written in parts, so no task has them all.
        """
        # A sort reads its input twice, first for the ranges; so what it sorts is stored.
        comments.write.parquet(f"{self.path}/comments")
        given = self.spark.read.schema(comments.schema).parquet(f"{self.path}/comments")
        numbered = given.orderBy(*order_by).withColumn("doc", F.monotonically_increasing_id())
        numbered.write.parquet(f"{self.path}/rows")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        lowered = F.lower(F.col(text))
        cut = rows.select(
            "doc",
            # Words and gaps in turn.
            F.regexp_extract_all(lowered, F.lit(f"[{WORD_SET}]+|[^{WORD_SET}]+"), F.lit(0)).alias("tokens"),
            lowered.rlike(f"^[{WORD_SET}]").alias("leads"),
        )
        postings = cut.mapInArrow(_gathered, OCCURRENCES).withColumn("bucket", bucket_of(F.col("word")))
        part = F.pmod(F.xxhash64(F.get("doc", F.lit(0))), F.lit(PARTS))
        dealt = postings.repartition("bucket", part).sortWithinPartitions("bucket", "word")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings")

    @cached_property
    def _postings(self) -> DataFrame:
        """Opened once: its many folders are listed then."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def docs(self, term: str) -> DataFrame | None:
        """``doc`` of every comment with the term as a whole word; None if no word is in it.

        As in ``terms.matching_comments``, an end of the term that is no word character needs a
        word next to it.
        """
        needle = term.lower()
        words = [m.group() for m in _WORDS.finditer(needle)]
        if not words:
            return None
        gaps = _WORDS.split(needle)
        found = None
        for i, word in enumerate(words):
            of_word = (F.col("bucket") == bucket_of(F.lit(word))) & (F.col("word") == word)
            here = self._postings.where(of_word)
            if i or gaps[0]:
                here = here.where(F.col("before") == gaps[i])
            if i == len(words) - 1 and gaps[-1]:
                here = here.where(F.col("after") == gaps[-1])
            here = here.select(F.inline(F.arrays_zip("doc", "pos")))
            starts = here.select("doc", (F.col("pos") - i).alias("start"))
            found = starts if found is None else found.unionByName(starts)
        if len(words) > 1:
            # Every word of the term once at its place after the start.
            found = found.groupBy("doc", "start").agg(F.count(F.lit(1)).alias("n"))
            found = found.where(F.col("n") == len(words))
        return found.select("doc").distinct()

    def search(self, term: str, limit: int = 10) -> DataFrame:
        """The first ``limit`` matches, each with the total number of matches.

        Equal to ``terms.comments_containing_term`` over the comments of the index.  A term
        without a word character is looked up in the stored texts.
        """
        rows = self._rows()
        docs = self.docs(term)
        if docs is None:
            docs = matching_comments(rows, term).select("doc")
        total = single(docs.agg(F.count(F.lit(1))))
        # As many numbers as are shown; a filter on them skips all other parts of the rows.
        first = [r["doc"] for r in top(docs, limit, F.asc("doc")).collect()]
        shown = rows.where(F.col("doc").isin(first)).orderBy("doc")
        return shown.select(*SHOWN).withColumn("total_matches", total)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``OCCURRENCES`` from documents' numbers, tokens and whether a word is the first one."""
    for batch in batches:
        batch = batch.filter(batch.column(1).is_valid())
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        leads = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
        ends = ends.astype(np.int64)
        at = 0
        while at < len(docs):
            # A text's tokens are words and about as many gaps.
            to = int(np.searchsorted(ends, ends[at] + 2 * WORDS_GATHERED, side="right")) - 1
            to = max(to, at + 1)
            tokens = batch.column(1).slice(at, to - at).flatten()
            yield _by_word(tokens, np.diff(ends[at : to + 1]), docs[at:to], leads[at:to])
            at = to


def _by_word(
    tokens: pa.Array, lengths: np.ndarray, docs: np.ndarray, leads: np.ndarray
) -> pa.RecordBatch:
    """Every word's occurrences in texts laid end to end, at most ``MOST_IN_ROW`` in a row."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Words have even places, from 0; a gap before the first one has place -1.
    place -= ~leads[owner]
    at = np.flatnonzero(place % 2 == 0)
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # A gap counts if a word stands on its other side too; -1 is none.
    last = np.append(owner, -1)[np.minimum(at + 2, len(owner))] != owner[at]
    before = np.where(place[at] > 0, code[at - 1], -1)
    after = np.where(last, -1, np.append(code, -1)[at + 1])
    sides, side = np.unique((before + 1) * (len(coded.dictionary) + 1) + after + 1, return_inverse=True)
    key = code[at] * len(sides) + side
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    inside = np.arange(len(key)) - np.repeat(new, np.diff(new, append=len(key)))
    first = np.flatnonzero(inside % MOST_IN_ROW == 0)
    word, side = np.divmod(key[first], max(len(sides), 1))
    before, after = np.divmod(sides[side], len(coded.dictionary) + 1)
    ends = pa.array(np.append(first, len(key)), type=pa.int32())

    def spelled(codes: np.ndarray) -> pa.Array:
        return coded.dictionary.take(pa.array(codes, mask=codes < 0)).cast(pa.string())

    return pa.RecordBatch.from_arrays(
        [
            *[spelled(x) for x in (word, before - 1, after - 1)],
            pa.ListArray.from_arrays(ends, pa.array(docs[owner[at]], type=pa.int64())),
            pa.ListArray.from_arrays(ends, pa.array(place[at] // 2, type=pa.int32())),
        ],
        names=["word", "before", "after", "doc", "pos"],
    )


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")
