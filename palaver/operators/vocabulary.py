"""The most frequent terms of a corpus, without counting the rare ones.

Most distinct words and word pairs of a large corpus are rare, and an exact count ships every
one of them.  Here a first pass adds up occurrences in a fixed number of hashed counters, a
sketch whose parts can be merged.  No term occurs more often than its counter says.  So terms
whose counter is below a bound occur less often than the bound, and a second pass counts only
the others, exactly.  If as many of them as are asked for reach the bound, no other term can
belong to the list; if not, the bound is lowered and the pass repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.fixed import WORD_SET
from palaver.functions.text import adjacent_pairs
from palaver.operators.common import single, top
from palaver.session import shared_folder

MAX_FEATURES = 50_000
MIN_DOCUMENTS = 2
# Words that are counted at a time, and distinct ones up to which a pair and its text's number
# fit 64 bits together.
WORDS_COUNTED, MOST_NUMBERED = 1_000_000, 2_000_000
# Counters of the sketch: what a task ships in the first pass is at most this many rows.
COUNTERS = 1 << 20
# Factor by which the bound falls when it was too high.
LOWER = 8


def words_of(text: Column) -> Column:
    """Lower-cased words of two letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_SET}]{{2,}}"), F.lit(0))


@dataclass(frozen=True)
class Neighbours:
    """Pairs of neighbouring words, and with ``alone`` the words before them; no word has a space."""

    words: Callable[[Column], Column]
    alone: bool = True

    def __call__(self, text: Column) -> Column:
        words = self.words(text)
        pairs = F.array_compact(adjacent_pairs(words))
        return F.concat(words, pairs) if self.alone else pairs


# Lower-cased words of two letters or more, then neighbouring pairs of them.
grams_of = Neighbours(words_of)


def counted_terms(
    examples: DataFrame, text: str = "text", grams: Callable[[Column], Column] = grams_of
) -> DataFrame:
    """``(term, df, tf)`` within some texts at a time; ``term_counts`` adds them up.

    The words of about ``WORDS_COUNTED`` words' texts are numbered and the numbers counted, so
    a term is spelled out once for all of these and not for each occurrence.  Pairs of
    ``Neighbours`` are pairs of numbers; the terms of other ``grams`` are taken as they are.
    """
    paired = isinstance(grams, Neighbours)
    alone = not paired or grams.alone
    # Words go to the tasks as one string, which costs less than a list of them.
    given = F.array_join(grams.words(F.col(text)), " ") if paired else grams(F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0).drop_null()
            if paired:
                lists = pc.split_pattern(lists.filter(pc.not_equal(lists, "")), " ")
            ends = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
            at = 0
            while at < len(lists):
                to = int(np.searchsorted(ends, ends[at] + WORDS_COUNTED, side="right")) - 1
                to = max(to, at + 1)
                part, lengths = lists.slice(at, to - at).flatten(), np.diff(ends[at : to + 1])
                yield _counted(part, lengths, paired, alone)
                at = to

    return examples.select(given.alias("_given")).mapInArrow(run, "term string, df bigint, tf bigint")


def _counted(
    terms: pa.Array, lengths: np.ndarray, paired: bool, alone: bool = True
) -> pa.RecordBatch:
    """Counts of the terms, of the pairs of neighbours or of both, of texts laid end to end."""
    numbered = terms.dictionary_encode(null_encoding="encode")
    known = numbered.dictionary
    keys = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if paired:
        inside = owner[1:] == owner[:-1]
        # The number of a pair is above all numbers of words.
        pairs = (keys[:-1] + 1) * len(known) + keys[1:]
        keys = np.concatenate([keys[: len(keys) * alone], pairs[inside]])
        owner = np.concatenate([owner[: len(owner) * alone], owner[1:][inside]])
    order = np.lexsort((owner, keys)) if len(known) > MOST_NUMBERED else None
    if order is None:
        both = np.sort(keys * len(lengths) + owner)
        keys, owner = np.divmod(both, max(len(lengths), 1))
    else:
        keys, owner = keys[order], owner[order]
    new = np.diff(keys, prepend=-1) != 0
    first = np.flatnonzero(new)
    tf = np.diff(first, append=len(keys))
    fresh = new | (np.diff(owner, prepend=-1) != 0)
    df = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else tf
    left, right = np.divmod(keys[first], max(len(known), 1))
    words = int(np.searchsorted(left, 1))
    spelled = known.take(pa.array(right[:words]))
    if paired:
        ahead, behind = known.take(pa.array(left[words:] - 1)), known.take(pa.array(right[words:]))
        joined = pc.binary_join_element_wise(ahead, behind, pa.scalar(" ", type=known.type))
        spelled = pa.concat_arrays([spelled, joined])
    return pa.RecordBatch.from_arrays(
        [spelled.cast(pa.string()), pa.array(df, type=pa.int64()), pa.array(tf, type=pa.int64())],
        names=["term", "df", "tf"],
    )


def term_counts(rows: DataFrame) -> DataFrame:
    """``(term, df, tf)`` of all texts from ``counted_terms``."""
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def _counter(term: Column, counters: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(counters)).cast("int")


def frequent_terms(
    examples: DataFrame,
    text: str = "text",
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    grams: Callable[[Column], Column] = grams_of,
    counters: int = COUNTERS,
) -> DataFrame:
    """``(term, df, tf, idf)`` of the terms that count.

    Terms of at least ``min_documents`` texts, the ``max_features`` most frequent of them, ties
    by term; ``idf`` is ln((n+1)/(df+1)) + 1.  The shuffles carry at most ``counters`` rows a task in the first pass, and in the
    second the terms of the counters that reach the bound.  With far more rare terms than
    counters, each counter is raised by about their mean number of occurrences; the bound
    stays useful while the list's last term occurs more often than that.  A null text has no
    terms.
    """
    session = examples.sparkSession
    rows = counted_terms(examples, text, grams)
    number = _counter(F.col("term"), counters).alias("counter")
    path = shared_folder(session, "counters")
    rows.groupBy(number).agg(F.sum("tf").alias("most")).write.parquet(path)
    sketch = session.read.parquet(path)
    # The bound to try first: as many counters reach it as terms are asked for.
    reached = top(sketch, max_features, F.desc("most"), F.asc("counter"))
    bound = reached.agg(F.min("most")).first()[0] or 1
    # What chance adds to a counter is no reason to miss a term.
    bound = max(1, bound // 2)
    while True:
        path = shared_folder(session, "terms")
        heavy = sketch.where(F.col("most") >= bound).select("counter")
        held = rows
        if bound > 1:
            held = rows.withColumn("counter", _counter(F.col("term"), counters))
            held = held.join(heavy, "counter", "left_semi")
        kept = term_counts(held).where(F.col("df") >= min_documents)
        top(kept, max_features, F.desc("tf"), F.asc("term")).write.parquet(path)
        found = session.read.parquet(path)
        proven = found.agg(F.count_if(F.col("tf") >= bound)).first()[0]
        if bound == 1 or proven >= max_features:
            break
        bound = max(1, bound // LOWER)
    n = single(examples.agg(F.count(F.lit(1))))
    return found.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)
