"""Groups of texts whose word shingles overlap by a given Jaccard similarity.

Candidates are texts whose SimHash fingerprints lie close, and texts that meet in MinHash
bands, as texts of similarity 0.8 mostly differ in more bits than fingerprints find; every link is verified by the exact Jaccard similarity of
the shingle sets (64-bit hashes).  With 32 bands of 6 rows a pair at similarity 0.8 meets
in no band with probability 6e-5, one at 0.9 with 1e-11.

Work grows with the number of texts, however large a bucket is.  First each member of a
bucket is compared with one of them: the one whose buckets are the largest together, as those
of a text are that many others were copied from.  Then a bucket's members are sorted by four
more minima, where similar texts stand side by side, in another order in every band that they
meet in; each is compared with the few that follow it and do not already hang together with
it.  Two texts of a large bucket that are neither can be missed; README gives the measured
share.  Pairs are judged by all their minima before the texts' shingles are fetched.

Texts without a shingle are no member of any bucket.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import checkpointed, map_rows, stored
from palaver.llm.components import connected_components

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 32, 6
# Members of a bucket that each is compared with.
NEIGHBOURS = 4
# Pairs of a lower share of equal minima are not verified: for 192 minima that is six standard
# deviations below a similarity of 0.8.
SLACK = 0.18
# Keys that are broadcast to where the texts are; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
# Rows of a bucket that one task sorts.
BUCKET_ROWS = 200_000
# Shingles hashed at a time.
BLOCK = 2048


def word_shingles(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the words, and the sorted distinct hashes of their shingles.

    A-Z are lower-cased; words are separated by space and the control characters 9 to 13.
    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if not words:
        return digest(joined), np.empty(0, dtype=np.uint64)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    found = np.fromiter(
        (digest(joined[a:b]) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1
    )
    return digest(joined), np.unique(found)


@lru_cache
def _mixers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of as many hash functions, as columns."""
    rng = np.random.default_rng(7)
    factor = rng.integers(0, 2**63, (count, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factor, rng.integers(0, 2**64, (count, 1), dtype=np.uint64)


def minima(grams: np.ndarray, count: int) -> np.ndarray:
    """The least of each of as many hash functions over some shingles."""
    factor, shift = _mixers(count)
    least = np.full(count, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(grams), BLOCK):
        part = (grams[at : at + BLOCK] ^ (grams[at : at + BLOCK] >> np.uint64(29)))[None, :]
        least = np.minimum(least, (part * factor + shift).min(axis=1))
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> tuple[list[int], list[int]]:
    """One signed 64-bit key per band, and its order there: four minima of the next band."""
    pieces = least.reshape(bands, rows)
    seeds = range(bands)
    keys = [xxhash.xxh64_intdigest(p.tobytes(), s) for p, s in zip(pieces, seeds, strict=True)]
    short = np.roll(_short(least).reshape(bands, rows), -1, axis=0)[:, :4]
    order = np.ascontiguousarray(short.astype(">u2")).view(">i8").ravel()
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist(), order.tolist()


def _short(least: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum."""
    return (least >> np.uint64(24)).astype(np.uint16)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of some 64-bit hashes: bits set in over half of them; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signatures(docs: DataFrame, keep: list[str], shingle: int, bands: int, rows: int) -> DataFrame:
    """Columns to keep, ``node`` (hash of the words), ``n`` (distinct shingles), ``fp``, bands.

    ``fp`` is the SimHash of the distinct shingles, as a signed number.
    ``bands`` has a key and an order per band, ``least`` sixteen bits of every minimum; both
    are empty without a shingle.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def step(part: dict[str, list]) -> Iterator[dict[str, list]]:
            read = [word_shingles(t, shingle) for t in part["_text"]]
            nodes = np.array([node for node, _ in read], dtype=np.uint64).view(np.int64)
            prints = np.array([majority(grams) for _, grams in read], dtype=np.uint64)
            keys, least = [], []
            for _, grams in read:
                found = minima(grams, bands * rows) if len(grams) else None
                both = zip(*band_keys(found, bands, rows), strict=True) if len(grams) else ()
                keys.append([{"key": k, "place": p} for k, p in both])
                least.append(_short(found).tobytes() if len(grams) else b"")
            yield {c: part[c] for c in keep} | {
                "node": nodes.tolist(),
                "n": [len(grams) for _, grams in read],
                "fp": prints.view(np.int64).tolist(),
                "bands": keys,
                "least": least,
            }

        return step

    band = "struct<key: bigint, place: bigint>"
    return map_rows(
        docs.select(*keep, F.col("text").alias("_text")),
        f"{kinds}, node bigint, n bigint, fp bigint, bands array<{band}>, least binary",
        make,
    )


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(node, grams)`` of ``(node, text)``: the sorted shingle hashes as bytes."""

    def make():
        def step(part: dict[str, list]) -> Iterator[dict[str, list]]:
            sets = [word_shingles(t, shingle)[1].tobytes() for t in part["text"]]
            yield {"node": part["node"], "grams": sets}

        return step

    return map_rows(texts.select("node", "text"), "node bigint, grams binary", make)


def few(keys: DataFrame) -> DataFrame:
    """A table of keys, marked to be broadcast if it is counted small; texts then stay put."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _paired(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` with a column of ``table`` for either end, as ``one`` and ``other``."""
    one = table.select(F.col("node").alias("a"), F.col(column).alias("one"))
    other = table.select(F.col("node").alias("b"), F.col(column).alias("other"))
    return pairs.join(one, "a").join(other, "b").select(*pairs.columns, "one", "other")


def likely(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The pairs that share at least so many of their minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("one"), batch.column("other"), strict=True):
                x = np.frombuffer(one.as_buffer(), dtype=np.uint16)
                y = np.frombuffer(other.as_buffer(), dtype=np.uint16)
                keep.append(np.count_nonzero(x == y) >= least * len(x))
            kept = batch.select(range(batch.num_columns - 2))
            yield kept.filter(pa.array(keep, type=pa.bool_()))

    return _paired(pairs, prints, "least").mapInArrow(run, pairs.schema)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``(a, b)`` of at least the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, other in zip(batch.column("one"), batch.column("other"), strict=True):
                x = np.frombuffer(one.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(other.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(near, type=pa.bool_()))

    joined = _paired(pairs.select("a", "b"), sets, "grams")
    return joined.mapInArrow(run, "a bigint, b bigint")


def crowded(prints: DataFrame) -> DataFrame | None:
    """``(key, first, pieces)`` of buckets too large for a task, by the order's first minimum.

    ``pieces`` is into how many its rows are cut.  None if no bucket is as large.
    """
    rows = prints.select(F.inline("bands"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    # One bucket in BUCKET_ROWS rows at most.
    large = stored(large.where(F.col("size") > BUCKET_ROWS).select("key"))
    if large.isEmpty():
        return None
    first = F.shiftrightunsigned("place", 48).alias("first")
    pieces = F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("pieces")
    held = rows.join(large, "key", "left_semi")
    return stored(held.groupBy("key", first).agg(pieces))


def bucket_rows(prints: DataFrame, cut: DataFrame | None) -> DataFrame:
    """``prints`` once for every bucket of a text, with ``key``, ``place`` and ``part``.

    A bucket is one part, unless it is crowded.  It is then cut by the first minimum of the
    order, and what still is as large by the texts' hashes.
    """
    rows = prints.select("*", F.inline("bands")).drop("bands")
    if cut is None:
        return rows.withColumn("part", F.lit(0).cast("bigint"))
    piece = F.xxhash64("first", F.pmod("node", F.col("pieces")))
    held = rows.withColumn("first", F.shiftrightunsigned("place", 48))
    held = held.join(cut, ["key", "first"], "left")
    part = F.when(F.col("pieces").isNotNull(), piece).otherwise(0)
    return held.withColumn("part", part).drop("first", "pieces")


# From the key, node, shingles and mark of sorted rows, whole buckets: places of the pairs.
Pick = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pivots(starts: np.ndarray, node: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the one of the largest mark of its bucket, the least node of equal ones."""
    bucket = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((-node, mark, bucket))
    best = order[starts[1:] - 1][bucket]
    rows = np.arange(len(node))
    return rows[rows != best], best[rows != best]


def beside(starts: np.ndarray, node: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the few before it in its bucket that have another mark."""
    bucket = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    rows, others = [], []
    for step in range(1, NEIGHBOURS + 1):
        at = np.arange(step, len(node))
        at = at[(bucket[at] == bucket[at - step]) & (mark[at] != mark[at - step])]
        rows.append(at)
        others.append(at - step)
    return np.concatenate(rows), np.concatenate(others)


def compared(rows: DataFrame, pick: Pick, similarity: float) -> DataFrame:
    """``(a, b)``: the distinct pairs that ``pick`` finds in the buckets, a below b.

    ``rows`` are ``bucket_rows`` with a ``mark``.  Pairs whose numbers of shingles alone rule
    the similarity out are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), dtype=np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = np.stack([batch.column(i).to_numpy() for i in range(5)])
                held = np.concatenate([held, new], axis=1)
            change = (held[:2, 1:] != held[:2, :-1]).any(axis=0)
            ends = np.flatnonzero(change) + 1
            if batch is None and held.shape[1]:
                ends = np.append(ends, held.shape[1])
            if not len(ends):
                continue
            _, _, node, n, mark = held[:, : ends[-1]]
            x, y = pick(np.concatenate([[0], ends]), node, mark)
            fits = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])
            one, other = node[x[fits]], node[y[fits]]
            columns = [np.minimum(one, other), np.maximum(one, other)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["a", "b"])
            held = held[:, ends[-1] :]

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "place", "node")
    dealt = dealt.select("key", "part", "node", "n", "mark")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


# From a table of distinct ``fp``: links ``(a, b)`` that connect all that lie close.
Near = Callable[[DataFrame], DataFrame]


def close_pairs(prints: DataFrame, near: Near) -> DataFrame:
    """``(a, b)``: pairs of nodes of ``(node, fp)`` that connect all whose fingerprints are close.

    The nodes of one fingerprint are paired with the least of them, and those of linked ones
    with each other.
    """
    firsts = stored(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same = prints.join(firsts, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    across = near(firsts.select("fp"))
    for end in ("a", "b"):
        one = firsts.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}"))
        across = across.join(one, end)
    pairs = same.where("a <> b").unionByName(across.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(
    docs: DataFrame,
    printed: DataFrame,
    key: list[str],
    near: Near,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``(node, _group)`` of every node of ``printed``; a group is named by one of its nodes.

    ``printed`` is ``signatures`` of ``docs`` with the columns ``key``, which tell the rows
    of ``docs`` apart or are equal where the texts are.  ``near`` links fingerprints.
    """
    prints = stored(printed.select("node", "n", "fp", "bands", "least").dropDuplicates(["node"]))
    close = stored(close_pairs(prints.where("n > 0").select("node", "fp"), near))
    cut = crowded(prints)
    rows = bucket_rows(prints.select("node", "bands"), cut)
    size = F.count(F.lit(1)).over(Window.partitionBy("key", "part"))
    met = rows.select("node", size.alias("size")).where("size > 1")
    others = close.select(F.explode(F.array("a", "b")).alias("node"))
    met = met.unionByName(others.withColumn("size", F.lit(0).cast("bigint")))
    met = met.groupBy("node").agg(F.sum("size").alias("mark"))
    # The texts that meet any other, with the sizes of their buckets; one row of a text.
    prints = stored(prints.join(met, "node"))

    needed = printed.join(prints.select("node"), "node", "left_semi")
    chosen = needed.groupBy("node").agg(F.min(F.struct(*key)).alias("_key")).select("node", "_key")
    marked = docs.select(F.struct(*key).alias("_key"), "text").join(few(stored(chosen)), "_key")
    # Wholly equal rows match alike.
    sets = stored(shingle_sets(marked, shingle).dropDuplicates(["node"]))

    def checked(pairs: DataFrame) -> DataFrame:
        return verified(likely(pairs, prints, similarity - SLACK), sets, similarity)

    def links(marks: DataFrame, pick: Pick) -> DataFrame:
        return compared(bucket_rows(marks.select("node", "n", "mark", "bands"), cut), pick, similarity)

    pairs = links(prints, pivots).unionByName(close).distinct()
    first = connected_components(checked(pairs), "a", "b")
    first = stored(first.withColumnRenamed("component", "group"))
    grouped = prints.drop("mark").join(first, "node", "left")
    grouped = stored(grouped.withColumn("mark", F.coalesce("group", "node")).drop("group"))
    # Links between groups; a group is named by a node, and a text alone is its own group.
    more = checked(links(grouped, beside))
    for end in ("a", "b"):
        own = grouped.select(F.col("node").alias(end), F.col("mark").alias(f"_{end}"))
        more = more.join(own, end)
    second = connected_components(more.select("_a", "_b"), "_a", "_b")
    second = second.withColumnRenamed("node", "group")
    named = printed.select("node").distinct().join(first, "node", "left")
    named = named.select("node", F.coalesce("group", "node").alias("group"))
    named = named.join(second, "group", "left")
    return checkpointed(named.select("node", F.coalesce("component", "group").alias("_group")))
