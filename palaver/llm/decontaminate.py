"""Find benchmark items inside documents.

Windows of an item's size are slid over each document, fingerprinted by SimHash and looked
up among the items' fingerprints: cut into one block more than the radius has bits, two
fingerprints within the radius agree in some block, so an equality join on blocks finds
all of them.  What it finds is verified by the weighted Jaccard similarity of shingles,
their weights being how often they occur.

Windows that share too few shingles with the benchmark to be similar to any item are not
fingerprinted: with similarity t, at least the share t of an item's shingles are in the
window.  Shingles that occur nowhere in the benchmark have weight zero in a fingerprint,
as they tell no item from another, and full weight in the similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpointed, fold, own_names

SHINGLE = 5
SIMILARITY = 0.8
# A pair at the least similarity differs in about 10 of 64 bits, with a spread of 3.
RADIUS = 19
# Most distinct benchmark shingles that are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000

WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(fold(text)), F.lit(WORD), F.lit(0))


def _shingles(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """``keys``, ``k``, ``m``, ``pos``, ``h``: hashed k-word shingles, m in all.

    ``rows`` has ``words``.
    """
    length = F.size("words")
    widest = max(sizes)
    shifted = [F.col("words")] + [F.slice("words", i + 1, length) for i in range(1, widest)]
    named = [s.alias(f"w{i}") for i, s in enumerate(shifted)]
    placed = rows.where(length >= min(sizes)).select(
        *keys, length.alias("_words"), F.posexplode(F.arrays_zip(*named)).alias("pos", "w")
    )
    out = None
    for k in sizes:
        columns = [F.col(f"w.w{i}") for i in range(k)]
        part = placed.where(F.col("pos") <= F.col("_words") - k).select(
            *keys,
            F.lit(k).alias("k"),
            (F.col("_words") - k + 1).alias("m"),
            "pos",
            F.xxhash64(*columns).alias("h"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def simhash(hashes: Column) -> Column:
    """SimHash of an array of 64-bit hashes: the bits set in over half of them."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("bigint"),
        lambda made, bit: made.bitwiseOR(
            F.when(
                F.aggregate(
                    hashes,
                    F.lit(0),
                    lambda n, h: n + F.call_function("getbit", h, bit).cast("int"),
                )
                * 2
                > F.size(hashes),
                F.call_function("shiftleft", F.lit(1).cast("bigint"), bit),
            ).otherwise(F.lit(0).cast("bigint"))
        ),
    )


def blocks(fingerprint: Column, radius: int) -> Column:
    """``array<struct<block, bits>>``: radius + 1 blocks that cover the 64 bits."""
    count = radius + 1
    edges = [64 * i // count for i in range(count + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(fingerprint, low)
                .bitwiseAND(F.lit((1 << (high - low)) - 1))
                .alias("bits"),
            )
            for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
        ]
    )


def shared_weight(one: Column, other: Column) -> Column:
    """Sum over shingles of the lesser of their counts in two arrays."""

    def count(array: Column, value: Column) -> Column:
        return F.size(array) - F.size(F.array_remove(array, value))

    return F.aggregate(
        F.array_intersect(one, other),
        F.lit(0),
        lambda total, h: total + F.least(count(one, h), count(other, h)),
    )


def item_table(items: DataFrame) -> DataFrame:
    """``(item_id, k, n, item)``: each item's shingle size, number and hashes.

    Items of fewer words than a shingle are one shingle; items without words are left out.
    Repeated items count once.
    """
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).distinct()
    k = F.least(F.lit(SHINGLE), F.size("words"))
    text = F.xxhash64("words").alias("_text")
    parts = _shingles(worded.withColumn("own", k).withColumn("_text", text),
                      ["item_id", "own", "_text"], list(range(1, SHINGLE + 1)))
    own = parts.where("k = own")
    return own.groupBy("item_id", "_text", "k", F.col("m").alias("n")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"])
        .alias("item")
    ).select("item_id", "k", "n", "item")


def _windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame | None:
    """``(doc_id, _text, k, n, width, start, hashes)``: windows that may reach an item."""
    vocabulary = checkpointed(
        items.select("k", "n", F.explode("item").alias("h")).distinct()
    )
    sizes = sorted(r.k for r in vocabulary.select("k").distinct().collect())
    if not sizes:
        return None
    if vocabulary.count() <= BROADCAST_SHINGLES:
        vocabulary = F.broadcast(vocabulary)
    worded = docs.select(
        "doc_id",
        F.xxhash64(fold(F.col("text"))).alias("_text"),
        words_of(F.col("text")).alias("words"),
    )
    hits = _shingles(worded, ["doc_id", "_text"], sizes).join(vocabulary, ["k", "h"]).distinct()
    hits = checkpointed(hits)
    needed = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)).cast("int")
    last = F.greatest(F.lit(0), F.col("m") - F.col("n"))
    low = F.greatest(F.lit(0), F.col("pos") - (F.col("n") - needed))
    high = F.least(F.col("pos"), last)
    group = ["doc_id", "_text", "k", "n", "m"]
    starts = (
        hits.where(low <= high)
        .select(*group, F.explode(F.sequence(low, high)).alias("pos"))
        .distinct()
        .withColumn("h", F.lit(None).cast("bigint"))
        .withColumn("is_start", F.lit(True))
    )
    events = hits.select(*group, "pos", "h", F.lit(False).alias("is_start")).unionByName(starts)
    # Positions over the item's size, so that one window frame fits all sizes.
    inside = F.expr(
        "collect_list(h) over (partition by doc_id, _text, k, n, m "
        "order by pos / n range between current row and 0.9999999D following)"
    )
    return (
        events.withColumn("hashes", inside)
        .where(F.col("is_start") & (F.size("hashes") >= needed))
        .select(
            "doc_id", "_text", "k", "n", F.least("n", "m").alias("width"),
            F.col("pos").alias("start"), "hashes",
        )
    )


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY,
               radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text_hash, item_id, start_word, n_words, similarity)`` per document and item.

    One row for each document and item it contains, with its best window, the first among
    equals.  A document shorter than an item is one window.  Null and empty texts contain
    nothing, and an item without words is contained in nothing.  Repeated documents count
    once; documents that share an id but not the text count each for itself.
    """
    items = checkpointed(item_table(items))
    windows = _windows(docs, items, similarity)
    if windows is None:
        nothing = "doc_id {}, text_hash bigint, item_id {}, start_word int, n_words int, similarity double"
        kinds = (docs.schema["doc_id"].dataType, items.schema["item_id"].dataType)
        return docs.sparkSession.createDataFrame(
            [], nothing.format(*[k.simpleString() for k in kinds])
        )
    windows = checkpointed(windows)
    shape = ["k", "n", "width", "hashes"]
    # Equal windows are compared once, however many documents hold them.
    prints = checkpointed(windows.select(*shape).distinct().withColumn("fp", simhash(F.col("hashes"))))
    stored = items.withColumn("item_fp", simhash(F.col("item")))
    cut = prints.select(*shape, "fp", F.inline(blocks(F.col("fp"), radius)))
    index = stored.select(
        "item_id", "item", "item_fp", "k", "n", F.inline(blocks(F.col("item_fp"), radius))
    )
    near = (
        cut.join(index, ["k", "n", "block", "bits"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select(*shape, "item_id", "item")
        .distinct()
    )
    shared = shared_weight(F.col("hashes"), F.col("item"))
    alike = near.withColumn("_shared", shared).select(
        *shape,
        "item_id",
        (F.col("_shared") / (F.col("n") + F.col("width") - F.col("_shared"))).alias("similarity"),
    )
    found = windows.join(alike.where(F.col("similarity") >= similarity), shape)
    best = F.max(
        F.struct("similarity", (-F.col("start")).alias("back"), (F.col("width") + F.col("k") - 1)
                 .alias("n_words"))
    )
    return (
        found.groupBy("doc_id", "_text", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_id",
            F.col("_text").alias("text_hash"),
            "item_id",
            (-F.col("best.back")).alias("start_word"),
            F.col("best.n_words").alias("n_words"),
            F.col("best.similarity").alias("similarity"),
        )
    )


def leak_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, similarity)`` of all leaks."""
    return find_leaks(docs, items).select(
        "doc_id", "item_id", "start_word", "n_words", "similarity"
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with their own columns, of any names."""
    rows = own_names(docs, ("doc_id", "text"))
    leaks = find_leaks(rows, items)
    leaks = leaks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    marked = rows.withColumn("_text", F.xxhash64(fold(F.col("text"))))
    same = marked["doc_id"].eqNullSafe(leaks["_id"]) & (marked["_text"] == leaks["_hash"])
    kept = marked.join(leaks, same, "left_anti")
    return kept.select(*rows.columns).toDF(*docs.columns)
