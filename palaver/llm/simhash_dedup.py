"""SimHash near duplicates by deletion variants of fingerprint segments.

Two 64-bit fingerprints within three bits have a half that differs in at most one bit.  So
each half is indexed once per bit with that bit deleted: halves that differ in at most one
bit agree in a variant.  Fingerprints with an equal variant meet in a bucket and are
verified there.

A bucket leaves the other half free and could grow without bound.  One beyond ``BUCKET``
distinct fingerprints is cut again by the same argument on the half that is still free,
and once more on the quarter left then.  At that depth 8 bits and three deleted ones are
free, so a bucket has at most 2048 members: no bucket is too large for a task, and no link
is given up.  A bucket yields links that connect what it connects, not all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpointed, map_rows, own_names, stored
from palaver.llm.components import connected_components
from palaver.llm.similar_texts import BANDS, ROWS, SIMILARITY, few, majority, signatures
from palaver.llm.similar_texts import SHINGLE as SIMILAR_SHINGLE
from palaver.llm.similar_texts import similar_groups

SHINGLE = 3
SEED = 42
RADIUS = 3
WIDTHS = (32, 16, 8)
BUCKET = 2048
# Groups up to this size are compared pair by pair in array operations.
SMALL = 8


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text, as an unsigned number; 0 without words.

    A-Z are lower-cased; words are separated by space and the control characters 9 to 13.
    A text of fewer words than a shingle is one shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in spans),
        dtype=np.uint64,
        count=len(words) - width + 1,
    )
    return majority(hashes)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns to keep and ``fp``, the fingerprint as a signed 64-bit number."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            found = np.array([fingerprint(t or "") for t in rows["_text"]], dtype=np.uint64)
            yield {c: rows[c] for c in keep} | {"fp": found.view(np.int64).tolist()}

        return step

    return map_rows(
        docs.select(*keep, F.col("text").alias("_text")), f"{kinds}, fp bigint", make
    )


def variants(rows: DataFrame, width: int) -> DataFrame:
    """``(key, gone, fp)``: one row per deletion variant.

    ``rows`` has ``fp``, and from the level before ``key`` and ``gone``, the deleted bit.
    The field next to the one that held ``gone`` is still free; it is cut into two of
    ``width`` bits, and each of its bits is deleted in turn.
    """
    if width == WIDTHS[0]:
        start, before = F.lit(0), F.lit(0).cast("bigint")
    else:
        span = 2 * width
        start = F.floor(F.col("gone") / span).cast("int") * span
        start, before = start.bitwiseXOR(F.lit(span)), F.col("key")
    bits = rows.select(
        before.alias("_before"),
        "fp",
        F.explode(F.sequence(start, start + 2 * width - 1)).alias("gone"),
    )
    field = F.floor(F.col("gone") / width).cast("int") * width
    value = F.expr(f"shiftrightunsigned(fp, _field) & {2**width - 1}L")
    cut = bits.withColumn("_field", field).withColumn("_value", value)
    cut = cut.withColumn("_value", F.expr("_value & ~shiftleft(1L, gone - _field)"))
    key = F.xxhash64("_before", "gone", "_value")
    return cut.select(key.alias("key"), "gone", "fp")


def _pairs(key: np.ndarray, gone: np.ndarray, fp: np.ndarray, width: int) -> list[np.ndarray]:
    """Links inside groups of at most ``SMALL`` rows, by comparing neighbours."""
    out, at, step = [], np.arange(len(key)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        apart = fp[at] ^ fp[at + step]
        near = np.bitwise_count(apart) <= RADIUS
        # Pairs that agree in the whole field meet in all its variants; one will do.
        bit = (apart >> gone[at].astype(np.uint64)) & np.uint64(1)
        near &= (bit == 1) | (gone[at] % width == 0)
        out.append(np.stack([fp[at[near]], fp[at[near] + step]], axis=1))
        step += 1
    return out


def _spanning(fp: np.ndarray) -> list[np.ndarray]:
    """Links that connect the fingerprints of one group as all its links would."""
    out, left = [], fp
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            one = waiting.pop()
            near = np.bitwise_count(left ^ one) <= RADIUS
            if near.any():
                found = left[near]
                out.append(np.stack([np.full(len(found), one), found], axis=1))
                waiting.extend(found)
                left = left[~near]
    return out


def _links(key: np.ndarray, gone: np.ndarray, fp: np.ndarray, width: int) -> np.ndarray:
    """Links of whole groups; rows are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    some = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    out = _pairs(key[some], gone[some], fp[some], width)
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        group = fp[start : start + size]
        bit = (group >> np.uint64(gone[start])) & np.uint64(1)
        if gone[start] % width == 0 or bit.min() != bit.max():
            out += _spanning(group)
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.uint64)


def bucket_links(keyed: DataFrame, width: int) -> DataFrame:
    """``(linked, a, b, gone)``: links between fingerprints, and rows left to cut again.

    With ``linked`` the row links fingerprints a and b; without, key a with fingerprint b
    belongs to a bucket beyond the limit.
    """
    last = width == WIDTHS[-1]
    schema = "linked boolean, a bigint, b bigint, gone int"
    arrow = pa.schema(
        [("linked", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("gone", pa.int32())]
    )

    def pack(linked: bool, a: np.ndarray, b: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(a), linked), a.view(np.int64), b.view(np.int64), gone]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int32, np.uint64)]
        large = None  # the key of a bucket found to be beyond the limit
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                key, gone, fp = held
                cut = len(key)
            else:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                new[2] = new[2].view(np.uint64)
                key, gone, fp = (np.concatenate(x) for x in zip(held, new, strict=True))
                cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
            sizes = np.diff(np.append(starts, len(key)))
            over = np.zeros(len(key), dtype=bool)
            if not last:
                over = np.repeat(sizes > BUCKET, sizes)
                if large is not None:
                    over |= key == large
            if over.any():
                large = key[-1] if over[-1] else None
                yield pack(False, key[over], fp[over], gone[over])
            done = ~over
            done[cut:] = False
            if done.any():
                links = _links(key[done], gone[done], fp[done], width)
                if len(links):
                    a, b = links[:, 0].copy(), links[:, 1].copy()
                    yield pack(True, a, b, np.zeros(len(a), dtype=np.int32))
            rest = ~over
            rest[:cut] = False
            held = [key[rest], gone[rest], fp[rest]]

    by_key = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return by_key.mapInArrow(run, schema)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints within the radius.

    ``prints`` has distinct ``fp``.
    """
    rows, links = prints.select("fp"), []
    for width in WIDTHS:
        found = checkpointed(bucket_links(variants(rows, width), width))
        links.append(found.where("linked").select("a", "b"))
        rows = found.where("not linked").select(F.col("a").alias("key"), "gone", F.col("b").alias("fp"))
        if rows.isEmpty():
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components_of(printed: DataFrame) -> DataFrame:
    """``(fp, component_id)`` of every distinct fingerprint of ``(doc_id, fp)`` rows.

    Copies fall together before anything is compared.  The component's id is its least
    ``doc_id``; ids that are null do not count.
    """
    prints = checkpointed(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    members = connected_components(fingerprint_links(prints), "a", "b")
    known = members.join(prints.withColumnRenamed("fp", "node"), "node")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = members.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    joined = prints.join(linked, "fp", "left")
    return checkpointed(joined.select("fp", F.coalesce("component_id", "first").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document.

    Texts without words, null ones too, share fingerprint zero and are linked like any
    other.  Repeated rows give repeated rows.  A component of null ids only has a null id.
    """
    printed = checkpointed(fingerprints(docs, ["doc_id"]))
    labelled = printed.join(components_of(printed), "fp")
    return labelled.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One document of every component, with its own columns.

    The one with the least ``doc_id`` stays, null last; ties fall to a hash of the row,
    and of wholly equal rows one stays.
    """
    rows = own_names(docs, ("doc_id", "text"))
    hashed = rows.select("doc_id", F.xxhash64(*rows.columns).alias("_row"), "text")
    printed = checkpointed(fingerprints(hashed, ["doc_id", "_row"]))
    kept = _least_of_groups(rows, printed.join(_representatives(printed), "fp"))
    return kept.toDF(*docs.columns)


def keep_one_similar(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE
) -> DataFrame:
    """One document of every group of similar texts, chosen as in ``keep_one_per_group``.

    Texts are linked whose sets of word shingles have at least the Jaccard similarity: those
    that ``fingerprint_links`` brings together, and those that meet in MinHash bands.  The
    columns may have any names.  Null and empty texts have no shingle and are copies of one
    another; a text is read whole, however long.
    """
    key = ["doc_id", "_row"]
    rows = own_names(docs, ("doc_id", "text"))
    hashed = rows.select("doc_id", F.xxhash64(*rows.columns).alias("_row"), "text")
    printed = stored(signatures(hashed, key, shingle, BANDS, ROWS))
    groups = similar_groups(hashed, printed, key, fingerprint_links, similarity, shingle)
    kept = _least_of_groups(rows, printed.select(*key, "node").join(groups, "node"))
    return kept.toDF(*docs.columns)


def _least_of_groups(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The document that stays of each ``_group`` of ``(doc_id, _row)``.

    Documents that go, and those of wholly equal rows, are looked up by their keys; all
    others stay where they are.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_row")
    kept = labelled.groupBy("_group").agg(F.min(rank).alias("kept"))
    # Structs are equal where their nulls are.
    kept = kept.select(F.struct("kept.doc_id", "kept._row").alias("_key"))
    key = F.struct("doc_id", "_row").alias("_key")
    rows = labelled.select(key).groupBy("_key").agg(F.count(F.lit(1)).alias("rows"))
    judged = rows.join(kept.withColumn("stays", F.lit(True)), "_key", "left")
    single = (F.col("rows") == 1) & F.col("stays").isNotNull()
    others = stored(judged.where(~single).select("_key", F.col("stays").isNotNull().alias("stays")))
    marked = docs.withColumn("_key", F.struct("doc_id", F.xxhash64(*docs.columns).alias("_row")))
    left = marked.join(few(others.select("_key")), "_key", "left_anti")
    again = marked.join(few(others.where("stays").select("_key")), "_key", "left_semi")
    return left.unionByName(again.dropDuplicates(["_key"])).select(*docs.columns)


def _representatives(printed: DataFrame) -> DataFrame:
    """``(fp, _group)``: the component of each fingerprint, by one of its fingerprints."""
    prints = checkpointed(printed.select("fp").distinct())
    members = connected_components(fingerprint_links(prints), "a", "b")
    joined = prints.join(members, prints["fp"] == members["node"], "left")
    return checkpointed(
        joined.select("fp", F.coalesce("component", "fp").alias("_group"))
    )
