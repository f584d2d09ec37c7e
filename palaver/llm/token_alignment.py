"""Which tokens of two vocabularies cover the same bytes of a text.

Each tokenization is a sparse token-by-byte incidence matrix.  The row products of one with
the transposed other (Gustavson) are the overlap links: pairs of tokens with a byte in
common, and how many.  Where a link shares neither token with the link before it, both
tokenizations end a token at that byte; these cuts are the groups.  Token-by-group incidence
matrices multiplied the same way give the shared-group links: all pairs of tokens in one
group.  Texts of a batch are laid end to end, which makes block-diagonal matrices of them.

A pair of ids counts once per document that holds it linked.  Pairs of more than one in
``FREQUENT`` of all (document, pair) rows are fewer than ``FREQUENT`` and are looked up where
the documents are; the others meet their counts in a join.  Both add up to the same numbers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import stored
from palaver.llm.csr import Csr, intervals, memberships, row_products

# Bytes of text laid end to end, and texts read at a time.
BYTES, TEXTS = 1 << 17, 512
# The published pattern that cuts texts for this kind of vocabulary (fixed value).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pairs looked up in tasks are fewer than this.
FREQUENT = 100_000
# Pairs collected in a task before they are added up and handed on.
PAIRS = 4_000_000


def vocabulary_path(name: str) -> str:
    """A vocabulary file: a path, or the name of an installed public one."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class ByteBpe:
    """Byte-level BPE: token ids of texts, and the bytes of every id.

    ``tiktoken`` merges by the ids' order, which in such vocabularies is that of the merges.
    It cuts texts by the same pattern as the vocabulary's own library.
    """

    path: str

    def __post_init__(self) -> None:
        import tiktoken

        with open(vocabulary_path(self.path), encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if i not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        made = [ranks[raw("".join(pair))] for pair in pairs]
        if made != sorted(made):
            raise ValueError(f"{self.path}: ids do not follow the order of the merges")
        self.bytes_of = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, number in ranks.items():
            self.bytes_of[number] = token
        for number, token in special.items():
            self.bytes_of[number] = token.encode()
        self.encoding = tiktoken.Encoding(
            self.path, pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


@dataclass
class PieceBpe:
    """BPE over characters with byte fallback by its library; a space stands before a text."""

    path: str

    def __post_init__(self) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(self.path))
        self.model = model
        self.bytes_of = [
            bytes([int(model.id_to_piece(i)[3:5], 16)])
            if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def overlap_links(
    ends_a: np.ndarray, ends_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the tokens of every overlapping pair, and the bytes they share."""
    parts = list(row_products(intervals(ends_a), intervals(ends_b).transposed()))
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token of either side, from the overlap links, and their number."""
    if not len(a):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    new = (a[1:] != a[:-1]) & (b[1:] != b[:-1])
    group = np.concatenate([[0], np.cumsum(new)])
    in_a, in_b = np.empty(a[-1] + 1, np.int64), np.empty(b[-1] + 1, np.int64)
    in_a[a], in_b[b] = group, group
    return in_a, in_b, int(group[-1]) + 1


def group_links(
    in_a: np.ndarray, in_b: np.ndarray, groups: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of the tokens of every pair that shares a group, in bounded blocks."""
    by_group: Csr = memberships(in_b, groups).transposed()
    return row_products(memberships(in_a, groups), by_group)


@dataclass
class Alignment:
    """Some texts aligned: ids and groups of their tokens, and where each text's tokens end."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray
    overlaps: np.ndarray

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of shared-group links: number of the text, id of A, id of B."""
        text_of = np.repeat(np.arange(len(self.bounds_a) - 1), np.diff(self.bounds_a))
        groups = int(self.in_a[-1]) + 1 if len(self.in_a) else 0
        for a, b, _ in group_links(self.in_a, self.in_b, groups):
            yield text_of[a], self.ids_a[a], self.ids_b[b]


class Aligner:
    """Aligns texts by two vocabularies."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        self.one, self.other = ByteBpe(byte_bpe), PieceBpe(piece_bpe)
        self.size_a = np.array([len(t) for t in self.one.bytes_of], dtype=np.int64)
        self.size_b = np.array([len(t) for t in self.other.bytes_of], dtype=np.int64)
        # Each id with the sign that follows it inside a group, and at its side's end there.
        self.signs = [f"{i}," for i in range(len(self.size_a))]
        self.signs += [f"{i}|" for i in range(len(self.size_a))]
        self.signs += [f"{i}," for i in range(len(self.size_b))]
        self.signs += [f"{i};" for i in range(len(self.size_b))]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Both token lists of every text; none where the joined bytes are not space+text."""
        some = [t or "" for t in texts]
        one, other = self.one.encode(some), self.other.encode(some)
        for i, text in enumerate(some):
            raw = b" " + text.encode()
            bytes_a, bytes_b = self.one.bytes_of, self.other.bytes_of
            if (
                not text
                or b"".join([bytes_a[t] for t in one[i]]) != raw
                or b"".join([bytes_b[t] for t in other[i]]) != raw
            ):
                one[i], other[i] = [], []
        return one, other

    def align(self, one: list[list[int]], other: list[list[int]]) -> Alignment:
        ids_a = np.fromiter((t for x in one for t in x), dtype=np.int64)
        ids_b = np.fromiter((t for x in other for t in x), dtype=np.int64)
        bounds_a = np.concatenate([[0], np.cumsum([len(x) for x in one])]).astype(np.int64)
        bounds_b = np.concatenate([[0], np.cumsum([len(x) for x in other])]).astype(np.int64)
        a, b, _ = overlap_links(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))
        in_a, in_b, _ = groups_of(a, b)
        overlaps = np.diff(np.searchsorted(a, bounds_a))
        return Alignment(ids_a, ids_b, in_a, in_b, bounds_a, bounds_b, overlaps)

    def written(self, found: Alignment) -> list[str]:
        """The groups of every text, as ``a1,a2|b1;a3|b2,b3``."""
        many_a, many_b = len(self.size_a), len(self.size_b)
        last_a = np.append(found.in_a[1:] != found.in_a[:-1], True)[: len(found.in_a)]
        last_b = np.append(found.in_b[1:] != found.in_b[:-1], True)[: len(found.in_b)]
        sign_a = found.ids_a + many_a * last_a
        sign_b = found.ids_b + 2 * many_a + many_b * last_b
        order = np.argsort(np.concatenate([2 * found.in_a, 2 * found.in_b + 1]), kind="stable")
        signs = list(map(self.signs.__getitem__, np.concatenate([sign_a, sign_b])[order].tolist()))
        bounds = (found.bounds_a + found.bounds_b).tolist()
        return ["".join(signs[x:y])[:-1] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def pairs(self, found: Alignment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, pair key and links of every pair of ids linked in a text."""
        wide = np.int64(len(self.size_b))
        space = np.int64(len(self.size_a)) * wide
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for text, a, b in found.links():
            held.append(np.unique(text * space + a * wide + b, return_counts=True))
            size += len(held[-1][0])
            if size > PAIRS:
                held, size = [_summed(held)], 0
        key, links = _summed(held)
        return key // space, key % space, links


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up by key; keys ascending."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    key = np.concatenate([p[0] for p in parts])
    count = np.concatenate([p[1] for p in parts])
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, weights=count, minlength=len(key)).astype(np.int64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``BYTES`` characters together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BYTES or i + 1 - start >= TEXTS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def align_tokens(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Per document its tokens' groups and linked id pairs.

    Columns: ``row`` (a number of the row), ``doc_id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links`` (token pairs that share a group), ``n_overlaps`` (that share a byte),
    ``groups`` (``a1,a2|b1;a3|b2,b3``), ``keys`` (distinct linked id pairs, A's id times the
    size of B's vocabulary plus B's id) and ``links`` (how often each is linked).

    A text that is null or empty, or whose tokens of either side are not its bytes after one
    space, has no tokens: zeros, an empty text and empty arrays.  Repeated rows give repeated
    rows; other columns are not read.  A long text takes memory by its own length and by its
    distinct pairs; the products over it are taken in blocks.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row bigint, doc_id {doc_id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "n_overlaps bigint, groups string, keys array<bigint>, links array<bigint>"
    )
    target = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        aligner, arrow = None, to_arrow_schema(target)
        for batch in batches:
            aligner = aligner or Aligner(byte_bpe, piece_bpe)
            texts = batch.column(2).to_pylist()
            for start, end in _slices(texts):
                found = aligner.align(*aligner.tokens(texts[start:end]))
                text, key, links = aligner.pairs(found)
                at = np.searchsorted(text, np.arange(end - start + 1))
                groups = np.append(found.in_a[1:] != found.in_a[:-1], True)[: len(found.in_a)]
                columns = [
                    batch.column(0).slice(start, end - start),
                    batch.column(1).slice(start, end - start),
                    np.diff(found.bounds_a),
                    np.diff(found.bounds_b),
                    np.diff(np.concatenate([[0], np.cumsum(groups)])[found.bounds_a]),
                    np.diff(np.concatenate([[0], np.cumsum(links)])[at]),
                    found.overlaps,
                    aligner.written(found),
                    pa.ListArray.from_arrays(at.astype(np.int32), key),
                    pa.ListArray.from_arrays(at.astype(np.int32), links),
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                        for c, f in zip(columns, arrow, strict=True)
                    ],
                    schema=arrow,
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, target)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``(key, n, best)``: documents that hold a pair linked, and the most of its A id's pairs.

    ``width`` is the size of B's vocabulary.
    """
    counts = aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n")
    )
    a = F.floor(F.col("key") / width)
    counts = stored(counts.withColumn("a", a))
    most = counts.groupBy("a").agg(F.max("n").alias("best"))
    return counts.join(most, "a").select("key", "n", "best")


def alignment_table(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """``align_tokens`` with two corpus-wide sums per document, without rows' numbers and pairs.

    ``n_best`` is the links whose pair is held by as many documents as any pair of its A id,
    ``count_sum`` the sum of the pairs' document counts over the links.  ``groups_sha256``
    stands for ``groups``: its SHA-256, or the empty text for no tokens.  Documents without
    tokens have zeros.
    """
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = align_tokens(docs, byte_bpe, piece_bpe).withColumn("groups", digest)
    aligned = stored(aligned.withColumnRenamed("groups", "groups_sha256"))
    width = len(PieceBpe(piece_bpe).bytes_of)
    pairs = stored(pair_counts(aligned, width))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") > total / FREQUENT
    # Fewer than FREQUENT pairs, as each holds more than one in FREQUENT of all rows.
    known = F.broadcast(pairs.where(frequent))
    linked = aligned.select("row", F.explode(F.arrays_zip("keys", "links")).alias("one"))
    linked = linked.select("row", F.col("one.keys").alias("key"), F.col("one.links").alias("links"))
    rare = linked.join(known, "key", "left_anti").join(pairs.where(~frequent), "key")
    best = F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)
    sums = (
        linked.join(known, "key")
        .unionByName(rare)
        .groupBy("row")
        .agg(F.sum(best).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    )
    return aligned.join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0).cast("bigint")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("bigint")).alias("count_sum"),
        "groups_sha256",
        "n_overlaps",
    )
