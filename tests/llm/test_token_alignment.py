"""Token alignment against plain sets of bytes, and sparse products against dense ones."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palaver.llm.csr import Csr, intervals, memberships, row_products
from palaver.llm.token_alignment import Aligner, align_tokens, alignment_table, overlap_links

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
DOCS = "doc_id bigint, text string, row string, keys string"


def dense(m: Csr) -> np.ndarray:
    out = np.zeros((m.height, m.width), dtype=np.int64)
    for i in range(m.height):
        for j in range(m.starts[i], m.starts[i + 1]):
            out[i, m.columns[j]] += m.data[j]
    return out


def random_matrix(rng: np.random.Generator, height: int, width: int) -> Csr:
    full = rng.integers(0, 4, (height, width)) * (rng.random((height, width)) < 0.3)
    rows, columns = np.nonzero(full)
    starts = np.searchsorted(rows, np.arange(height + 1))
    return Csr(starts, columns, full[rows, columns], width)


def test_products():
    rng = np.random.default_rng(3)
    for size in (1, 3, 17):
        one, other = random_matrix(rng, size, 2 * size), random_matrix(rng, 2 * size, size + 1)
        expected = dense(one) @ dense(other)
        assert (dense(one.transposed()) == dense(one).T).all()
        for limit in (1, 7, 10_000):
            found = np.zeros_like(expected)
            for rows, columns, values in row_products(one, other, limit):
                assert len(set(zip(rows.tolist(), columns.tolist(), strict=True))) == len(rows)
                found[rows, columns] += values
            assert (found == expected).all()
    assert dense(intervals(np.array([2, 3]))).tolist() == [[1, 1, 0], [0, 0, 1]]
    assert dense(memberships(np.array([1, 0]), 2)).tolist() == [[0, 1], [1, 0]]


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(public_tokenizers.path(A))
    one.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    return one, other


def slow(text: str | None, libraries) -> tuple[list, list, list, int]:
    """Ids of both sides, groups, and overlaps, token by token."""
    one, other = libraries
    if not text:
        return [], [], [], 0
    letters = {}
    free = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            letters[chr(b)] = b
        else:
            letters[chr(free)], free = b, free + 1
    a = one.encode(" " + text, add_special_tokens=False)
    bytes_a = [bytes(letters[c] for c in t) for t in a.tokens]
    ids_b = other.encode(text)
    bytes_b = []
    for i in ids_b:
        piece = other.id_to_piece(i)
        byte = piece.startswith("<0x") and other.is_byte(i)
        bytes_b.append(bytes.fromhex(piece[3:5]) if byte else piece.replace("▁", " ").encode())
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], 0
    ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]), np.cumsum([len(t) for t in bytes_b])
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups, low = [], 0
    for cut in cuts:
        groups.append(
            (
                [i for i, e in zip(a.ids, ends_a, strict=True) if low < e <= cut],
                [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= cut],
            )
        )
        low = cut
    spans_a = list(zip([0, *ends_a[:-1]], ends_a, strict=True))
    spans_b = list(zip([0, *ends_b[:-1]], ends_b, strict=True))
    overlaps = sum(int(max(x[0], y[0]) < min(x[1], y[1])) for x in spans_a for y in spans_b)
    return a.ids, ids_b, groups, overlaps


def texts() -> list[str | None]:
    rng = random.Random(4)
    letters = [*"abcdeth  \n\t'’srlm.,!éß½12 Ω你好😀▁", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "the "]
    plain = [c for c in letters if c != "▁"]
    made = ["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(40)]
    made += ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(10)]
    return [None, "", " ", "a", "▁a", "the the the", *made, *made[:5]]


def test_ids_are_the_librarys(libraries):
    """Every letter in several surroundings, and long pieces."""
    own = Aligner(A, B).one
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    made = [f"a{c}a 1{c}1 !{c}! {c} x{c}" for c in letters[::7]]
    made += [c * 20_000 for c in "a \n!é"]
    found = libraries[0].encode_batch([" " + t for t in made], add_special_tokens=False)
    assert own.encode(made) == [e.ids for e in found]


def test_overlaps_share_bytes():
    a, b, shared = overlap_links(np.array([2, 5, 6]), np.array([1, 2, 6]))
    assert list(zip(a.tolist(), b.tolist(), shared.tolist(), strict=True)) == [
        (0, 0, 1), (0, 1, 1), (1, 2, 3), (2, 2, 1)
    ]


def test_query_matches_plain_counts(spark, libraries):
    rows = [(i if i % 9 else None, t, "x", None) for i, t in enumerate(texts())]
    found = alignment_table(spark.createDataFrame(rows, DOCS).repartition(3), A, B).collect()
    read = [slow(t, libraries) for _, t, _, _ in rows]
    links = [
        Counter((x, y) for ga, gb in groups for x in ga for y in gb) for _, _, groups, _ in read
    ]
    held = Counter(pair for some in links for pair in some)
    best: dict[int, int] = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    expected = []
    for (doc_id, _, _, _), (a, b, groups, overlaps), some in zip(rows, read, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        expected.append(
            (
                doc_id, len(a), len(b), len(groups), sum(some.values()),
                sum(n for (x, y), n in some.items() if held[x, y] == best[x]),
                sum(n * held[pair] for pair, n in some.items()),
                hashlib.sha256(text.encode()).hexdigest() if a else "", overlaps,
            )
        )
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert found[0].asDict().keys() == dict.fromkeys(
        "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256 n_overlaps".split()
    ).keys()


def test_rare_pairs_are_joined(spark, monkeypatch):
    """With hardly any frequent pair the sums are the same."""
    rows = [(i, t, None, None) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, DOCS)
    usual = sorted(map(tuple, alignment_table(docs, A, B).collect()))
    monkeypatch.setattr("palaver.llm.token_alignment.FREQUENT", 20)
    assert sorted(map(tuple, alignment_table(docs, A, B).collect())) == usual


def test_groups_and_long_texts(spark, libraries):
    long = "Words, wörds and 你好 words. " * 20_000
    rows = [(1, "the the", None, None), (2, long, None, None), (3, "x" * 50_000, None, None)]
    found = {r["doc_id"]: r for r in align_tokens(spark.createDataFrame(rows, DOCS), A, B).collect()}
    (a, _), (b, _) = slow("the the", libraries)[:2]
    assert found[1]["groups"] == f"{a}|{b};{a}|{b}" and list(found[1]["links"]) == [2]
    aligner = Aligner(A, B)
    for i, text in ((2, long), (3, "x" * 50_000)):
        one, other = aligner.tokens([text])
        assert (found[i]["n_a"], found[i]["n_b"]) == (len(one[0]), len(other[0]))
        assert sum(found[i]["links"]) == found[i]["n_links"] >= found[i]["n_overlaps"] > 0


def test_empty_table(spark):
    assert alignment_table(spark.createDataFrame([], DOCS), A, B).collect() == []
