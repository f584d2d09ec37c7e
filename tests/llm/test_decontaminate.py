"""Benchmark decontamination against every window of every document."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import palaver.llm.decontaminate as dec
from palaver.llm.decontaminate import blocks, drop_leaks, find_leaks, leak_table, simhash

DOCS = "doc_id bigint, text string, item_id string, k int, hashes string"
ITEMS = "item_id bigint, text string, doc_id string"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words: list[str], k: int) -> list[tuple]:
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def best_similarity(text: str | None, item: str | None) -> float:
    """The best window of all, whatever its place."""
    words, own = words_of(text), words_of(item)
    k = min(5, len(own))
    if not k:
        return 0.0
    inside, wanted = shingles(words, k), Counter(shingles(own, k))
    n, best = wanted.total(), 0.0
    for at in range(max(1, len(inside) - n + 1)):
        window = Counter(inside[at : at + n])
        shared = (window & wanted).total()
        best = max(best, shared / (n + window.total() - shared))
    return best


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(12, 60))), "x") for i in range(12)]
    items += [(20, "short one", None), (21, "alone", None), (22, "", None), (23, None, None)]
    items += [(24, "la la la la la la la la", None), items[0], (None, items[1][1], None)]
    rows = []
    for i in range(60):
        body = rng.choices(words, k=rng.randint(0, 150))
        if i % 3 == 0:
            part = items[i % 12][1].split()
            if i % 2:  # near copies, some too far off
                for _ in range(rng.randint(1, 2)):
                    part[rng.choice([0, 1, len(part) // 2, -1])] = "changed"
            if i % 5 == 0:
                part = [*part[len(part) // 2 :], *part[: len(part) // 2]]
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
        rows.append((i, " ".join(body), "y", 1, None))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "Alone", "", 0, "")]
    rows += [(103, "a short one here", None, None, None), (104, "la " * 3_000, None, None, None)]
    rows += [(105, " ".join(items[2][1].split()[:-1]), None, None, None), rows[0], rows[0]]
    return [*rows, (None, items[3][1], None, None, None), (0, "other text", None, None, None)], items


@pytest.mark.parametrize("broadcast", [1_000_000, 1])
def test_leaks_match_every_window(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dec, "BROADCAST_SHINGLES", broadcast)
    rows, items = corpus()
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    expected = {}
    for doc_id, text, *_ in set(rows):
        for item_id, item, _ in set(items):
            value = best_similarity(text, item)
            if value >= 0.8:
                expected[doc_id, item_id] = max(value, expected.get((doc_id, item_id), 0))
    found = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(docs, marked).collect()}
    assert found == pytest.approx(expected)
    assert len(found) > 15
    kept = drop_leaks(docs, marked)
    leaking = {d for d, _ in expected}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(
        r[0] for r in rows if r[0] and r[0] not in leaking
    )
    # Only the text that leaks goes, not another one with its id.
    assert "other text" in {r.text for r in kept.where("doc_id = 0").collect()}


def test_places(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e f z", None, None, None)], DOCS)
    items = spark.createDataFrame([(5, "A, b c d e f.", None)], ITEMS)
    assert [tuple(r) for r in leak_table(docs, items).collect()] == [(1, 5, 2, 6, 1.0)]


def test_blocks_cover_and_guarantee(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        one = rng.getrandbits(64)
        other = one
        for bit in rng.sample(range(64), dec.RADIUS):
            other ^= 1 << bit
        rows.append((one - (1 << 63), other - (1 << 63)))
    frame = spark.createDataFrame(rows, "a bigint, b bigint")
    cut = frame.select(
        F.size(F.array_intersect(blocks(F.col("a"), dec.RADIUS), blocks(F.col("b"), dec.RADIUS)))
        .alias("n")
    )
    assert all(r.n >= 1 for r in cut.collect())


def test_simhash(spark):
    rng = random.Random(2)
    rows = [([rng.getrandbits(63) * rng.choice([1, -1]) for _ in range(n)],) for n in (1, 2, 7, 40)]
    frame = spark.createDataFrame(rows, "h array<bigint>").select("h", simhash(F.col("h")).alias("s"))
    for r in frame.collect():
        ones = [sum(x >> b & 1 for x in r.h) for b in range(64)]
        value = sum(1 << b for b, n in enumerate(ones) if 2 * n > len(r.h))
        assert r.s % (1 << 64) == value


def test_empty_tables(spark):
    rows, items = corpus()
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    assert leak_table(docs.where("false"), marked).count() == 0
    assert leak_table(docs, marked.where("false")).count() == 0
    assert drop_leaks(docs, marked.where("false")).count() == docs.count()
