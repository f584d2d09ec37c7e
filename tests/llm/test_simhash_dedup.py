"""SimHash near duplicates against all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

import palaver.llm.simhash_dedup as simhash
from palaver.llm.simhash_dedup import (
    fingerprint,
    fingerprint_links,
    keep_one_per_group,
    near_duplicates,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string"


def slow_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    width = min(3, len(words))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: list[int]) -> list[int]:
    """Position of the first member of each one's component."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


@pytest.mark.parametrize(
    "text",
    [None, "", " \n", "one", "Two words", "a b c", "É È A\x0bB\xa0c d", "x " * 70_000 + "y z"],
)
def test_fingerprint(text):
    assert fingerprint(text or "") == slow_fingerprint(text)


@pytest.mark.parametrize("bucket", [2048, 12, 9])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        one = rng.getrandbits(64)
        for _ in range(25):
            prints.add(one)
            for _ in range(rng.randint(1, 4)):
                one ^= 1 << rng.randrange(64)
    # A cluster that agrees in one half and fills the buckets of that half.
    base = rng.getrandbits(32) << 32
    prints |= {base | rng.getrandbits(6) | rng.getrandbits(3) << 20 for _ in range(60)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in fingerprint_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    label = {p: p for p in prints}
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {p: new if x == old else x for p, x in label.items()}
    firsts = slow_components(prints)
    assert [label[p] for p in prints] == [prints[i] for i in firsts]


def corpus() -> list[tuple]:
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        rows.append((i, " ".join(text), "en", "a", 1, "x"))
        near = [*text]
        near[rng.randrange(len(near))] = "other"
        rows.append((1000 + i, " ".join(near).upper(), None, None, None, None))
        if i % 7 == 0:
            rows.append((i, " ".join(text), "en", "a", 1, "x"))
    rows += [(500, None, None, None, None, None), (501, "", "en", "a", 0, "x")]
    return rows + [(None, " ".join(words), None, None, None, None)]


def test_near_duplicates_match_all_pairs(spark):
    rows = corpus()
    prints = [slow_fingerprint(r[1]) for r in rows]
    labels = slow_components(prints)
    expected = []
    for row, value, label in zip(rows, prints, labels, strict=True):
        ids = [r[0] for r, x in zip(rows, labels, strict=True) if x == label and r[0] is not None]
        expected.append((row[0], f"{value:016x}", min(ids, default=None)))
    found = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    labels = slow_components([slow_fingerprint(r[1]) for r in rows])
    docs = spark.createDataFrame(rows, DOCS)
    kept = [tuple(r) for r in keep_one_per_group(docs).collect()]
    assert len(kept) == len(set(labels))
    expected = {
        min((r[0] is None, r[0] or 0) for r, x in zip(rows, labels, strict=True) if x == label)
        for label in set(labels)
    }
    assert {(r[0] is None, r[0] or 0) for r in kept} == expected
    assert set(kept) <= set(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near_duplicates(docs).count() == 0
    assert keep_one_per_group(docs).columns == docs.columns
