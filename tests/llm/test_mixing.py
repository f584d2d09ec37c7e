"""Systematic mixing against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from palaver.llm.mixing import mix, mixing_table

DOCS = "doc_id bigint, text string, lang string, source string, size bigint, taken string"


def corpus(rows: int = 400) -> list[tuple]:
    rng = random.Random(8)
    names = ["b", "a", "Z", "é", None, "tiny", "empty"]
    out = []
    for i in range(rows):
        source = names[min(i % 9, 4)]
        out.append((i, " ".join(["w"] * rng.randint(0, 60)), None, source, 1, "x"))
    out += [(1000, "one\x0btwo\tthree", None, "tiny", None, None), (1001, None, None, "empty", 0, "")]
    return out + [(None, "a b", "en", "a", 1, "y"), out[5], out[5], out[5]]


def targets(sizes: dict) -> dict:
    """Shares by repeated resharing of what is cut off."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * sizes[s] - 1e-12}
        if not full:
            for s in open_:
                target[s] = level * weight[s]
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def size_of(text: str | None) -> int:
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_mix_of_every_document(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing_table(docs, 3).collect()
    assert sorted(map(repr, found)) == sorted(
        map(repr, mixing_table(docs.repartition(7), 3).collect())
    )
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    expected = targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken, grouped = defaultdict(int), defaultdict(list)
    assert len(found) == len(rows)
    for r in found:
        own = source[r.doc_id]
        assert r.source_size == sizes[own]
        assert r.target == pytest.approx(expected[own])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate)
        taken[own] += r.taken
        grouped[own].append(r.size)
    for own, words in taken.items():
        assert abs(words - expected[own]) <= 2 * max(grouped[own])


def test_copies_follow_the_prefix_sums(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), None, "ab"[i % 2], 1, "") for i in range(90)]
    found = {r.doc_id: r for r in mixing_table(spark.createDataFrame(rows, DOCS), 5).collect()}
    for own in "ab":
        part = []
        for i, text, _, source, _, _ in rows:
            if source == own:
                key = hashlib.md5(f"{i}|{source}|{text}".encode()).hexdigest()
                part.append((size_of(text), key, i))
        offset = int(hashlib.md5(f"5|{own}".encode()).hexdigest()[:8], 16) / 2**32
        rate = found[part[0][2]].target / found[part[0][2]].source_size
        for place, (_, _, i) in enumerate(sorted(part)):
            crossed = math.floor((place + 1) * rate + offset) - math.floor(place * rate + offset)
            assert found[i].copies == crossed


def test_mixed_rows_are_the_documents(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mix(docs, 3)
    assert mixed.columns == docs.columns
    copies = sum(r.copies for r in mixing_table(docs, 3).collect())
    got = mixed.collect()
    assert len(got) == copies and {tuple(r) for r in got} <= set(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing_table(docs).count() == 0 and mix(docs).count() == 0
