"""Groups of similar texts against all pairs."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
import palaver.llm.similar_texts as similar

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text: str | None) -> frozenset:
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1) if words)


def slow_groups(texts: list[str | None]) -> list[int]:
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (x == y or len(x & y) >= 0.8 * len(x | y)) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if a == old else a for a in label]
    return label


def corpus() -> list[tuple]:
    """Copies at similarities on both sides of 0.8, a star of copies and a chain."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts: list[str | None] = []
    for i in range(40):
        text = rng.choices(words, k=rng.choice([60, 200, 1000]))
        near = [*text]
        for at in rng.sample(range(len(text)), max(1, round(len(text) * rng.choice([0.005, 0.015, 0.03])))):
            near[at] = rng.choice(words)
        texts += [" ".join(text), " ".join(near).upper()]
    hub = rng.choices(words, k=60)
    for _ in range(90):  # each near the hub, few near each other
        near = [*hub]
        near[rng.randrange(8, 52)] = rng.choice(words)
        texts.append(" ".join(near))
    texts.append(" ".join(hub))
    texts += [None, "", "one two", "ONE  two", "one three"]
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


def test_near_duplicate_stage_keeps_one_of_each_group_of_all_pairs(spark):
    rows = corpus()
    labels = slow_groups([r[1] for r in rows])
    assert 20 < len(set(labels)) < len(rows) - 90
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(labels))


def test_fingerprints_bring_texts_together(spark, monkeypatch):
    """Without a pair from the bands, SimHash still links close texts, and Jaccard judges them."""
    def nothing(rows, pick, similarity):
        return rows.selectExpr("node as a", "node as b").where("false")

    monkeypatch.setattr(similar, "compared", nothing)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(20):
        text = rng.choices(words, k=1000)
        rows += [(2 * i, " ".join(text), "en", "s", None)]
        rows += [(2 * i + 1, " ".join([*text, "end"]), "en", "s", None)]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    kept = {r.doc_id for r in found.collect()}
    assert {2 * i for i in range(20)} <= kept and len(kept) <= 22
    prints = similar.signatures(spark.createDataFrame(rows, DOCS), ["doc_id"], 5, 32, 6)
    assert len({r.fp for r in prints.collect()}) >= 20
