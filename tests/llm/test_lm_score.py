"""Language-model scores against plain sums, and the tree against its definition."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

import palaver.llm.lm_score as lm
from palaver.llm.lm_score import CODE_POINTS, START, STOP, SuffixTree, lm_scores

DOCS = "doc_id bigint, text string, word string, n string"


def is_held(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b""]


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeÉé", k=rng.randint(1, 7))) for _ in range(80)]
    rows = [
        (i, " ".join(rng.choices(words, weights=range(1, 81), k=rng.randint(1, 60))), None, "x")
        for i in range(150)
    ]
    rows += [(200, None, None, None), (201, "", None, None), (None, "abc new", "w", "n")]
    return rows + [(202, "Ünseen 你好\x0bABC " * 3_000, None, None), rows[3], rows[3]]


@pytest.mark.parametrize("share", [1e-6, 0.02])
def test_base_counts_and_scores(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "FREQUENT_SHARE", share)
    rows = corpus()
    counts = Counter(t for r in rows if not is_held(r[0]) for t in tokens(r[1]))
    total = sum(counts.values())
    found = lm_scores(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(r[0]) for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for row in found:
        own = tokens(texts[row.doc_id])
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in own)
        assert row.held_out == is_held(row.doc_id)
        assert (row.n_tokens, row.train_tokens) == (len(own), total)
        assert row.n_known == sum(counts[t] > 0 for t in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.score < 0
    # The tree has learned something about texts it has not seen.
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 150]
    assert sum(r.score for r in held) > 0.6 * sum(
        len(texts[r.doc_id]) * -math.log10(7) for r in held
    ) * 2


def test_tree_is_a_distribution_and_uses_the_longest_suffix(spark):
    rows = [(w, n) for w, n in [("", 5), ("aba", 400), ("abb", 300), ("ba", 900), ("ca", 50)]]
    grams = lm.suffix_counts(spark.createDataFrame(rows, "word string, n bigint")).cache()
    brute = Counter()
    for word, n in rows:
        marked = START + word + STOP if word else START + lm.END
        for at in range(1, len(marked)):
            for low in range(max(0, at - lm.DEPTH), at + 1):
                brute[marked[low:at], marked[at]] += n
    assert {(r.context, r.symbol): r.n for r in grams.collect()} == brute
    kept = lm.tree_rows(spark.createDataFrame(rows, "word string, n bigint"))
    assert {(c, s): n for c, s, n in kept}.items() <= brute.items()
    tree = SuffixTree(kept)
    seen = sorted({s for _, s, _ in kept})
    for context in tree.seen:
        inside = sum(10 ** tree.log10(context, s) for s in seen)
        rest = (CODE_POINTS - len(seen)) * 10 ** tree.log10(context, "\U0001f600")
        assert inside + rest == pytest.approx(1.0, abs=1e-9)
    by_hand, history = 0.0, START
    for symbol in "abba" + STOP:
        by_hand += tree.log10(tree.longest(history[-lm.DEPTH :]), symbol)
        history += symbol
    assert tree.word("abba") == pytest.approx(by_hand)
    assert tree.word("aba") > tree.word("bbb") > tree.word("zzz")


def test_contexts_grow_with_the_corpus(spark, monkeypatch):
    rng = random.Random(3)
    sizes = []
    for times in (1, 40):
        # A letter is doubled at odd places, so longer suffixes tell more.
        texts = ["".join(rng.choices("abcdefghij", weights=range(1, 11), k=6)) for _ in range(300)]
        words = ["".join(x if i % 2 else x * 2 for i, x in enumerate(t)) for t in texts]
        rows = spark.createDataFrame([("", 20)] + [(w, times) for w in words], "word string, n bigint")
        sizes.append(len({c for c, _, _ in lm.tree_rows(rows)}))
    assert sizes[1] > 3 * sizes[0] > 10
    every = sum(c != "" for c, _, _ in lm.tree_rows(rows))
    monkeypatch.setattr(lm, "TREE_ROWS", every // 2)
    kept = lm.tree_rows(rows)
    assert 0 < sum(c != "" for c, _, _ in kept) <= every // 2 and any(c == "" for c, _, _ in kept)


@pytest.mark.parametrize("share", [1e-6, 0.02])
def test_a_tree_beyond_the_tasks_is_joined_whole(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "LEAST_COUNT", 10)
    monkeypatch.setattr(lm, "LEAST_GAIN", 1.0)
    monkeypatch.setattr(lm, "FREQUENT_SHARE", share)
    docs = spark.createDataFrame(corpus(), DOCS)

    def scores():
        return sorted((repr(r.doc_id), r.n_known, r.base_score, r.score) for r in lm_scores(docs).collect())

    held = scores()
    monkeypatch.setattr(lm, "TREE_ROWS", 20)
    joined = scores()
    assert [r[:2] for r in joined] == [r[:2] for r in held]
    for one, other in zip(held, joined, strict=True):
        assert one[2:] == pytest.approx(other[2:], rel=1e-9)


def test_empty_tables(spark):
    assert lm_scores(spark.createDataFrame([], DOCS)).count() == 0
    only_held = [(i, "a b", None, None) for i in range(200) if is_held(i)]
    found = lm_scores(spark.createDataFrame(only_held, DOCS)).collect()
    assert len(found) == len(only_held)
    assert all(r.n_known == 0 and r.base_score == pytest.approx(0) for r in found)
