"""Quality rules against plain counts; the forest on planted anomalies."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm.quality import (
    SHARES,
    Forest,
    expected_path,
    fit,
    keep_good,
    quality_table,
    statistics,
    threshold,
    threshold_of,
)

DOCS = "doc_id bigint, text string, lang string, quality string, kept string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def plain(text: str | None) -> list[int]:
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup_lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(words), sum(map(len, words)), symbols, dup_lines, len(covered)]


def test_counts_match_plain_ones():
    rng = random.Random(1)
    texts = ["", " \n\n ", "a", "a a a", "a a a a", "é\x0b|x\na\na\n a\n\n", "a b c a b c x a b"]
    texts += [
        "".join(rng.choices(["a", "b", "Ab", " ", "\n", "#", "\t", "é"], k=rng.randint(0, 120)))
        for _ in range(200)
    ]
    for text in texts:
        assert statistics(text)[0] == plain(text), repr(text)


def test_forest_isolates_what_lies_apart():
    rng = np.random.default_rng(0)
    usual = rng.normal(size=(2_000, 3))
    forest = Forest(usual)
    scores = forest.scores(np.vstack([usual[:100], np.full((1, 3), 9.0)]))
    assert scores[-1] > scores[:-1].max()
    assert forest.scores(usual).mean() == pytest.approx(0.45, abs=0.08)
    assert expected_path(1) == 0 and expected_path(2) == pytest.approx(0.154, abs=0.001)
    assert Forest(np.ones((5, 2))).scores(np.ones((1, 2))).shape == (1,)


def test_threshold_spares_good_rows():
    good, bad = np.linspace(0.3, 0.6, 1_000), np.array([0.5, 0.7, 0.8])
    cut = threshold(good, bad, loss=0.0)
    assert 0.6 < cut < 0.7
    spared = threshold(np.append(good, [0.65, 0.9]), bad, loss=0.01)
    assert 0.65 < spared < 0.7
    assert threshold(good, np.array([])) == np.inf and threshold(np.array([]), bad) == np.inf


def test_threshold_of_a_table_is_that_of_arrays(spark):
    rng = np.random.default_rng(2)
    for good, bad in ((3_000, 40), (3_000, 0), (0, 40), (1, 1)):
        one, other = rng.uniform(0.3, 0.6, good).round(3), rng.uniform(0.4, 0.8, bad).round(3)
        rows = [(False, float(x)) for x in one] + [(True, float(x)) for x in other]
        table = spark.createDataFrame(rows, "bad boolean, anomaly double")
        for loss in (0.0, 0.01):
            assert threshold_of(table, loss) == pytest.approx(threshold(one, other, loss))


def test_every_labelled_document_counts(spark):
    """Among 30,000 labelled documents, the few odd ones set the threshold whatever their ids."""
    shares = [F.lit(0.0) + F.rand(i) / 10 for i in range(len(SHARES))]
    usual = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"),
        *[s.alias(c) for c, s in zip(SHARES, shares, strict=True)],
    )
    measured = usual.localCheckpoint()
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    last = labels.orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]
    odd = F.col("doc_id") == last
    strange = measured.select(
        "doc_id", "n_words", "n_repeat_words", *[F.when(odd, 9.0).otherwise(F.col(c)).alias(c) for c in SHARES]
    )
    marked = labels.withColumn("quality", F.when(odd, 0).otherwise(1))
    forest, most = fit(strange, marked)
    assert most < forest.scores(np.full((1, len(SHARES)), 9.0))[0]


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        chosen = rng.choices(words, k=rng.randint(60, 200))
        text = " | ".join(chosen) if i % 12 == 0 else " ".join(chosen)
        rows.append((i, text, "en", "x", None))
        if i % 2 == 0:
            labels.append((i, int(i % 12 != 0), 0, "t"))
    rows += [(900, None, None, None, None), (901, "too short", None, None, None)]
    rows += [(None, " ".join(words), None, "q", "k"), (902, "a b c d " * 5_000, None, None, None)]
    rows += [rows[3], rows[3]]
    return rows, [*labels, (None, 0, 0, None), (1, None, None, None), (2, 1, 0, "t")]


def test_every_document_is_judged(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    marked = spark.createDataFrame(labels, LABELS)
    found = quality_table(docs, marked).collect()
    counts = [(r.doc_id, *[r[i] for i in range(1, 6)]) for r in found]
    assert sorted(counts, key=repr) == sorted([(r[0], *plain(r[1])) for r in rows], key=repr)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in found}
    bad = [i for i in range(500) if i % 12 == 0]
    assert not any(verdict[i] for i in bad)
    assert all(verdict[i] for i in range(500) if i % 12)
    assert verdict[None] and not verdict[900] and not verdict[901] and not verdict[902]
    kept = keep_good(docs, marked)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in found)
    assert sorted(map(repr, found)) == sorted(
        map(repr, quality_table(docs.repartition(5), marked).collect())
    )


def test_nothing_labelled_and_empty_tables(spark):
    rows, _ = corpus()
    docs, none = spark.createDataFrame(rows[:30], DOCS), spark.createDataFrame([], LABELS)
    assert all(r.kept != r.base_failed for r in quality_table(docs, none).collect())
    assert quality_table(spark.createDataFrame([], DOCS), none).count() == 0
