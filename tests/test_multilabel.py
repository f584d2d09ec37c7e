"""The joint fit against plain descent, single fits and the terms of brute counts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.operators import multilabel, training, vocabulary
from palaver.operators.multilabel import fit_multilabel, minimise, optimality
from palaver.operators.vocabulary import frequent_terms

NAMES = ("pos", "neg", "rare", "never", "always")


def corpus(n: int = 300) -> list[tuple]:
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 30))
        labels = ["always"] + [x for x, w in (("pos", "w1"), ("neg", "w2"), ("rare", "w40")) if w in text]
        if rng.random() < 0.1:
            labels.append("pos")
        rows.append((i, " ".join(text), sorted(set(labels))))
    return rows


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(corpus(), "id int, text string, labels array<string>").repartition(6)


@pytest.fixture(scope="module")
def fitted(examples):
    return fit_multilabel(examples, NAMES)


def design(model, examples):
    rows = model.features.transform(examples).orderBy("id").collect()
    return np.array([r["features"].toArray() for r in rows]), [set(r["labels"]) for r in rows]


def gradient(model, x, truth, label):
    i = model.labels.index(label)
    y = np.array([label in t for t in truth], dtype=float)
    error = 1 / (1 + np.exp(-(x @ model.weights[i] + model.intercepts[i]))) - y
    return np.append((x.T @ error + model.weights[i]) / len(y), error.mean())


def test_every_label_is_at_its_optimum(fitted, examples):
    x, truth = design(fitted, examples)
    assert fitted.constant == {"never": False, "always": True}
    for label in ("pos", "neg", "rare"):
        assert np.linalg.norm(gradient(fitted, x, truth, label)) < 2e-5
    assert not fitted.weights[3].any() and not fitted.weights[4].any()


def test_same_models_as_single_fits(fitted, examples):
    single = training.fit_label_models(examples, NAMES)
    names = single.features.stages[3].vocabulary
    order = [names.index(t) for t in fitted.features.stages[3].vocabulary]
    for label in ("pos", "neg", "rare"):
        one, i = single.models[label], NAMES.index(label)
        assert np.allclose(one.coefficients.toArray()[order], fitted.weights[i], atol=0.05)
    mine = {r["id"]: r["predicted"] for r in fitted.predict(examples.select("id", "text")).collect()}
    theirs = {r["id"]: r["predicted"] for r in single.predict(examples.select("id", "text")).collect()}
    assert sum(mine[i] != theirs[i] for i in mine) <= 2 and len(mine) == 300
    x, truth = design(fitted, examples)
    margins = x @ fitted.weights.T + fitted.intercepts
    by_hand = [[n for j, n in enumerate(NAMES) if n == "always" or m[j] > 0] for m in margins]
    assert [mine[i] for i in range(300)] == by_hand


def test_passes_do_not_grow_with_labels(examples):
    few = fit_multilabel(examples, ("pos", "neg"))
    copies = examples.withColumn(
        "labels",
        F.array_sort(F.flatten(F.transform("labels", lambda x: F.array([F.concat(x, F.lit(str(i))) for i in range(12)])))),
    )
    many = fit_multilabel(copies, [f"{n}{i}" for i in range(12) for n in ("pos", "neg")])
    assert many.passes == few.passes < 200
    assert np.allclose(many.weights[:2], few.weights, atol=1e-9)


def test_sums_of_many_tasks(examples, fitted, monkeypatch):
    monkeypatch.setattr(multilabel, "CELLS_EACH", 0)
    monkeypatch.setattr(multilabel, "FAN_IN", 2)
    monkeypatch.setattr(multilabel, "ENTRIES", 50)
    again = fit_multilabel(examples, NAMES)
    assert np.allclose(again.weights, fitted.weights, atol=1e-3)


def test_few_tasks_and_the_same_sums(examples, fitted, monkeypatch):
    """However small a task may be, there are no more than cores and entries call for."""
    used = []
    plain = multilabel._loss_and_gradient

    def watched(blocks, tasks, *args):
        used.append((tasks, blocks.rdd.getNumPartitions()))
        return plain(blocks, tasks, *args)

    monkeypatch.setattr(multilabel, "_loss_and_gradient", watched)
    for name, value in (("CELLS_EACH", 0), ("ENTRIES", 1), ("FAN_IN", 2), ("SENT_BYTES", 0)):
        monkeypatch.setattr(multilabel, name, value)
    again = fit_multilabel(examples, NAMES, max_passes=30)
    cores = examples.sparkSession.sparkContext.defaultParallelism
    assert max(max(u) for u in used) <= 2 * cores
    plainly = fit_multilabel(examples, NAMES, max_passes=30)
    assert np.allclose(again.weights, plainly.weights, atol=1e-9)


def test_optimality(fitted, examples):
    rows = {r["label"]: r for r in optimality(fitted, examples).collect()}
    x, truth = design(fitted, examples)
    for label in NAMES:
        assert rows[label]["n"] == 300
        assert rows[label]["positives"] == sum(label in t for t in truth)
        assert rows[label]["constant"] == (label in fitted.constant)
        if label not in fitted.constant:
            expected = np.linalg.norm(gradient(fitted, x, truth, label))
            assert rows[label]["gradient"] == pytest.approx(expected, abs=1e-9)
    worse = multilabel.MultiLabelModel(
        fitted.features, fitted.labels, fitted.weights + 0.1, fitted.intercepts, fitted.constant
    )
    assert {r["label"]: r["gradient"] > 1e-3 for r in optimality(worse, examples).collect()}["pos"]


def test_descent_on_quadratics():
    rng = np.random.default_rng(4)
    roots = rng.normal(size=(5, 30, 30))
    shapes = [r @ r.T + 0.01 * np.eye(30) for r in roots]
    goals = rng.normal(size=(5, 30)) * 100

    def evaluate(points, active):
        moved = points - goals[active]
        slopes = np.stack([shapes[i] @ m for i, m in zip(active, moved, strict=True)])
        return 0.5 * (slopes * moved).sum(axis=1), slopes

    found, passes = minimise(evaluate, 5, 30, 1e-6, 2_000)
    assert np.allclose(found, goals, atol=1e-2) and passes < 2_000
    assert minimise(evaluate, 0, 30, 1e-6, 10) == (pytest.approx(np.empty((0, 30))), 0)


def test_memory_saves_passes(monkeypatch):
    """Curvatures that fall off as those of many examples' terms do, against the least memory."""
    shape = np.arange(1, 401.0) ** -1.5 + 1e-5
    goal = np.random.default_rng(1).normal(size=(1, 400))

    def evaluate(points, active):
        moved = points - goal
        return 0.5 * (shape * moved**2).sum(axis=1), shape * moved

    found, used = minimise(evaluate, 1, 400, 1e-5, 2_000)
    assert np.linalg.norm(shape * (found - goal)) <= 1e-5
    monkeypatch.setattr(multilabel, "MEMORY_BYTES", 0)
    assert used < 0.5 * minimise(evaluate, 1, 400, 1e-5, 2_000)[1]


def test_memory_of_many_labels_is_bounded(monkeypatch):
    kept = []

    class Watched(multilabel._Descent):
        def __init__(self, width, tolerance, memory):
            kept.append(memory)
            super().__init__(width, tolerance, memory)

    monkeypatch.setattr(multilabel, "_Descent", Watched)
    for labels, width in ((2, 50_001), (28, 50_001), (200, 50_001)):
        kept.clear()
        minimise(lambda p, a: (np.zeros(len(a)), np.zeros_like(p)), labels, width, 1e-5, 1)
        assert len(set(kept)) == 1 and 10 <= kept[0] <= 100
        assert kept[0] == 10 or 16 * kept[0] * labels * width <= multilabel.MEMORY_BYTES


def test_batches_of_the_session_are_left_alone(spark, examples):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    fit_multilabel(examples, ("pos",), max_passes=2)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_no_terms_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a", ["x"])], "id int, text string, labels array<string>")
    with pytest.raises(ValueError, match="no term"):
        fit_multilabel(rows, ("x",))


# --- vocabulary ----------------------------------------------------------------


def counted(texts: list[str | None], most: int, least: int) -> list[tuple]:
    tf, df = Counter(), Counter()
    for text in texts:
        words = [w for w in (text or "").lower().split() if len(w) > 1]
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        tf.update(grams)
        df.update(set(grams))
    kept = sorted((-tf[g], g) for g in tf if df[g] >= least)[:most]
    return [(g, df[g], -n) for n, g in kept]


@pytest.mark.parametrize("counters", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("most, least", [(1, 1), (10, 2), (40, 1), (40, 9), (100_000, 2)])
def test_frequent_terms_are_exact(spark, counters, most, least):
    texts = [r[1] for r in corpus(120)] + [None, "", "w1 " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    found = frequent_terms(rows, max_features=most, min_documents=least, counters=counters)
    got = sorted(((r["term"], r["df"], r["tf"]) for r in found.collect()), key=lambda r: (-r[2], r[0]))
    assert got == counted(texts, most, least)
    same = training.tfidf_weights(rows, max_features=most, min_documents=least)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, found.collect()))


def test_rare_terms_are_not_shuffled(spark, monkeypatch):
    """With ten times the rare terms, the second pass ships as many rows."""
    shipped = []
    plain = vocabulary.top

    def watched(df, *args):
        if "df" in df.columns:
            shipped.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(vocabulary, "top", watched)
    for rare in (2_000, 20_000):
        texts = [f"common words here {'often said ' * 3}" for _ in range(2_000)]
        texts += [f"rare{i} common" for i in range(rare)]
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
        found = frequent_terms(rows, max_features=8, min_documents=1, counters=1 << 16)
        assert found.count() == 8
    assert shipped[1] <= 2 * shipped[0] < 200


def test_weights_ship_no_rare_terms(spark, monkeypatch):
    shipped = []
    plain = vocabulary.top

    def watched(df, *args):
        if "df" in df.columns:
            shipped.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(vocabulary, "top", watched)
    texts = [f"common words here {'often said ' * 3}" for _ in range(2_000)]
    texts += [f"rare{i} common" for i in range(20_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = training.tfidf_weights(rows, max_features=8, min_documents=1)
    assert found.count() == 8
    assert 0 < shipped[-1] < 200


@pytest.mark.parametrize("numbered", [0, 1_000])
@pytest.mark.parametrize("paired", [True, False])
def test_terms_counted_by_numbers(monkeypatch, numbered, paired):
    monkeypatch.setattr(vocabulary, "MOST_NUMBERED", numbered)
    texts = ["a b a b", "", "b", "c c c", "a b"]
    words = [t.split() for t in texts]
    flat = pa.array([w for t in words for w in t], type=pa.string())
    got = vocabulary._counted(flat, np.array([len(t) for t in words]), paired).to_pylist()
    tf, df = Counter(), Counter()
    for t in words:
        grams = t + [" ".join(p) for p in zip(t, t[1:])] * paired
        tf.update(grams)
        df.update(set(grams))
    assert {r["term"]: (r["df"], r["tf"]) for r in got} == {g: (df[g], tf[g]) for g in tf}
    assert len(got) == len(tf)


def test_no_examples(spark):
    rows = spark.createDataFrame([], "text string")
    assert frequent_terms(rows).collect() == []
