"""Language labels: held-out accuracy, forward-backward against all label sequences."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from palaver.llm.language_id import (
    Field,
    Labeller,
    Layout,
    fit,
    forward_backward,
    identify,
    label_words,
    marginals,
    words_of,
)

DOCS = "doc_id bigint, text string, lang string, score string"
WORDS = {
    "en": "the and thing with that ing tion whether under other north".split(),
    "de": "und der nicht mit schon gegen heit keit zwischen über können".split(),
    "es": "que los del ción mente para donde ñame ellos aquí señor".split(),
}


def corpus(rows: int = 150) -> list[tuple]:
    rng = random.Random(6)
    out = []
    for i in range(rows):
        lang = rng.choice(sorted(WORDS))
        words = rng.choices(WORDS[lang], k=rng.randint(3, 80))
        out.append((i, " ".join(words).capitalize(), lang, "x"))
    return out


def test_forward_backward_matches_all_sequences():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1, 3])
    layout = Layout(lengths)
    scores = rng.normal(size=(lengths.sum(), 3))
    transition = rng.normal(size=(3, 3))
    emission = np.empty_like(scores)
    emission[layout.place] = scores
    forward, backward, _ = forward_backward(layout, emission, transition)
    found = marginals(forward, backward)[layout.place]
    at = 0
    for length in lengths:
        own, expected = scores[at : at + length], np.zeros((length, 3))
        for labels in itertools.product(range(3), repeat=int(length)):
            value = sum(own[i, y] for i, y in enumerate(labels))
            value += sum(transition[a, b] for a, b in itertools.pairwise(labels))
            for i, y in enumerate(labels):
                expected[i, y] += np.exp(value)
        if length:
            expected /= expected.sum(axis=1, keepdims=True)
            assert found[at : at + length] == pytest.approx(expected)
        at += length


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    field = Field(["a", "b", "c"])
    field.transition = rng.normal(size=(3, 3))
    scores, words = rng.normal(size=(4, 3)), np.array([0, 1, 1, 2, 3, 0])
    truth, lengths = np.array([0, 1, 2, 2, 0, 1]), np.array([4, 2])

    def likelihood() -> float:
        total, at = 0.0, 0
        for length in lengths:
            values = {}
            for labels in itertools.product(range(3), repeat=int(length)):
                value = sum(scores[words[at + i], y] for i, y in enumerate(labels))
                value += sum(field.transition[a, b] for a, b in itertools.pairwise(labels))
                values[labels] = value
            total += values[tuple(truth[at : at + length])]
            total -= np.log(np.exp(list(values.values())).sum())
            at += length
        return total

    at_word, at_move = field._gradient(scores, words, truth, lengths)
    per_word = np.zeros_like(scores)
    np.add.at(per_word, words, at_word)
    for array, gradient in ((scores, per_word), (field.transition, at_move)):
        for index in np.ndindex(array.shape):
            before = likelihood()
            array[index] += 1e-5
            assert (likelihood() - before) / 1e-5 == pytest.approx(gradient[index], abs=1e-3)
            array[index] -= 1e-5


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    found = identify(docs).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {
        i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0
    }
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_code_switching_and_edges(spark):
    rows = corpus()
    rows += [(900, None, "en", None), (901, "", None, None), (902, "½ 12 ...", "es", "x")]
    rows += [(None, "und der nicht", "de", None), (903, "und der nicht " * 20_000, None, None)]
    rows += [(904, "the and with", None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    found = identify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[None].lang_pred == "de" and by_id[None].held_out
    assert by_id[903].lang_pred == "de" and by_id[904].lang_pred == "en"
    field = fit(docs)
    mixed = "the thing with that other und der nicht mit gegen que los del para donde"
    spans = Labeller(field).spans(words_of(mixed))
    assert [s["lang"] for s in spans] == ["en", "de", "es"]
    assert [s["start"] for s in spans] == [0, 5, 10]
    labelled = label_words(docs, field).collect()
    assert sum(len(r.spans) for r in labelled if r.doc_id in (900, 901, 902)) == 0


def test_nothing_to_learn(spark):
    assert identify(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "some text", None, None) for i in range(5)]
    found = identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
