"""Prefix counts against the tokenizer library."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palaver.llm.token_counts import (
    PrefixCounter,
    characters_within,
    prefix_token_counts,
    token_budget,
    tokens_at,
)

VOCABULARY = "byte_bpe_50k.json"
DOCS = "doc_id bigint, text string, n_tokens string"
LETTERS = [*"abcdeth  \n\t'’srlvm.,!?<|endoftext|>éß½²1234 Ω你好😀՘\u0893 ", "<|endoftext|>", "'re",
           "'ll", "   "]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix(library):
    counter, rng = PrefixCounter(VOCABULARY), random.Random(5)
    for _ in range(150):
        text = "".join(rng.choices(LETTERS, k=rng.randint(0, 30)))
        counts = counter.counts(text)
        assert counts.tolist() == [library(text[:i]) for i in range(len(text) + 1)], repr(text)


def test_long_pieces(library):
    counter = PrefixCounter(VOCABULARY)
    for text in ("a" * 3_000, "é你" * 700, " " * 2_000 + "x", "1!" * 900):
        assert counter.counts(text)[-1] == library(text)


def test_budget_of_every_document(spark, library):
    rng = random.Random(9)
    texts = [None, "", " ", "<|endoftext|>" * 3, "word " * 30_000]
    texts += ["".join(rng.choices(LETTERS, k=rng.randint(0, 200))) for _ in range(30)]
    rows = [(i % 20, t, "x") for i, t in enumerate(texts)] + [(None, "abc", None)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    found = token_budget(docs, VOCABULARY, 40).collect()
    expected = []
    for doc_id, text, _ in rows:
        text = text or ""
        fitting = max(
            (i for i in range(len(text) + 1) if i < 400 and library(text[:i]) <= 40), default=0
        )
        expected.append((doc_id, len(text.encode()), library(text), library(text) > 40, fitting))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_stored_tables_answer_later_questions(spark, library):
    rows = [(1, "Hello   world, it's <|endoftext|> fine", None), (2, None, "x")]
    table = prefix_token_counts(spark.createDataFrame(rows, DOCS), VOCABULARY)
    counts = F.col("prefix_counts")
    asked = table.select(
        "doc_id",
        *[tokens_at(counts, n).alias(f"at_{n}") for n in (0, 7, 20, 10_000)],
        characters_within(counts, 4).alias("within"),
    )
    found = {r.doc_id: r for r in asked.collect()}
    text = rows[0][1]
    assert [found[1][f"at_{n}"] for n in (0, 7, 20, 10_000)] == [
        library(text[:n]) for n in (0, 7, 20, 10_000)
    ]
    assert found[1].within == max(i for i in range(len(text) + 1) if library(text[:i]) <= 4)
    assert tuple(found[2]) == (2, 0, 0, 0, 0, 0)


def test_empty_table(spark):
    assert token_budget(spark.createDataFrame([], DOCS), VOCABULARY, 5).count() == 0


@pytest.mark.parametrize("letter", ["\U00017000", "\U00012031", "\U00020000"])
def test_short_piece_with_more_tokens_than_a_byte_holds(library, letter):
    counts = PrefixCounter(VOCABULARY).counts(letter * 64)
    assert counts.tolist() == [library(letter * i) for i in range(65)]
    assert counts[-1] == 256
