"""Term search by index against the scan."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from palaver.operators import term_index
from palaver.operators.term_index import TermIndex
from palaver.operators.terms import comments_containing_term, matching_comments

COMMENTS = "comment_id string, post_title string, comment_body string, comment_score int, comment_author string"


def corpus():
    rng = random.Random(6)
    words = ["art", "Art", "ART's", "new", "york", "é", "c++", "x", "a_b", "--", "st.", "the", "straße", "IS"]
    seps = [" ", " ", " ", "  ", "-", ", ", "\n", "++", ""]
    rows = []
    for i in range(600):
        body = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 12)))
        rows.append((f"c{rng.randint(0, 400)}" if i % 30 else None, f"t{i}", body, i, "a"))
    return [*rows, ("c1", "t", None, 1, None), ("c2", "t", "", 1, "b"), ("c3", "t", "art " * 5_000, 2, "b")]


TERMS = [
    "art", "ART", "new york", "new  york", "york new york", "new-york", "c++", "++c", "+", "--", "x c++",
    "a_b", "é", "straße", "is", "art's", "art art", "st.", "st. the", "missing", "new missing", " art", "art ",
    "the, art", "art\nart", "",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = TermIndex(spark, str(tmp_path_factory.mktemp("index")))
    made.build(spark.createDataFrame(corpus(), COMMENTS).repartition(5), order_by=("comment_id", "post_title"))
    return made


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_scan(spark, index, term):
    comments = spark.createDataFrame(corpus(), COMMENTS)
    for limit in (3, 1_000):
        expected = comments_containing_term(comments, term, limit, ("comment_id", "post_title"))
        assert index.search(term, limit).collect() == expected.collect()


def test_most_terms_are_found(spark, index):
    comments = spark.createDataFrame(corpus(), COMMENTS)
    assert sum(matching_comments(comments, t).count() > 0 for t in TERMS) > 14


def test_search_reads_no_text(index):
    plan = index.docs("new york")._jdf.queryExecution().executedPlan().toString()
    assert "comment_body" not in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert "PushedFilters: [IsNotNull(word)" in plan


def test_rows_are_words_of_many_texts(spark, tmp_path, monkeypatch):
    """What is shuffled and sorted grows with a task's distinct words, not with all words."""
    body = " ".join(f"w{i % 40}" for i in range(400))
    comments = spark.createDataFrame([(f"c{i}", "t", body, 1, "a") for i in range(500)], COMMENTS).coalesce(2)
    made = TermIndex(spark, str(tmp_path))
    made.build(comments)
    rows = spark.read.parquet(f"{tmp_path}/postings")
    # The first and the last word have a gap on one side only.
    assert rows.count() <= 42 * 8
    assert rows.selectExpr("sum(size(doc))").first()[0] == 500 * 400
    assert made.docs("w39 w0").count() == 500 and made.docs("w0 w39").count() == 0


@pytest.mark.parametrize("words, most", [(1, 1), (7, 3), (50, 10_000)])
def test_occurrences_by_hand(monkeypatch, words, most):
    monkeypatch.setattr(term_index, "WORDS_GATHERED", words)
    monkeypatch.setattr(term_index, "MOST_IN_ROW", most)
    texts = [["a", " ", "b", "-", "a"], [], ["!", "a", "."], None, ["?"], ["b"], ["a", " "] * 9, [" ", "b"] * 4]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(10, 18), type=pa.int64()),
            pa.array(texts, type=pa.list_(pa.string())),
            pa.array([bool(t) and t[0].isalpha() if t is not None else None for t in texts]),
        ],
        names=["doc", "tokens", "leads"],
    )
    expected, got = [], []
    for doc, text in enumerate(texts, 10):
        at = [i for i, t in enumerate(text or ()) if t.isalpha()]
        for n, i in enumerate(at):
            expected.append(
                (text[i], doc, n, text[i - 1] if n else None, text[i + 1] if n < len(at) - 1 else None)
            )
    for out in term_index._gathered(iter([batch.slice(0, 0), batch, batch.slice(1, 1)])):
        for row in out.to_pylist():
            assert 0 < len(row["doc"]) <= most
            sides = row["before"], row["after"]
            got += [(row["word"], *x, *sides) for x in zip(row["doc"], row["pos"], strict=True)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_comments_are_derived_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    comments = spark.createDataFrame(corpus(), COMMENTS)
    TermIndex(spark, str(tmp_path)).build(comments.mapInArrow(count, COMMENTS))
    assert seen.value == comments.count()


def test_empty_table(spark, tmp_path):
    made = TermIndex(spark, str(tmp_path))
    made.build(spark.createDataFrame([], COMMENTS))
    assert made.search("art").collect() == []
