"""Runs of words against every period tried at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from palaver.llm.word_runs import SquareCatcher, collapsed, find_runs, planted, run_table, word_runs

DOCS = "doc_id bigint, text string, runs string, kept string"


def slow(words: list, least_words: int = 2, least_repeats: int = 2) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, if no shorter period has it."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_words, least_repeats * q):
                stretch = words[i : i + length]
                if all(stretch[d:] != stretch[:-d] for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng: random.Random) -> list[int]:
    """Words with repetitions inside repetitions, some with a flaw."""
    k, words = rng.randint(1, 4), []
    if rng.random() < 0.4:
        return [rng.randrange(k) for _ in range(rng.randint(0, 60))]
    size = rng.randint(0, 70)
    while len(words) < size:
        words += [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 5)
        if rng.random() < 0.3:
            words += words[-rng.randint(1, len(words)) :]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = rng.randrange(k + 1)
    return words[:150]


def caught(words: list) -> list[tuple[int, int, int]]:
    catcher = SquareCatcher()
    for word in words:
        catcher.append(word)
    return catcher.finish()


def test_all_runs_of_random_words():
    rng = random.Random(8)
    for _ in range(4_000):
        words = made(rng)
        assert caught(words) == slow(words), words


def test_squares_are_reported_when_complete():
    """A run is open as soon as its first square is complete, and no sooner."""
    rng = random.Random(5)
    for _ in range(300):
        words, catcher = made(rng), SquareCatcher()
        runs = slow(words)
        for i, word in enumerate(words):
            catcher.append(word)
            due = {q: s for s, length, q in runs if s + 2 * q - 1 <= i < s + length}
            assert catcher.open == due, (words, i)


def test_least_length():
    rng = random.Random(2)
    for _ in range(500):
        words = made(rng)
        assert word_runs(words) == slow(words, 6, 4)
    assert word_runs(list("aaaaa")) == [] and word_runs(list("aaaaaa")) == [(0, 6, 1)]
    assert word_runs(list("abababa")) == [] and word_runs(list("abababab")) == [(0, 8, 2)]


def test_long_texts_take_little_more_than_linear_work():
    n = 60_000
    assert caught(["a"] * n) == [(0, n, 1)]
    assert caught(list(range(n))) == []
    block = list(range(n // 8))
    assert word_runs(block * 5) == [(0, 5 * (n // 8), n // 8)]
    assert word_runs([*range(-9, 0), *block * 4, -1, *["x"] * 6]) == [
        (9, 4 * (n // 8), n // 8),
        (9 + 4 * (n // 8) + 1, 6, 1),
    ]


def test_collapsed_keeps_the_first_period():
    words = "x a b a b a b a b y".split()
    assert collapsed(words, word_runs(words)) == ["x", "a", "b", "y"]


def test_query_matches_plain_runs(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "a", "a " * 50, "ab\x0bab\x0cab\rab ab ab", "é\xa0é é\xa0é " * 3]
    texts += [" ".join(map(str, made(rng))) for _ in range(80)] + ["long words " * 40_000]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "b b b b b b b", None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    result = run_table(find_runs(docs, planted))
    assert result.columns == (
        "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    )
    expected = []
    for doc_id, text, _, _ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if words and h % 10 == 0:
            g = h // 10
            a, n = g % len(words), len(words)
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = slow(words, 6, 4) if len(words) < 1_000 else [(0, 80_000, 2)]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        expected.append(
            (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            + tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
        )
    assert sorted(map(repr, map(tuple, result.collect()))) == sorted(map(repr, expected))
    assert sum(e[1] > 0 for e in expected) > 20


def test_general_interface(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", None, None)], DOCS)
    (row,) = find_runs(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 8, 2)] and row["kept"] == "a b c"
    assert run_table(find_runs(spark.createDataFrame([], DOCS))).collect() == []
