"""Runs of repeated words, found online by dyadic square catching.

A run is a stretch of words that repeats with a smallest period q and that neither neighbour
extends.  Words are appended one at a time.  Whenever a block of a power of two of words is
complete, a catcher of length L is set up for it, which looks out for squares (the same p
words twice in a row) with L words of the first half in its block, for p from 2L up to 4L.
Every square of such a period holds an aligned block of L words among its first 2L - 1, so
some catcher sees it before it ends.

A catcher waits for the last word of its block to be appended at a distance in its range.
It then compares suffixes: the words before that place with its block, and further back for
as long as they agree.  If the agreement is still short of p words, the comparison is set
aside until the word that would complete the square; it then goes on with what has been
appended since.  A complete square opens a run of its period, which every further word either
continues or closes; further squares of that period merge into it.  A square inside an open
run whose period divides its own is no new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import WORD, crc_of, map_rows

LEAST_WORDS = 6
LEAST_REPEATS = 4


class SquareCatcher:
    """Reports the runs of the words appended to it; words are anything that can be a key."""

    def __init__(self) -> None:
        self.words: list = []
        # Runs that the last word continues, by period: where they start.
        self.open: dict[int, int] = {}
        # Closed runs: start, length, period.
        self.closed: list[tuple[int, int, int]] = []
        # By last word of a block: the block's last place and length.
        self.waiting: dict[object, list[tuple[int, int]]] = {}
        # By place at which the square would be complete: its period, start, next place.
        self.aside: dict[int, dict[tuple[int, int], int]] = {}

    def append(self, word: object) -> None:
        words = self.words
        i = len(words)
        words.append(word)
        if self.open:
            self._continue(i, word)
        if i in self.aside:
            for (period, start), done in sorted(self.aside.pop(i).items()):
                if words[done : i + 1] == words[done - period : i + 1 - period]:
                    self._complete(period, start)
        # Catchers of one word, for the periods 1 to 3.
        if i:
            if words[i - 1] == word:
                self._compare(i, 1)
            if i > 1:
                if words[i - 2] == word:
                    self._compare(i, 2)
                if i > 2 and words[i - 3] == word:
                    self._compare(i, 3)
        catchers = self.waiting.get(word)
        if catchers:
            self._wake(i, catchers)
        length = 2
        while not (i + 1) % length:
            if catchers is None:
                catchers = self.waiting[word] = []
            catchers.append((i, length))
            length *= 2

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), by start, then period; nothing may follow."""
        for period, start in self.open.items():
            self.closed.append((start, len(self.words) - start, period))
        self.open = {}
        return sorted(self.closed, key=lambda run: (run[0], run[2]))

    def _continue(self, i: int, word: object) -> None:
        words, over = self.words, []
        for period in self.open:
            if words[i - period] != word:
                over.append(period)
        for period in over:
            start = self.open.pop(period)
            self.closed.append((start, i - start, period))

    def _wake(self, i: int, catchers: list[tuple[int, int]]) -> None:
        words, late = self.words, False
        for end, length in catchers:
            period = i - end
            if period >= 4 * length:
                late = True
            elif (
                period >= 2 * length
                and words[i - 1] == words[end - 1]
                and not (self.open and self._known(i, period))
                and words[i + 1 - length : i + 1] == words[end + 1 - length : end + 1]
            ):
                self._compare(i, period)
        if late:
            catchers[:] = [c for c in catchers if i - c[0] < 4 * c[1]]

    def _compare(self, i: int, period: int) -> None:
        """Take up the comparison of the words up to i with those a period before."""
        if self.open and self._known(i, period):
            return
        start = self._agreement(i, period)
        full = start + 2 * period - 1
        if full <= i:
            self._complete(period, start)
        else:
            self.aside.setdefault(full, {}).setdefault((period, start), i + 1)

    def _known(self, i: int, period: int) -> bool:
        """Whether an open run tells all about the agreement of place i with a period before.

        It does if it has that period, or if both places lie in it and its period divides
        that one: the agreement then starts and ends where the run does, and holds no square
        of its own.
        """
        if period in self.open:
            return True
        for other, start in self.open.items():
            if not period % other and start <= i - period:
                return True
        return False

    def _agreement(self, i: int, period: int) -> int:
        """Start of the stretch up to i - period that agrees with the one up to i."""
        words = self.words
        left, step = i - period, 1
        while left >= 0 and words[left] == words[left + period]:
            left -= 1
            # Whole slices, twice as long every time, while they agree.
            while left - step >= 0 and (
                words[left - step + 1 : left + 1]
                == words[left - step + 1 + period : left + 1 + period]
            ):
                left -= step
                step *= 2
            step = max(1, step // 4)
        return left + 1

    def _complete(self, period: int, start: int) -> None:
        """A square of the period that starts there and ends at the last word."""
        if not self._known(start + 2 * period - 1, period):
            self.open[period] = start


def word_runs(
    words: list, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS
) -> list[tuple[int, int, int]]:
    """Runs of at least so many words and repeats as (start, length, period)."""
    catcher = SquareCatcher()
    for word in words:
        catcher.append(word)
    return [
        run
        for run in catcher.finish()
        if run[1] >= least_words and run[1] >= least_repeats * run[2]
    ]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def planted(words: list, doc_id: object) -> list:
    """Words with a repetition at the end, for one document in ten, as its id decides."""
    h, n = crc_of(doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def find_runs(
    docs: DataFrame, change: Callable[[list, object], list] | None = None
) -> DataFrame:
    """``(doc_id, runs, kept)``: every text's runs, and its words without their repeats.

    ``runs`` is an array of (start, length, period) by start, then period, with words
    numbered from 0; ``kept`` is the words joined by one space.  Words are maximal runs
    without white space.  A text that is null, empty or without words has no run and keeps
    the empty text.  Repeated rows give repeated rows; other columns are not read.  A text is
    held whole in one task; work and memory grow with its words times their logarithm.
    ``change`` replaces a document's words before they are read.
    """

    def make():
        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            found, kept = [], []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                words = WORD.findall(text or "")
                if change:
                    words = change(words, doc_id)
                runs = word_runs(words)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                kept.append(" ".join(collapsed(words, runs)))
            yield {"doc_id": rows["doc_id"], "runs": found, "kept": kept}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    run = "struct<start: bigint, length: bigint, period: bigint>"
    return map_rows(
        docs.select("doc_id", "text"), f"doc_id {kind}, runs array<{run}>, kept string", make
    )


def strongest(runs: Column) -> Column:
    """The run with the most repeats; the first, then the shortest period, of equal ones.

    Lengths over periods are compared as whole numbers.  Null without a run.
    """
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, run: F.when(
            run["length"] * best["period"] > best["length"] * run["period"], run
        ).otherwise(best),
    )


def run_table(found: DataFrame) -> DataFrame:
    """Of every document of ``find_runs`` the runs' number, strongest one and digests."""
    lines = F.transform(
        "runs",
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
