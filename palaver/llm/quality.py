"""Quality rules with an isolation forest on the rules' statistics.

A forest of random splits isolates rows; a document whose path to a leaf is short on
average is unlike the others.  Every tree of the forest isolates a draw of its own from all
labelled good documents, as isolation forests do; the score beyond which a document goes is
exact over all labelled documents.  Statistics and verdicts cover all.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import WORD, map_rows, own_names, stored

SYMBOLS = "#*$%&|<>"
SHORT_WORDS = 50
REPEAT_SHARE = 0.5

# Trees, and rows that each isolates.
TREES = 100
TREE_ROWS = 1024
# Largest share of labelled good documents that the threshold may turn away.
GOOD_LOSS = 0.001

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Shares of a text; none of them says how long it is.
SHARES = ("chars_per_word", "symbol_share", "mark_share", "commonest_share")
STATISTICS = ", ".join(
    [f"{c} bigint" for c in COUNTS] + [f"{s} double" for s in SHARES]
)

_MARK = re.compile("[!-/:-@\\[-`{-~¡-¿]")


def statistics(text: str) -> tuple[list[int], list[float]]:
    """Counts and shares of one text."""
    words = WORD.findall(text)
    n = len(words)
    word_chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    numbers = dict(zip(dict.fromkeys(words), itertools.count(), strict=False))
    repeats, commonest = 0, 0
    if n:
        ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=n)
        commonest = int(np.bincount(ids).max())
        if n >= 4 and len(numbers) < n:
            # Pairs are numbered first, so that the triple's number cannot overflow.
            pairs = ids[:-1] * len(numbers) + ids[1:]
            _, pairs = np.unique(pairs, return_inverse=True)
            triples = pairs[:-1] * len(numbers) + ids[2:]
            _, kinds, sizes = np.unique(triples, return_inverse=True, return_counts=True)
            again = sizes[kinds] > 1
            covered = np.zeros(n, dtype=bool)
            for shift in range(3):
                covered[shift : shift + n - 2] |= again
            repeats = int(covered.sum())
    chars = max(word_chars, 1)
    shares = [
        word_chars / max(n, 1),
        symbols / chars,
        len(_MARK.findall(text)) / chars,
        commonest / max(n, 1),
    ]
    return [n, word_chars, symbols, dup_lines, repeats], shares


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1 and the path length it stands for."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    length: list[float] = field(default_factory=list)


def expected_path(rows: int) -> float:
    """Mean path length of an unsuccessful search among so many rows."""
    if rows < 2:
        return 0.0
    return 2 * (math.log(rows - 1) + 0.5772156649015329) - 2 * (rows - 1) / rows


class Forest:
    """An isolation forest; its trees share no row where there are enough of them."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS) -> None:
        rng = np.random.default_rng(0)
        size = min(rows, len(sample))
        self.norm = expected_path(size) or 1.0
        self.depth = max(1, math.ceil(math.log2(max(size, 2))))
        self.trees = []
        apart = rng.permutation(len(sample)) if len(sample) >= trees * rows else None
        for i in range(trees):
            tree = Tree()
            if apart is None:
                chosen = rng.choice(len(sample), size, replace=False)
            else:
                chosen = apart[i * rows : (i + 1) * rows]
            self._grow(tree, sample[chosen], 0, rng)
            self.trees.append(
                tuple(np.asarray(x) for x in (tree.feature, tree.cut, tree.left, tree.right,
                                              tree.length))
            )

    def _grow(self, tree: Tree, rows: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        node = len(tree.feature)
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        leaf = depth >= self.depth or len(rows) < 2 or not len(varied)
        tree.feature.append(-1 if leaf else int(rng.choice(varied)))
        tree.cut.append(0.0)
        tree.left.append(node)
        tree.right.append(node)
        tree.length.append(depth + expected_path(len(rows)) if leaf else 0.0)
        if not leaf:
            feature = tree.feature[node]
            cut = tree.cut[node] = float(rng.uniform(low[feature], high[feature]))
            below = rows[:, feature] < cut
            tree.left[node] = self._grow(tree, rows[below], depth + 1, rng)
            tree.right[node] = self._grow(tree, rows[~below], depth + 1, rng)
        return node

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1); higher is stranger."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                below = rows[every, np.maximum(feature[node], 0)] < cut[node]
                node = np.where(below, left[node], right[node])
            total += length[node]
        return 2.0 ** (-total / (len(self.trees) * self.norm))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """The fixed rules that come before the forest."""
    return n_words < SHORT_WORDS or n_repeat_words > REPEAT_SHARE * n_words


def threshold(good: np.ndarray, bad: np.ndarray, loss: float = GOOD_LOSS) -> float:
    """The score above which a document goes.

    Among the cuts that turn away at most the share ``loss`` of good rows, those that keep
    as few bad rows as any, and of these the one that spares most good rows; it lies midway
    between neighbouring scores.  With no bad row to catch, nothing goes.
    """
    if not len(good) or not len(bad):
        return math.inf
    ranked = np.sort(good)
    least = ranked[max(0, len(ranked) - 1 - int(loss * len(ranked)))]
    caught = bad[bad > least]
    if not len(caught):
        return math.inf
    return float((ranked[ranked < caught.min()].max() + caught.min()) / 2)


def threshold_of(scored: DataFrame, loss: float = GOOD_LOSS) -> float:
    """``threshold`` of the table ``(bad, anomaly)``, exactly, however many rows it has."""
    good, bad = scored.where("not bad"), scored.where("bad")
    spared = int(loss * good.count()) + 1
    least = good.orderBy(F.desc("anomaly")).limit(spared).agg(F.min("anomaly")).first()[0]
    if least is None:
        return math.inf
    caught = bad.where(F.col("anomaly") > least).agg(F.min("anomaly")).first()[0]
    if caught is None:
        return math.inf
    below = good.where(F.col("anomaly") < caught).agg(F.max("anomaly")).first()[0]
    return (below + caught) / 2


def fit(measured: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """Forest and threshold from all labelled documents of ``measure``'s table.

    The trees' rows are those with the least hashes, so reruns agree; the threshold is over
    all.  Labels without an id or a quality are left out, and an id with both qualities counts
    as bad.  Repeated ids count once a row.
    """
    marks = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    passing = measured.where(
        f"n_words >= {SHORT_WORDS} and n_repeat_words <= {REPEAT_SHARE} * n_words"
    )
    bad = (F.col("quality") == 0).alias("bad")
    rows = stored(passing.join(marks, "doc_id").select("doc_id", bad, *SHARES))
    if rows.isEmpty():
        return None, math.inf
    good = rows.where("not bad")
    drawn = rows if good.isEmpty() else good
    order = [F.xxhash64("doc_id", *SHARES), "doc_id", *SHARES]
    drawn = drawn.orderBy(*order).limit(TREES * TREE_ROWS).select(*SHARES).toPandas()
    forest = Forest(drawn.to_numpy(dtype=float))
    return forest, threshold_of(stored(with_anomaly(rows.select("bad", *SHARES), forest)))


def with_anomaly(measured: DataFrame, forest: Forest | None) -> DataFrame:
    """Rows that have the shares, with ``anomaly``, their score."""
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in measured.dtypes)
    model = measured.sparkSession.sparkContext.broadcast(forest)

    def make():
        trees = model.value

        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            values = np.column_stack([rows[s] for s in SHARES])
            scores = trees.scores(values) if trees else np.zeros(len(values))
            yield rows | {"anomaly": scores.tolist()}

        return step

    return map_rows(measured, f"{kinds}, anomaly double", make)


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, columns to keep, counts and shares of every document."""
    keep = ["doc_id", *(keep or [])]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            yield {c: rows[c] for c in keep} | _measured(rows["text"])

        return step

    return map_rows(docs.select(*keep, "text"), f"{kinds}, {STATISTICS}", make)


def _measured(texts: list[str | None]) -> dict[str, list]:
    counts, shares = zip(*[statistics(t or "") for t in texts], strict=True)
    return dict(zip(COUNTS, map(list, zip(*counts, strict=True)), strict=True)) | dict(
        zip(SHARES, map(list, zip(*shares, strict=True)), strict=True)
    )


def judge(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Counts, ``base_failed``, ``anomaly`` and ``kept`` of every document.

    A document that fails the fixed rules goes; of the others those whose anomaly score
    exceeds the threshold go.  A null text has no words and fails.  Without labels of
    both kinds only the fixed rules decide.  Repeated rows are judged alike.
    """
    forest, most = fit(stored(measure(docs)), labels)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        trees = model.value

        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            measured = _measured(rows["_text"])
            values = np.column_stack([measured.pop(s) for s in SHARES])
            scores = trees.scores(values) if trees else np.zeros(len(values))
            failed = list(map(base_failed, measured["n_words"], measured["n_repeat_words"]))
            yield {c: rows[c] for c in keep} | {f"_{k}": v for k, v in measured.items()} | {
                "_base_failed": failed,
                "_anomaly": scores.tolist(),
                "_kept": [not f and bool(s <= most) for f, s in zip(failed, scores, strict=True)],
            }

        return step

    schema = f"{kinds}, " + ", ".join(f"_{c} bigint" for c in COUNTS)
    schema += ", _base_failed boolean, _anomaly double, _kept boolean"
    return map_rows(docs.select(*keep, F.col("text").alias("_text")), schema, make)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict and its statistics, one row per document, as ``judge`` gives them.

    The texts are read once; what they are judged by is kept.
    """
    measured = stored(measure(docs))
    forest, most = fit(measured, labels)
    failed = F.expr(f"n_words < {SHORT_WORDS} or n_repeat_words > {REPEAT_SHARE} * n_words")
    judged = with_anomaly(measured, forest).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("anomaly") <= most)
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns, whatever those are called."""
    rows = own_names(docs, ("doc_id", "text"))
    kept = judge(rows, labels, rows.columns).where("_kept")
    return kept.select(*rows.columns).toDF(*docs.columns)
