"""Language of documents from a linear-chain conditional random field over their words.

A word's features are its affixes, its character n-grams and, if the lexicon has it, the
word itself.  Feature weights and transitions between languages are learned together by
gradient ascent on the likelihood; forward-backward gives each word's probability of each
language.  A document's language is the one with the largest expected share of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import crc_of

UNKNOWN = "und"
HELD_OUT = 5

# Bound on the documents per language that the field is fitted on, and on all of them; with
# more languages than fit into the second, there is one document of each.
ROWS_PER_LANGUAGE, FIT_ROWS = 300, 60_000
# Multiple of the bound that is ranked to find the least hashes.
RANKED = 4

# Training sequences alternate runs of this many words from documents of all languages, so
# that transitions between languages are learned too.
RUN, RUNS = 40, 5
EPOCHS, SEQUENCES, RATE, SHRINK = 4, 128, 0.3, 1e-5
# Least number of sample words with a feature, and of occurrences of a lexicon word.
FEATURE_WORDS, LEXICON_COUNT = 3, 5
# Word scores kept per task, and characters labelled together.
REMEMBERED, TOGETHER = 400_000, 12_000_000

LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall((text or "").lower())


def in_training(doc_id: object) -> bool:
    """Whether the field may learn from a document; one without an id is held out."""
    return crc_of(doc_id) % HELD_OUT != 0


def features(word: str) -> list[str]:
    """Affixes (marked by position), character n-grams and the word itself."""
    marked = f"^{word}$"
    grams = {marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)}
    affixes = [f"<{word[:n]}" for n in range(1, 4)] + [f">{word[-n:]}" for n in range(1, 4)]
    return [*affixes, *sorted(grams), f"={word}"]


class Layout:
    """Positions of sequences of unequal length, ordered by step, longest sequence first.

    At every step the sequences still running are a prefix of the order, so a step is a
    few array operations over all of them.
    """

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        ranked = lengths[self.order]
        steps = int(ranked[0]) if len(ranked) else 0
        self.active = np.searchsorted(-ranked, -np.arange(steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[self.order] = np.arange(len(lengths))
        self.sequence = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # Where each word, counted through the sequences, stands in the layout.
        self.place = self.offset[step] + rank[self.sequence]


def forward_backward(
    layout: Layout, emission: np.ndarray, transition: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward values and emission factors, in the layout's order."""
    factor = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(transition)
    forward, backward = np.empty_like(factor), np.ones_like(factor)
    offset, active = layout.offset, layout.active
    for t, n in enumerate(active):
        now = slice(offset[t], offset[t] + n)
        value = factor[now]
        if t:
            value = value * (forward[offset[t - 1] : offset[t - 1] + n] @ move)
        forward[now] = value / value.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        after = slice(offset[t + 1], offset[t + 1] + active[t + 1])
        value = (factor[after] * backward[after]) @ move.T
        backward[offset[t] : offset[t] + active[t + 1]] = value / value.sum(axis=1, keepdims=True)
    return forward, backward, factor


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Probability of each label at each position."""
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


class Field:
    """Weights of features and transitions for a set of languages."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, len(languages)), dtype=np.float64)
        self.transition = np.zeros((len(languages), len(languages)))

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of some words, joined, and where each word's begin."""
        get = self.index.get
        found = [[i for i in map(get, features(w)) if i is not None] or [0] for w in words]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        joined = np.fromiter((i for f in found for i in f), dtype=np.int64, count=sizes.sum())
        return joined, np.cumsum(sizes) - sizes

    def scores(self, words: list[str]) -> np.ndarray:
        """Sum of feature weights per word and language."""
        joined, starts = self.known(words)
        return np.add.reduceat(self.weights[joined], starts, axis=0)

    def fit(self, sample: list[tuple[str, str]]) -> None:
        """Learn from ``(text, language)`` rows."""
        rng = np.random.default_rng(0)
        runs, counts = [], Counter()
        for text, language in sample:
            words = words_of(text)
            counts.update(words)
            label = self.languages.index(language)
            runs += [(words[i : i + RUN], label) for i in range(0, len(words), RUN)]
        if not runs or len(self.languages) < 2:
            return
        types = sorted(counts)
        number = {w: i for i, w in enumerate(types)}
        shared = Counter(f for w in types for f in features(w) if f[0] != "=")
        kept = sorted(f for f, n in shared.items() if n >= FEATURE_WORDS)
        kept += [f"={w}" for w in types if counts[w] >= LEXICON_COUNT]
        self.index = {f: i + 1 for i, f in enumerate(kept)}  # 0: no known feature
        self.weights = np.zeros((len(kept) + 1, len(self.languages)))
        joined, starts = self.known(types)
        ends = np.append(starts[1:], len(joined))
        past, past_moves = np.full_like(self.weights, 1e-6), np.full_like(self.transition, 1e-6)
        for _ in range(EPOCHS):
            shuffled = rng.permutation(len(runs))
            sequences = [shuffled[i : i + RUNS] for i in range(0, len(runs), RUNS)]
            for at in range(0, len(sequences), SEQUENCES):
                batch = [[runs[r] for r in s] for s in sequences[at : at + SEQUENCES]]
                words = np.array([number[w] for s in batch for run, _ in s for w in run])
                truth = np.array([y for s in batch for run, y in s for _ in run])
                lengths = np.array([sum(len(run) for run, _ in s) for s in batch])
                present, local = np.unique(words, return_inverse=True)
                own = np.concatenate([joined[starts[w] : ends[w]] for w in present])
                owner = np.repeat(np.arange(len(present)), ends[present] - starts[present])
                first = np.searchsorted(owner, np.arange(len(present)))
                scores = np.add.reduceat(self.weights[own], first, axis=0)
                at_word, at_move = self._gradient(scores, local, truth, lengths)
                per_word = np.zeros_like(scores)
                np.add.at(per_word, local, at_word)
                used, where = np.unique(own, return_inverse=True)
                step = np.zeros((len(used), len(self.languages)))
                np.add.at(step, where, per_word[owner])
                step = step / len(words) - SHRINK * self.weights[used]
                past[used] += step**2
                self.weights[used] += RATE * step / np.sqrt(past[used])
                at_move = at_move / len(words) - SHRINK * self.transition
                past_moves += at_move**2
                self.transition += RATE * at_move / np.sqrt(past_moves)
        self.weights[0] = 0.0

    def _gradient(
        self, scores: np.ndarray, words: np.ndarray, truth: np.ndarray, lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log-likelihood by word score and by transition."""
        layout = Layout(lengths)
        emission = np.empty((len(words), len(self.languages)))
        emission[layout.place] = scores[words]
        forward, backward, factor = forward_backward(layout, emission, self.transition)
        expected = marginals(forward, backward)[layout.place]
        at_word = -expected
        at_word[np.arange(len(truth)), truth] += 1
        later = np.flatnonzero(layout.sequence[1:] == layout.sequence[:-1]) + 1
        before, after = forward[layout.place[later - 1]], layout.place[later]
        ahead, move = factor[after] * backward[after], np.exp(self.transition)
        total = np.einsum("ni,ij,nj->n", before, move, ahead)
        pairs = move * (before.T @ (ahead / total[:, None]))
        at_move = -pairs
        np.add.at(at_move, (truth[later - 1], truth[later]), 1)
        return at_word, at_move


class Labeller:
    """Word probabilities of whole texts; keeps the scores of words between calls."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(field.languages)), dtype=np.float32)

    def _numbers(self, worded: list[list[str]]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
            self.table = self.table[:0]
        rows = self.rows
        fresh = [w for words in worded for w in dict.fromkeys(words) if w not in rows]
        fresh = list(dict.fromkeys(fresh))
        if fresh:
            rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh)), strict=True))
            scores = self.field.scores(fresh).astype(np.float32)
            self.table = np.concatenate([self.table, scores])
        total = sum(map(len, worded))
        return np.fromiter((rows[w] for words in worded for w in words), np.int64, total)

    def probabilities(self, worded: list[list[str]]) -> tuple[np.ndarray, Layout]:
        """Probabilities of each language at each word, through the texts in order."""
        layout = Layout(np.fromiter(map(len, worded), dtype=np.int64, count=len(worded)))
        emission = np.empty((len(layout.place), len(self.field.languages)), dtype=np.float32)
        numbers = self._numbers(worded)
        emission[layout.place] = self.table[numbers]
        forward, backward, _ = forward_backward(
            layout, emission, self.field.transition.astype(np.float32)
        )
        return marginals(forward, backward)[layout.place], layout

    def languages(self, worded: list[list[str]]) -> tuple[list[str], list[float]]:
        """The language and its expected share of words, per text."""
        if not self.field.languages:
            return [UNKNOWN] * len(worded), [0.0] * len(worded)
        each, layout = self.probabilities(worded)
        shares = np.stack(
            [np.bincount(layout.sequence, c, minlength=len(worded)) for c in each.T], axis=1
        )
        best = shares.argmax(axis=1)
        names, scores = [], []
        for row, words in enumerate(worded):
            names.append(self.field.languages[best[row]] if words else UNKNOWN)
            share = float(shares[row, best[row]]) / max(len(words), 1)
            scores.append(min(1.0, max(0.0, share)) if words else 0.0)
        return names, scores

    def spans(self, words: list[str]) -> list[dict]:
        """Runs of words whose likeliest language is the same."""
        if not words or not self.field.languages:
            return []
        best = self.probabilities([words])[0].argmax(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        sizes = np.diff(np.append(starts, len(best)))
        return [
            {"start": int(s), "n_words": int(n), "lang": self.field.languages[best[s]]}
            for s, n in zip(starts, sizes, strict=True)
        ]


def fit(docs: DataFrame) -> Field:
    """A field fitted on at most ``ROWS_PER_LANGUAGE`` documents of each language.

    Every language counts; many languages have fewer documents each (``FIT_ROWS``).
    Of the documents that may be learned from, those with the least hash of id and
    language are taken, whole, so reruns agree.  Only rows whose hash lies in a share of its
    range that holds several times the bound are ranked, so a language with most of the rows
    brings no more of them together than any other.  Null languages teach nothing.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT
    labelled = docs.where(F.col("lang").isNotNull() & (remainder != 0))
    sizes = {
        r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    if not sizes:
        return Field([])
    languages = list(sizes)
    each = max(1, min(ROWS_PER_LANGUAGE, FIT_ROWS // len(languages)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "lang"), 1)
    reach = F.coalesce(
        *[
            F.when(F.col("lang") == lang, int(2**63 * min(1.0, RANKED * each / n)) - 1)
            for lang, n in sizes.items()
        ]
    )
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = (
        labelled.where(place <= reach)
        .select("doc_id", "lang", F.row_number().over(order).alias("_place"))
        .where(F.col("_place") <= each)
        .select("doc_id", "lang")
        .distinct()
    )
    # The chosen rows are bounded by languages and documents per language.
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    bound = each * len(languages)
    rows = sample.orderBy(place, "doc_id", "text").limit(bound).collect()
    field = Field(sorted(languages))
    field.fit([(r.text, r.lang) for r in rows])
    return field


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document.

    ``score`` is the expected share of the document's words in its language.  Null texts
    and texts without letters get ``und`` and 0, as does everything if there is nothing to
    learn from.  Documents without an id are held out.  Repeated rows get equal answers;
    id, language and source are not inputs of a prediction.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(docs))
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = None
        for batch in batches:
            labeller = labeller or Labeller(field.value)
            start, held, size = 0, [], 0
            for at, text in enumerate(batch.column(1)):
                held.append(words_of(text.as_py()))
                size += sum(map(len, held[-1]))
                if size > TOGETHER or at == batch.num_rows - 1:
                    names, scores = labeller.languages(held)
                    ids = batch.column(0).slice(start, len(held))
                    out = [not in_training(i) for i in ids.to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(out), pa.array(names, pa.string()),
                         pa.array(scores, pa.float64())],
                        names=["doc_id", "held_out", "lang_pred", "score"],
                    )
                    start, held, size = at + 1, [], 0

    schema = f"doc_id {id_kind}, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, spans)``: runs of words of one language in code-switched texts.

    A span has its first word (runs of letters, from 0), its number of words and its
    language.  Texts without letters have no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    id_kind = docs.schema["doc_id"].dataType
    span = pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            spans = [labeller.spans(words_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"]
            )

    schema = (
        f"doc_id {id_kind.simpleString()}, "
        "spans array<struct<start: bigint, n_words: bigint, lang: string>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)
