"""Language-model scores from a probabilistic suffix tree.

The tree's symbols are characters.  A word starts after a start mark and ends with an end
mark; where a word could start, the text may end instead.  The probability of a text is the
product over its words and its end, each symbol given the longest suffix of what precedes
it in the word that the tree retains.  A suffix is retained if it precedes enough symbols and if
its next symbols differ from those of its parent, the suffix one symbol shorter, by a test
of divergence.  Distributions are smoothed towards the parent's, at the root towards all
code points, so no text is impossible.

Contexts end at the word's start, so a word's probability is one number: the tree is
learned from the corpus's distinct words with their counts, and each is scored once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpointed, crc_of, fold, stored

# Marks that cannot occur inside a word.
START, STOP, END = "\n", " ", "\t"
CODE_POINTS = 0x110000

DEPTH = 5
# Least number of symbols that a retained suffix precedes, so that the tree grows with the
# corpus.  Tasks hold a tree of up to TREE_ROWS pairs of a suffix and a next symbol; a larger
# one stays a table that the distinct words are joined to, whole.
LEAST_COUNT, TREE_ROWS = 100, 1_000_000
# Least gain in log-likelihood (nats) over the parent's distribution.
LEAST_GAIN = 20.0
# Words with at least this share of all tokens are looked up in the task; there are at
# most 1 / FREQUENT_SHARE of them.  The others are joined.
FREQUENT_SHARE = 1e-6
HELD_OUT = 10
# Distinct entries a task gathers before it passes them on, and word scores it keeps.
GATHERED = 500_000


def held_out(doc_id: object) -> bool:
    """Whether a document is left out of training; one without an id is."""
    return crc_of(doc_id) % HELD_OUT == 0


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, every: bool = False) -> DataFrame:
    """``(word, n)`` over the training documents, or all; the empty word counts text ends."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if every or not held_out(doc_id):
                    seen.update(words_of(text.as_py()))
                    seen[b""] += 1
                if len(seen) > GATHERED:
                    yield _batch([[w.decode() for w in seen], list(seen.values())], schema)
                    seen.clear()
        yield _batch([[w.decode() for w in seen], list(seen.values())], schema)

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def grams_of(word: str) -> Iterator[str]:
    """Every symbol of a word and its end, after up to ``DEPTH`` symbols before it."""
    marked = START + word + STOP if word else START + END
    for at in range(1, len(marked)):
        yield marked[max(0, at - DEPTH) : at + 1]


def suffix_counts(counts: DataFrame) -> DataFrame:
    """``(context, symbol, n)``: every context of up to ``DEPTH`` symbols and what follows.

    Longest contexts are counted in the tasks, once per distinct word; shorter ones are
    sums over them.
    """
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, int] = {}
        get = grams.get
        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for gram in grams_of(word):
                    grams[gram] = get(gram, 0) + n
            if len(grams) > GATHERED:
                yield _batch([list(grams), list(grams.values())], schema)
                grams.clear()
        yield _batch([list(grams), list(grams.values())], schema)

    longest = counts.select("word", "n").mapInArrow(run, "gram string, n bigint")
    longest = longest.groupBy("gram").agg(F.sum("n").alias("n"))
    starts = F.sequence(F.lit(1), F.length("gram"))
    parts = longest.select("gram", "n", F.explode(starts).alias("start"))
    return (
        parts.groupBy(F.expr("substring(gram, start)").alias("part"))
        .agg(F.sum("n").alias("n"))
        .select(
            F.expr("left(part, length(part) - 1)").alias("context"),
            F.expr("right(part, 1)").alias("symbol"),
            "n",
        )
    )


def retained(grams: DataFrame) -> DataFrame:
    """The rows of ``suffix_counts`` whose context the tree retains; the root always is."""
    totals = grams.groupBy("context").agg(F.sum("n").alias("total"))
    totals = totals.where((F.col("total") >= LEAST_COUNT) | (F.col("context") == ""))
    frequent = checkpointed(grams.join(totals, "context"))
    parents = frequent.select(
        F.col("context").alias("parent"),
        "symbol",
        F.col("n").alias("parent_n"),
        F.col("total").alias("parent_total"),
    )
    children = frequent.where("context <> ''").withColumn("parent", F.expr("substring(context, 2)"))
    # A parent is at least as frequent as its children and has all their symbols.
    ratio = (F.col("n") / F.col("total")) / (F.col("parent_n") / F.col("parent_total"))
    gains = (
        children.join(parents, ["parent", "symbol"])
        .groupBy("context")
        .agg(F.sum(F.col("n") * F.log(ratio)).alias("gain"))
        .where(F.col("gain") >= LEAST_GAIN)
        .select("context")
    )
    root = frequent.where("context = ''")
    kept = frequent.join(gains, "context", "left_semi")
    return kept.unionByName(root).select("context", "symbol", "n", "total")


def tree_table(counts: DataFrame) -> DataFrame:
    """The whole tree: ``(context, symbol, n, total)``."""
    return checkpointed(retained(stored(suffix_counts(counts))))


def fits(kept: DataFrame, least: int = 0) -> bool:
    """Whether tasks can hold the contexts that precede so many symbols."""
    return kept.where((F.col("context") != "") & (F.col("total") >= least)).count() <= TREE_ROWS


def tree_rows(counts: DataFrame) -> list[tuple[str, str, int]]:
    """The rows of the tree's most frequent part, at most ``TREE_ROWS`` beside the root's.

    For use of a tree apart from a table; ``lm_scores`` takes every row.
    """
    kept, least = tree_table(counts), LEAST_COUNT
    while not fits(kept, least):
        least *= 2
    fitting = kept.where((F.col("context") == "") | (F.col("total") >= least))
    return _collected(fitting)


def _collected(kept: DataFrame) -> list[tuple[str, str, int]]:
    return [tuple(r) for r in kept.select("context", "symbol", "n").toLocalIterator()]


def smoothed(kept: DataFrame) -> DataFrame:
    """``(context, symbol, value, leave)``: what ``SuffixTree`` holds, of a tree of any size.

    ``value`` is the log10 probability of a symbol seen, ``leave`` that of leaving to the parent.
    """
    kinds = kept.groupBy("context").agg(F.count(F.lit(1)).alias("kinds"))
    rows = stored(kept.join(kinds, "context"))
    all_ = F.col("total") + F.col("kinds")

    def judged(level: DataFrame, above: Column) -> DataFrame:
        value = F.log10((F.col("n") + F.col("kinds") * above) / all_)
        leave = F.log10(F.col("kinds") / all_)
        return stored(level.select("context", "symbol", value.alias("value"), leave.alias("leave")))

    done = judged(rows.where("context = ''"), F.lit(1 / CODE_POINTS))
    for length in range(1, DEPTH + 1):
        here = rows.where(F.length("context") == length)
        start = F.explode(F.sequence(F.lit(2), F.lit(length + 1))).alias("start")
        shorter = here.select(F.col("context").alias("own"), "symbol", start)
        shorter = shorter.withColumn("context", F.expr("substring(own, start)"))
        # A retained suffix has all symbols of the context; the longest is the parent.
        found = shorter.join(done.select("context", "symbol", "value"), ["context", "symbol"])
        above = found.groupBy(F.col("own").alias("context"), "symbol").agg(
            F.min_by("value", "start").alias("above")
        )
        level = judged(here.join(above, ["context", "symbol"]), F.pow(F.lit(10.0), F.col("above")))
        done = done.unionByName(level)
    return done


def gram_scores(grams: DataFrame, kept: DataFrame) -> DataFrame:
    """``(gram, value)``: log10 probability of a gram's last symbol after those before it."""
    values = stored(smoothed(kept))
    leaves = values.groupBy("context").agg(F.any_value("leave").alias("leave"))
    starts = F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("start")
    parts = grams.select("gram", starts).select(
        "gram",
        "start",
        F.expr("substring(gram, start, length(gram) - start)").alias("context"),
        F.expr("right(gram, 1)").alias("symbol"),
    )
    held = parts.join(leaves, "context")
    held = held.join(values.select("context", "symbol", "value"), ["context", "symbol"], "left")
    # Every retained suffix that lacks the symbol is left; the longest that has it says the rest.
    seen = F.col("value").isNotNull()
    last = F.min_by("value", F.when(seen, F.col("start")))
    left = F.coalesce(F.sum(F.when(~seen, F.col("leave"))), F.lit(0.0))
    value = F.coalesce(last, F.lit(-math.log10(CODE_POINTS))) + left
    return held.groupBy("gram").agg(value.alias("value"))


def word_scores(words: DataFrame, kept: DataFrame) -> DataFrame:
    """``(word, lm)``: log10 probability of each distinct word; of the end for the empty one."""
    schema = pa.schema([("word", pa.string()), ("gram", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(word, gram) for word in batch.column(0).to_pylist() for gram in grams_of(word)]
            for at in range(0, len(pairs), GATHERED):
                yield _batch([list(c) for c in zip(*pairs[at : at + GATHERED], strict=True)], schema)

    pieces = words.select("word").mapInArrow(run, "word string, gram string")
    each = gram_scores(pieces.select("gram").distinct(), kept)
    return pieces.join(each, "gram").groupBy("word").agg(F.sum("value").alias("lm"))


class SuffixTree:
    """Smoothed next-symbol distributions of the retained contexts."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        counts: dict[str, dict[str, int]] = {"": {}}
        for context, symbol, n in rows:
            counts.setdefault(context, {})[symbol] = n
        self.parent: dict[str, str] = {}
        # Per context: log10 probability of each symbol seen, and of leaving to the parent.
        self.seen: dict[str, dict[str, float]] = {}
        self.leave: dict[str, float] = {}
        for context in sorted(counts, key=len):
            own = counts[context]
            kinds = max(len(own), 1)
            total = sum(own.values()) + kinds
            self.parent[context] = self.longest(context[1:]) if context else ""
            self.leave[context] = math.log10(kinds / total)
            self.seen[context] = {
                s: math.log10((n + kinds * 10 ** self._above(context, s)) / total)
                for s, n in own.items()
            }
        self.steps: dict[str, float] = {}

    def longest(self, suffix: str) -> str:
        """The longest suffix that is retained."""
        while suffix and suffix not in self.seen:
            suffix = suffix[1:]
        return suffix

    def _above(self, context: str, symbol: str) -> float:
        return self.log10(self.parent[context], symbol) if context else -math.log10(CODE_POINTS)

    def log10(self, context: str, symbol: str) -> float:
        """Log10 probability of a symbol after a retained context."""
        value = self.seen[context].get(symbol)
        return self.leave[context] + self._above(context, symbol) if value is None else value

    def word(self, word: str) -> float:
        """Log10 probability of a word with its end mark, where a word could start."""
        total = 0.0
        for gram in grams_of(word):
            step = self.steps.get(gram)
            if step is None:
                if len(self.steps) > 4 * GATHERED:
                    self.steps.clear()
                step = self.steps[gram] = self.log10(self.longest(gram[:-1]), gram[-1])
            total += step
        return total

    def end(self) -> float:
        """Log10 probability that the text ends where a word could start."""
        return self.log10(self.longest(START), END)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of every document by word counts and by the suffix tree.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.  Tokens are
    the words and one end.  A null text is empty and has the end only.  A document without
    an id is held out.  Repeated rows give repeated rows.  With nothing to train on, every
    token is unknown and every symbol as likely as any code point.

    Frequent words are looked up in the task; the others, whose number grows with the
    corpus, are counted per document and joined to the vocabulary.  A tree that tasks cannot
    hold is joined to the distinct words instead; the scores are the same.
    """
    counts = stored(word_counts(docs))
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    train_tokens, kinds = totals[0] or 0, totals[1]
    scale = math.log10(train_tokens + 0.1 * (kinds + 1))
    kept = tree_table(counts)
    tree = SuffixTree(_collected(kept)) if fits(kept) else None
    least = max(1, math.ceil(FREQUENT_SHARE * train_tokens))
    # At most 1 / FREQUENT_SHARE words are so frequent.
    common = counts.where(F.col("n") >= least)
    frequent = {
        r.word.encode(): math.log10(r.n + 0.1) - scale for r in common.toLocalIterator()
    }
    ends = counts.where("word = ''").select("n").first()
    end_base = math.log10((ends.n if ends else 0) + 0.1) - scale
    held: dict[bytes, float] = {}
    if tree is None:
        scored = stored(word_scores(word_counts(docs, every=True), kept))
        looked_up = scored.join(common.select("word"), "word", "left_semi")
        held = {r.word.encode(): r.lm for r in looked_up.toLocalIterator()}
        end_score = scored.where("word = ''").first().lm
    else:
        end_score = tree.end()
    model = docs.sparkSession.sparkContext.broadcast((tree, frequent, held))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_kind}, text_hash bigint, held_out boolean, word string, n bigint, "
        "n_tokens bigint, n_known bigint, base double, score double, copies bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, frequent, held = model.value
        known, scores = frequent.get, dict(held)
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        for batch in batches:
            rows = []
            kind = batch.schema.field(0).type
            for at in range(batch.num_rows):
                doc_id, text_hash = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                words = words_of(batch.column(2)[at].as_py())
                out = held_out(doc_id)
                values = [known(w) for w in words]
                rare = Counter(w for w, v in zip(words, values, strict=True) if v is None)
                found = [v for v in values if v is not None]
                score = end_score
                for word in words:
                    value = scores.get(word)
                    if value is None and tree is None:
                        continue  # joined
                    if value is None:
                        if len(scores) > GATHERED:
                            scores.clear()
                        value = scores[word] = tree.word(word.decode())
                    score += value
                # The document's own row joins nothing; its key spreads it.
                rows.append((doc_id, text_hash, out, f" {text_hash}", 0, len(words) + 1,
                             len(found) + (ends is not None), sum(found) + end_base, score, 1))
                rows += [(doc_id, text_hash, out, w.decode(), n, 0, 0, 0.0, 0.0, 0)
                         for w, n in rare.items()]
                if len(rows) > 50_000 or (rows and at == batch.num_rows - 1):
                    yield _rows(rows, names, kind)
                    rows = []

    texts = docs.select("doc_id", F.xxhash64(fold(F.col("text"))).alias("text_hash"), "text")
    parts = texts.mapInArrow(run, schema)
    others = counts.where(F.col("n") < least).withColumnRenamed("n", "in_training")
    if tree is None:
        rare = scored.join(common.select("word"), "word", "left_anti")
        others = rare.join(others, "word", "left")
    else:
        others = others.withColumn("lm", F.lit(0.0))
    joined = parts.join(others, "word", "left")
    rate = F.log10(F.coalesce("in_training", F.lit(0)) + F.lit(0.1)) - F.lit(scale)
    summed = joined.groupBy("doc_id", "text_hash", "held_out").agg(
        F.sum("copies").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("in_training") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * rate).alias("base_score"),
        F.sum(F.col("score") + F.col("n") * F.coalesce("lm", F.lit(0.0))).alias("score"),
    )
    # Equal rows were summed; each gets its share back.
    each = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(
        "doc_id",
        "held_out",
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )


def _rows(rows: list[tuple], names: list[str], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = [id_kind, pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
             pa.float64(), pa.float64(), pa.int64()]
    arrays = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)
