"""Term, bigram, emoji, keyword and lexicon statistics over comment bodies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.fixed import KEYWORDS, NEGATIVE_WORDS, POSITIVE_WORDS
from palaver.functions import text as X
from palaver.functions.values import ratio
from palaver.operators.common import compute_once, single, top, value_counts
from palaver.operators.vocabulary import Neighbours, frequent_terms

# Patterns with a literal from which on one shared pass looks for all their literals.
SHARED_PATTERNS = 16

def term_counts(df: DataFrame, min_length: int = 3) -> DataFrame:
    """``(term, count)`` for every term."""
    exploded = df.select(F.explode(X.raw_tokens(F.col("comment_body"))).alias("term"))
    return value_counts(
        exploded.where(X.is_term(F.col("term"), min_length)), "term", name="count"
    )


def word_frequencies(df: DataFrame, n: int = 50, min_length: int = 3) -> DataFrame:
    """``(term, count, share)``: the n most frequent terms; share is of all terms."""
    counts = term_counts(df, min_length)
    total = single(counts.agg(F.sum("count")))
    return top(counts, n, F.desc("count"), F.asc("term")).withColumn(
        "share", ratio(F.col("count"), total)
    )


def top_terms(df: DataFrame, n: int = 20) -> DataFrame:
    """The dashboard's short term list."""
    return word_frequencies(df, n)


def cloud_terms(df: DataFrame, max_words: int = 100) -> DataFrame:
    """``(term, count)`` candidates for a word cloud, twice as many as it shows."""
    return word_frequencies(df, 2 * max_words).select("term", "count")


def bigram_frequencies(df: DataFrame, n: int = 30, min_length: int = 3) -> DataFrame:
    """``(bigram, count)``: neighbours after stopword removal, within one comment.

    A task holds counters and the pairs that may be among the first, not all distinct pairs.
    """
    pairs = Neighbours(lambda text: X.terms(text, min_length), alone=False)
    found = frequent_terms(df, "comment_body", n, 1, pairs)
    counts = found.select(F.col("term").alias("bigram"), F.col("tf").alias("count"))
    return top(counts, n, F.desc("count"), F.asc("bigram"))


def emoji_frequencies(df: DataFrame, n: int = 20) -> DataFrame:
    """``(emoji, count)``: a run of several emoji is one term."""
    runs = df.select(F.explode(X.emoji_runs(F.col("comment_body"))).alias("emoji"))
    return top(value_counts(runs, "emoji", name="count"), n, F.desc("count"), F.asc("emoji"))


def matching_comments(df: DataFrame, term: str) -> DataFrame:
    """All comments that contain the term as a whole word."""
    if not term:
        return df.where(F.lit(False))
    return df.where(X.contains_term(F.col("comment_body"), term))


def comments_containing_term(
    df: DataFrame, term: str, limit: int = 10, order_by: Sequence[str] = ("comment_id",)
) -> DataFrame:
    """The first ``limit`` matches, each with the total number of matches."""
    matches = matching_comments(df, term)
    total = single(matches.agg(F.count(F.lit(1))))
    shown = ["post_title", "comment_body", "comment_score", "comment_author"]
    first = top(matches, limit, *[F.col(name) for name in order_by])
    return first.select(*shown).withColumn("total_matches", total)


def keyword_frequencies(
    df: DataFrame, keywords: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """``(keyword, comments_with_keyword, total_mentions, pct_comments)``.

    Every pattern is counted in the same pass and one aggregate; keywords without
    a hit stay.  Patterns are case-insensitive and Unicode-aware.  Of many patterns, those
    that need some literal text are tried only on comments that have it, which one shared
    pass over each comment tells for all of them.
    """
    keywords = list(keywords or KEYWORDS)
    body, folded = F.col("comment_body"), F.col("_folded")
    needed = [X.required_literal(pattern) for _, pattern in keywords]
    if sum(n is not None for n in needed) >= SHARED_PATTERNS:
        counted = _counted_together(df, [p for _, p in keywords], needed)
        counts = [(F.get("c", F.lit(i)), F.get("m", F.lit(i))) for i in range(len(keywords))]
    else:
        hits = df.select(body, X.fold_case(body).alias("_folded")).select(
            *[
                X.pattern_hits(body, folded, pattern).alias(f"_{i}")
                for i, (_, pattern) in enumerate(keywords)
            ]
        )
        counted = hits.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col(f"_{i}") > 0).alias(f"c{i}") for i in range(len(keywords))],
            *[F.sum(f"_{i}").alias(f"m{i}") for i in range(len(keywords))],
        )
        counts = [(F.col(f"c{i}"), F.col(f"m{i}")) for i in range(len(keywords))]
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("keyword"),
                comments.alias("comments_with_keyword"),
                mentions.alias("total_mentions"),
                F.round(ratio(comments, F.col("n")) * 100, 2).alias("pct_comments"),
            )
            for (label, _), (comments, mentions) in zip(keywords, counts, strict=True)
        ]
    )
    return top(
        counted.where(F.col("n") > 0).select(F.inline(entries)),
        len(keywords),
        F.desc("comments_with_keyword"),
        F.asc("keyword"),
    )


def _counted_together(
    df: DataFrame, patterns: Sequence[str], needed: Sequence[str | None]
) -> DataFrame:
    """``(n, c, m)``: comments, and per pattern the comments with it and its mentions.

    A comment yields a row for itself and one per pattern that hits it, not one value per
    pattern; those rows are added up before they are shuffled.  Whole words are counted among
    the comment's words and take no regular expression.
    """
    body, folded = F.col("comment_body"), F.col("_folded")
    rows = df.select(body, X.fold_case(body).alias("_folded"))
    words = {p: m.group(1) for p in patterns if (m := re.fullmatch(r"\\b([a-z0-9_]+)\\b", p))}
    others = [(i, p, n) for i, (p, n) in enumerate(zip(patterns, needed, strict=True)) if p not in words]
    literals = sorted({n for _, _, n in others if n})
    if literals:
        rows = compute_once(rows, "_found", X.shared_literals(folded, literals))
    if words:
        wanted = sorted(set(words.values()))
        said = F.filter(X.word_tokens(folded), lambda word: word.isin(wanted))
        rows = compute_once(rows, "_said", said)
    # A literal is also there where a longer one that begins with it is.
    longer = {n: F.lit([x for x in literals if x.startswith(n)]) for n in literals}

    def hits_of(pattern: str, need: str | None) -> Column:
        if need is None:
            return X.pattern_hits(body, folded, pattern)
        counted = F.regexp_count(body, F.lit(X.java_regex(pattern)))
        return F.when(F.arrays_overlap("_found", longer[need]), counted).otherwise(0)

    def entry(key: Column, hits: Column) -> Column:
        return F.struct(key.alias("key"), hits.cast("bigint").alias("hits"))

    # The row of the comment itself has an empty key, patterns have their numbers or words.
    listed = F.array(
        entry(F.lit(""), F.lit(1)),
        *[entry(F.lit(f"/{i}"), hits_of(pattern, need)) for i, pattern, need in others],
    )
    if words:
        counted = F.transform(
            F.array_distinct("_said"),
            lambda word: entry(word, F.size(F.filter("_said", lambda other: other == word))),
        )
        nothing = F.array().cast("array<struct<key: string, hits: bigint>>")
        listed = F.concat(listed, F.coalesce(counted, nothing))
    hits = rows.select(F.inline(listed)).where(F.col("hits") > 0)
    each = hits.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("hits").alias("m"))
    every = F.map_from_entries(F.collect_list(F.struct("key", F.struct("c", "m").alias("x"))))
    keys = F.lit([words.get(p, f"/{i}") for i, p in enumerate(patterns)])
    zero = F.lit(0).cast("bigint")

    def of(name: str) -> Column:
        return F.transform(
            keys, lambda key: F.coalesce(F.try_element_at("by", key)[name], zero)
        ).alias(name)

    comments = F.coalesce(F.try_element_at("by", F.lit(""))["c"], zero)
    return each.agg(every.alias("by")).select(comments.alias("n"), of("c"), of("m"))


def lexicon_word_counts(df: DataFrame) -> DataFrame:
    """``(word, polarity, count)`` of whole-word hits, words without a hit left out.

    A body is split into words once; only lexicon words survive to the aggregate,
    which therefore holds at most one entry per lexicon word.
    """
    words = df.select(F.explode(X.word_tokens(F.lower("comment_body"))).alias("word"))
    known = words.where(F.col("word").isin(*POSITIVE_WORDS, *NEGATIVE_WORDS))
    polarity = F.when(F.col("word").isin(*POSITIVE_WORDS), "positive").otherwise("negative")
    return top(
        value_counts(known, "word", name="count").select(
            "word", polarity.alias("polarity"), "count"
        ),
        len(POSITIVE_WORDS) + len(NEGATIVE_WORDS),
        F.desc("count"),
        F.asc("word"),
    )


def lexicon_summary(df: DataFrame) -> DataFrame:
    """One row: mentions, comments and percentage of comments per polarity."""
    listed = F.filter(
        X.word_tokens(X.fold_case(F.col("comment_body"))),
        lambda word: word.isin(*POSITIVE_WORDS, *NEGATIVE_WORDS),
    )
    hits = df.select(listed.alias("hits")).select(
        F.size(F.filter("hits", lambda word: word.isin(*POSITIVE_WORDS))).alias("pos"),
        F.size(F.filter("hits", lambda word: word.isin(*NEGATIVE_WORDS))).alias("neg"),
    )
    counted = hits.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positive_mentions"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negative_mentions"),
        F.count_if(F.col("pos") > 0).alias("comments_with_positive"),
        F.count_if(F.col("neg") > 0).alias("comments_with_negative"),
    )
    return counted.select(
        "positive_mentions",
        "negative_mentions",
        "comments_with_positive",
        "comments_with_negative",
        *[
            F.round(ratio(F.col(f"comments_with_{side}"), F.col("n")) * 100, 2).alias(
                f"pct_{side}_comments"
            )
            for side in ("positive", "negative")
        ],
    )
