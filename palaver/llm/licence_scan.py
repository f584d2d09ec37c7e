"""Licence notices found through a positional index of rare template words.

Every template is indexed by its rarest words, as measured over all documents, with their
positions in it.  A file's rare words vote for the places where a template would have to
start; words of one template that agree on a place are intersected by relative position.
A place with enough of the indexed weight is verified: the template's key phrases have to
stand there.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import map_rows

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Rare words indexed per template: for short phrases and for notices.
PHRASE_WORDS, NOTICE_WORDS, SHORT = 2, 6, 6
# Share of a notice's indexed weight that has to agree on one place.
AGREEMENT = 0.5
# Words that a key phrase may stand outside of the template's place.
SLACK = 8


@dataclass(frozen=True)
class Template:
    """A notice and the phrases it must have; an exact one must stand word for word."""

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()
    exact: bool = False


BASE = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)

# Openings of published licence notices (fixed values).
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        ("permission is hereby granted", "without restriction"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license",
        ("apache license", "except in compliance with the license"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("source and binary forms", "with or without modification"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    Template("gpl-2", "gnu general public license version 2",
             ("gnu general public license", "version 2")),
    Template("gpl-3", "gnu general public license version 3",
             ("gnu general public license", "version 3")),
    Template("lgpl-3", "gnu lesser general public license version 3",
             ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "gnu affero general public license version 3",
             ("gnu affero general public license", "version 3")),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template("cc-by-nc", "creative commons attribution noncommercial",
             ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "creative commons attribution sharealike",
             ("creative commons attribution sharealike",)),
    Template("cc0", "creative commons cc0 1 0 universal public domain dedication",
             ("public domain dedication",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of 0-9, a-z and everything beyond ASCII."""
    return WORD.findall((text or "").encode().lower())


class RareWordIndex:
    """Postings of the rarest words of each template."""

    def __init__(self, templates: Sequence[Template], weight: dict[bytes, float]) -> None:
        self.templates = list(templates)
        self.words = [words_of(t.text) for t in templates]
        self.phrases = [[words_of(p) for p in t.key_phrases] for t in templates]
        self.weight = weight
        self.total = [sum(weight[w] for w in words) or 1.0 for words in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.indexed = []
        for number, words in enumerate(self.words):
            most = PHRASE_WORDS if len(words) <= SHORT else NOTICE_WORDS
            rarest = sorted(set(words), key=lambda w: (-weight[w], w))[:most]
            for at, word in enumerate(words):
                if word in rarest:
                    self.postings[word].append((number, at))
            self.indexed.append(sum(weight[w] for w in words if w in rarest) or 1.0)
        self.postings = dict(self.postings)

    def _stands(self, phrase: list[bytes], words: list[bytes], low: int, high: int) -> bool:
        size = len(phrase)
        for at in range(max(0, low), min(len(words), high) - size + 1):
            if words[at] == phrase[0] and words[at : at + size] == phrase:
                return True
        return False

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """``(label, start, length, score, exact)`` of every verified place."""
        found = self.postings.keys()
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for at, word in enumerate(words):
            if word in found:
                for number, inside in self.postings[word]:
                    votes[number, at - inside] += self.weight[word]
        out = []
        for (number, start), agreed in votes.items():
            template, own = self.templates[number], self.words[number]
            if agreed < (1.0 if template.exact else AGREEMENT) * self.indexed[number] - 1e-9:
                continue
            if template.exact:
                if start >= 0 and words[start : start + len(own)] == own:
                    out.append((template.label, start, len(own), 1.0, True))
                continue
            low, high = start - SLACK, start + len(own) + SLACK
            if all(self._stands(p, words, low, high) for p in self.phrases[number]):
                same = sum(
                    self.weight[w]
                    for i, w in enumerate(own)
                    if 0 <= start + i < len(words) and words[start + i] == w
                )
                score = min(1.0, same / self.total[number])
                out.append((template.label, max(0, start), len(own), score, False))
        return sorted(out)


def word_weights(docs: DataFrame, templates: Sequence[Template]) -> dict[bytes, float]:
    """Inverse document frequency of the templates' words over all documents.

    The result has one entry per distinct template word, so its size is the templates'.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))

    def make():
        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            seen = Counter()
            for text in rows["text"]:
                seen.update(vocabulary.intersection(words_of(text)))
            seen[b""] = len(rows["text"])
            yield {"word": [w.decode() for w in seen], "n": list(seen.values())}

        return step

    counted = map_rows(docs.select("text"), "word string, n bigint", make)
    rows = {r.word.encode(): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    everything = rows.get(b"", 0)
    return {w: math.log((everything + 2) / (rows.get(w, 0) + 1)) for w in vocabulary}


def scan_licences(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES) -> DataFrame:
    """``(doc_id, n_words, matches)`` of every document.

    A match has its label, first word, length in words, score (the share of the template's
    weight that stands in its place) and whether the template is an exact phrase.  Null
    and empty texts have no words and no matches; repeated rows match alike.
    """
    weight = word_weights(docs, templates)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("label", "start", "length", "score", "exact")

    def make():
        index = RareWordIndex(templates, weight)

        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            worded = [words_of(t) for t in rows["text"]]
            yield {
                "doc_id": rows["doc_id"],
                "n_words": [len(w) for w in worded],
                "matches": [
                    [dict(zip(names, m, strict=True)) for m in index.matches(w)] for w in worded
                ],
            }

        return step

    schema = (
        f"doc_id {kind}, n_words bigint, matches array<struct<label: string, start: bigint, "
        "length: bigint, score: double, exact: boolean>>"
    )
    return map_rows(docs.select("doc_id", "text"), schema, make)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def licence_table(docs: DataFrame) -> DataFrame:
    """Counts, places and labels of every document; no match gives null places, no labels."""
    scanned = scan_licences(docs)
    base = F.filter("matches", lambda m: m["exact"])
    start = F.transform(base, lambda m: m["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        _joined(F.transform(base, lambda m: m["label"])).alias("base_labels"),
        _joined(F.transform("matches", lambda m: m["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
        .alias("score"),
    )
