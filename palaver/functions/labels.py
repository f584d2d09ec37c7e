"""Label-set expressions: decoding, sentiment mapping, model replies, prompts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.fixed import (
    AMBIGUOUS_EMOTIONS,
    EMBEDDED_REPLY,
    EMOTIONS,
    NEGATIVE_EMOTIONS,
    POSITIVE_EMOTIONS,
    PROMPT_HEAD,
    PROMPT_TAIL,
    THRESHOLD,
)
from palaver.functions.text import strip, word_tokens


def string_array(values: Sequence[str]) -> Column:
    """A constant array column."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(value) for value in values])


def decode(joined: Column) -> Column:
    """``a|b`` to an array, without empty parts."""
    return F.filter(F.split(joined, "[|]"), lambda part: part != "")


def encode(labels: Column) -> Column:
    """An array to its ``a|b`` storage form."""
    return F.array_join(labels, "|")


def label_set(labels: Column) -> Column:
    """Canonical form of a label list: sorted, without repeats."""
    return F.array_sort(F.array_distinct(labels))


def names_of(indices: Column, vocabulary: Sequence[str] = EMOTIONS) -> Column:
    """Active label indices (0-based) to names; a bad index raises, a negative one too."""
    names = string_array(vocabulary)

    def name(i: Column) -> Column:
        message = F.concat(F.lit("no label has the index "), i.cast("string"))
        known = (i >= 0) & (i < len(vocabulary))
        named = F.element_at(names, i.cast("int") + 1)
        return F.when(i.isNull() | known, named).otherwise(F.raise_error(message))

    return F.transform(indices, name)


def indices_of(labels: Column, vocabulary: Sequence[str] = EMOTIONS) -> Column:
    """Names to 0-based indices; unknown names are left out."""
    names = string_array(vocabulary)
    found = F.transform(labels, lambda name: F.array_position(names, name) - 1)
    return F.filter(found, lambda i: i >= 0)


def sentiment_of(labels: Column) -> Column:
    """Three-class sentiment of a label list: negative wins over positive, and
    everything else, including no label at all, is neutral."""
    return (
        F.when(F.arrays_overlap(labels, string_array(NEGATIVE_EMOTIONS)), "negative")
        .when(F.arrays_overlap(labels, string_array(POSITIVE_EMOTIONS)), "positive")
        .otherwise("neutral")
    )


def group_of(emotion: Column) -> Column:
    """Reporting group of one emotion; ambiguous ones report as neutral."""
    return (
        F.when(emotion.isin(*POSITIVE_EMOTIONS), "positive")
        .when(emotion.isin(*NEGATIVE_EMOTIONS), "negative")
        .when(emotion.isin(*AMBIGUOUS_EMOTIONS, "neutral"), "neutral")
        .otherwise("unmapped")
    )


def above_threshold(
    scores: Column, vocabulary: Sequence[str] = EMOTIONS, threshold: float = THRESHOLD
) -> Column:
    """Labels whose score reaches the threshold, lower-cased, in vocabulary order."""
    paired = F.zip_with(
        string_array([name.lower() for name in vocabulary]),
        scores,
        lambda name, score: F.when(score >= F.lit(threshold), name),
    )
    return F.array_compact(paired)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Pieces of JSON: a key with its colon, another string, a bracket, anything else.
_PIECES = r'(?s)"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|[{\[]|[}\]]|[^"{}\[\]]+|"'
_ANSWERS = ("emotions", "labels")


def last_answers(text: Column) -> Column:
    """JSON text in which no key repeats: the last ``emotions`` and ``labels`` of the outer
    object keep their names, all other keys are numbered.

    JSON readers that allow a repeated key take its last value; Spark's allows none.
    """
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("place"),
        *[F.lit(-1).alias(name) for name in _ANSWERS],
    )

    def read(state: Column, piece: Column) -> Column:
        opened = F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        outer = state["depth"] == 1
        return F.struct(
            (state["depth"] + opened).alias("depth"),
            (state["place"] + 1).alias("place"),
            *[
                F.when(outer & piece.rlike(f'^"{name}"\\s*:$'), state["place"])
                .otherwise(state[name])
                .alias(name)
                for name in _ANSWERS
            ],
        )


    def named(listed: Column, last: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            kept = F.lit(False)
            for name in _ANSWERS:
                kept = kept | (last[name] == i)
            key = piece.startswith('"') & piece.endswith(":") & ~kept
            return F.when(key, F.concat(F.lit('"k'), i.cast("string"), F.lit('":'))).otherwise(piece)

        return F.array_join(F.transform(listed, one), "")

    return once(
        pieces,
        lambda listed: once(F.aggregate(listed, start, read), lambda last: named(listed, last)),
    )


def _json(text: Column) -> Column:
    """Text as JSON, a repeated key with its last value; null if it is none."""
    repeated = F.when(text.rlike(r"^\s*[{\[]"), F.try_parse_json(last_answers(text)))
    return F.coalesce(F.try_parse_json(text), repeated)


def parse_reply(raw: Column) -> Column:
    """Labels named by a model's free-form reply.

    Read as JSON when possible: an object's ``emotions`` (else ``labels``) entry
    as one string or a list, or a bare list.  Otherwise the first embedded object
    that mentions ``emotions`` is read.  Of a repeated key the last value counts.  Only if
    that yields no candidate at all, the vocabulary is searched in the text.  Invalid and
    repeated names go.
    """
    vocabulary = string_array(EMOTIONS)
    whole = _json(strip(raw))
    embedded = _json(F.regexp_extract(raw, EMBEDDED_REPLY, 0))

    def answer_of(payload: Column) -> Column:
        return F.coalesce(
            F.try_variant_get(payload, "$.emotions", "variant"),
            F.try_variant_get(payload, "$.labels", "variant"),
            F.when(F.schema_of_variant(payload).startswith("ARRAY"), payload),
        )

    def named_in(answer: Column) -> Column:
        items = F.try_variant_get(answer, "$", "array<variant>")
        return F.when(
            F.schema_of_variant(answer) == "STRING",
            F.array(F.try_variant_get(answer, "$", "string")),
        ).otherwise(F.transform(items, lambda item: F.try_variant_get(item, "$", "string")))

    named = once(F.coalesce(whole, embedded), lambda payload: once(answer_of(payload), named_in))
    spoken = F.array_intersect(vocabulary, word_tokens(F.lower(raw)))
    candidates = once(named, lambda found: F.when(F.size(found) > 0, found).otherwise(spoken))
    return F.array_intersect(
        F.transform(candidates, lambda name: F.lower(strip(name))), vocabulary
    )


def prompt(text: Column) -> Column:
    """The classification prompt for a text."""
    return F.concat(F.lit(PROMPT_HEAD + ", ".join(EMOTIONS) + PROMPT_TAIL), text)


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, in hex."""
    return F.sha2(text, 256)
