"""Text expressions.  Every function maps columns to a column, without a UDF."""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.fixed import (
    EMOJI_SET,
    MARKDOWN_LINK,
    STOPWORDS,
    WORD_SET,
    WS_CHARS,
)

_WORD = f"[{WORD_SET}]"
# A word edge that treats every Unicode letter and digit as a word character, on
# any Java version: the built-in \b changed its meaning between releases.
WORD_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# The whitespace set of `WS_SET` in Java's terms.  Under (?U), \s is one test for
# all Unicode whitespace; listing the ranges one by one is several times slower.
_SPACE = r"\s\x1c-\x1f"


def strip(text: Column) -> Column:
    """Drop Unicode whitespace from both ends (SQL ``trim`` drops only spaces)."""
    return F.btrim(text, F.lit(WS_CHARS))


def word_count(text: Column) -> Column:
    """Whitespace-separated tokens; 0 for blank text."""
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"(?U)[{_SPACE}]+")))


def word_count_collapsed(text: Column) -> Column:
    """``word_count`` of text that is stripped and holds only single spaces."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" ")))
    return F.when(text == "", F.lit(0)).otherwise(spaces + 1)


def collapse_whitespace(text: Column) -> Column:
    """Every whitespace run to one space, ends stripped.

    Lone spaces, the bulk of all runs, are not matched and so not rewritten.
    """
    runs = rf"(?U)[{_SPACE}&&[^ ]][{_SPACE}]*| [{_SPACE}]+"
    return strip(F.regexp_replace(text, runs, " "))


def strip_urls(text: Column) -> Column:
    """Keep the label of markdown links, blank out URLs, collapse whitespace.

    Plain substring tests guard the patterns: text without ``](`` holds no link, and
    text that also lacks ``://`` and ``www.`` holds no URL.  Each pattern appears
    once in the expression, so nothing relies on common subexpressions being found.
    """
    linked = F.contains(text, F.lit("]("))
    urls = linked | F.contains(text, F.lit("://")) | F.contains(F.lower(text), F.lit("www."))
    labels = F.when(linked, F.regexp_replace(text, MARKDOWN_LINK, "$1")).otherwise(text)
    stop = rf"[^{_SPACE}\)\]>\"']+"
    bare = F.regexp_replace(labels, rf"(?iU)https?://{stop}|www\.{stop}", " ")
    return collapse_whitespace(F.when(urls, bare).otherwise(text))


def raw_tokens(text: Column) -> Column:
    """Lower-case ASCII token candidates, apostrophes removed, unfiltered."""
    return F.split(F.replace(F.lower(text), F.lit("'")), r"\P{Alnum}+")


def is_term(token: Column, min_length: int = 3) -> Column:
    """Whether a raw token counts as a term."""
    return (F.length(token) >= min_length) & ~token.isin(list(STOPWORDS))


def terms(text: Column, min_length: int = 3) -> Column:
    """The terms of a text in order, as an array."""
    return F.filter(raw_tokens(text), lambda token: is_term(token, min_length))


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space; the last entry is null."""
    return F.zip_with(
        tokens,
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )


def emoji_runs(text: Column) -> Column:
    """Maximal runs over the emoji ranges.

    The widest range also covers CJK, kana and Hangul, so such text counts as
    emoji.  That is the defined behaviour, not an accident of this expression.
    All ranges begin at or above U+24C2; text below it is not searched.
    """
    runs = F.regexp_extract_all(text, F.lit(f"[{EMOJI_SET}]+"), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x{24C1}]"), runs)


def fold_case(text: Column) -> Column:
    """Lower case in which every letter that matches i, s or k regardless of case
    is that letter."""
    out = text
    for odd, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        out = F.replace(out, F.lit(odd), F.lit(plain))
    return F.lower(out)


def word_tokens(lowered: Column) -> Column:
    """Whole words (letters, digits and underscore of any script) of lower-cased text."""
    return F.split(lowered, f"[^{WORD_SET}]+")


def java_regex(pattern: str) -> str:
    """A Unicode, case-insensitive Java form of a user's regular expression.

    ``\\b``, ``\\w``, ``\\d``, ``\\s`` and their opposites in capitals take their Unicode
    meaning, the one the built-in keyword patterns are written for.
    """
    spelled = {
        "b": WORD_EDGE, "w": _WORD, "d": r"\p{Nd}", "s": f"[{_SPACE}]",
        "W": f"[^{WORD_SET}]", "D": r"\P{Nd}", "S": f"[^{_SPACE}]",
    }
    body = re.sub(r"\\(.)", lambda m: spelled.get(m.group(1), m.group(0)), pattern)
    return "(?iU)" + body


def pattern_hits(text: Column, folded: Column, pattern: str) -> Column:
    """Number of hits of a user's regular expression in a text.

    ``folded`` is ``fold_case(text)``.  A word or phrase between word edges is
    looked up there as a substring first.  Any other pattern without groups is
    first tried without its word edges, which can only match more; an edge with a
    quantifier stays as it is.  Either way the
    full pattern, with its costly edges, runs on candidate texts alone.
    """
    hits = F.regexp_count(text, F.lit(java_regex(pattern)))
    phrase = re.fullmatch(r"\\b([a-z0-9 ]+)\\b", pattern)
    if phrase:
        return F.when(F.contains(folded, F.lit(phrase.group(1))), hits).otherwise(0)
    bare_edges = not re.search(r"\\b[?*+{]", pattern)
    if r"\b" in pattern and "(" not in pattern and r"\\" not in pattern and bare_edges:
        loose = java_regex(pattern.replace(r"\b", ""))
        return F.when(text.rlike(loose), hits).otherwise(0)
    return hits


def required_literal(pattern: str) -> str | None:
    """The longest text that every match of a pattern contains, in lower case; None if unknown.

    Only ASCII letters, digits, spaces and underscores count, of which ``fold_case`` keeps
    all; anything optional, repeated or alternative ends a run of them.
    """
    try:
        parsed = parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    runs = [""]

    def read(items) -> None:
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL" and (chr(value).isalnum() or chr(value) in "_ ") and value < 128:
                runs[-1] += chr(value).lower()
            elif name == "AT":
                continue  # an edge takes no room
            else:
                runs.append("")
                if name == "SUBPATTERN":
                    read(value[3])
                elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                    read(value[2])
                elif name == "ATOMIC_GROUP":
                    read(value)
                runs.append("")

    if parsed.state.flags & re.VERBOSE:
        return None
    read(parsed)
    longest = max(runs, key=len)
    return longest if len(longest) > 1 else None


def any_literal(literals: Sequence[str]) -> str:
    """A regular expression whose group 1 is the longest of the literals at a place.

    It takes no room, so that every place of a text is tried.  Literals with a common start
    share it, so a place is left at the first character that none of them goes on with.
    """
    tree: dict = {}
    for literal in literals:
        node = tree
        for char in literal:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [java_literal(c) + written(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        chosen = f"(?:{'|'.join(ways)})"
        return chosen + "?" if "" in node else chosen

    return f"(?=({written(tree)}))"


def shared_literals(folded: Column, literals: Sequence[str]) -> Column:
    """Which of the literals a text contains, from one pass over it.

    ``folded`` is ``fold_case`` of the text.  The longest literal at a place stands for those
    that it begins with.
    """
    found = F.regexp_extract_all(folded, F.lit(any_literal(literals)), F.lit(1))
    return F.array_distinct(found)


def java_literal(text: str) -> str:
    """A literal escaped for Java regular expressions, character by character."""
    return "".join(c if c.isalnum() or c in "_ " else f"\\x{{{ord(c):x}}}" for c in text)


def contains_term(text: Column, term: str) -> Column:
    """Whole-word, case-insensitive search for a literal.

    A word edge is required at both ends.  A term that begins or ends with a
    non-word character therefore needs a word character next to it.
    """
    needle = term.lower()

    def is_word(char: str) -> bool:
        return char == "_" or char.isalnum()

    before = f"(?<!{_WORD})" if is_word(needle[0]) else f"(?<={_WORD})"
    after = f"(?!{_WORD})" if is_word(needle[-1]) else f"(?={_WORD})"
    lowered = F.lower(text)
    return F.contains(lowered, F.lit(needle)) & lowered.rlike(
        before + java_literal(needle) + after
    )
