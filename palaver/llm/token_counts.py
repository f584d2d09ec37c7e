"""Token counts at every prefix of a text, for byte-level BPE vocabularies.

Byte-level BPE cuts a text into pieces and merges inside each piece.  A sequence of
tokens is the encoding of its bytes exactly if every neighbouring pair of tokens is the
encoding of that pair's bytes.  So the last token of every prefix of a piece follows from
the last tokens of shorter prefixes: it is the one token that ends there and that may
follow the last token of what stands before it.  That is a dynamic programme over the
piece; its count column is the number of tokens of every prefix.  The counts of a text are
the counts of its pieces, each raised by the tokens before it.

With the table at hand, truncation and budget questions need no further encoding.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import map_rows

# The published pre-tokenizer pattern of this kind of vocabulary (fixed value).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Scripts on whose letters and digits this Python's Unicode tables and the tokenizer
# library's agree, checked code point by code point.  Texts with other characters are cut
# into pieces by the library itself.
AGREED = "\x00-՗ -⁯℀-꜀가-힣豈-�\U0001f000-\U0001faff"

# Pieces remembered per Python worker, and the longest that are.  A character has up to four
# tokens, and a remembered count is one byte.
REMEMBERED = 500_000
SHORT = 63


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that such vocabularies use for the 256 byte values."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(others)})
    return letters


def _latin_piece() -> re.Pattern:
    """The same pattern for texts below U+0250, with classes written out for ``re``."""
    code_points = [chr(i) for i in range(0x250)]
    kinds = {
        kind: "".join(re.escape(c) for c in code_points if unicodedata.category(c)[0] == kind)
        for kind in "LN"
    }
    blank = "\t-\r \x85\xa0"
    return re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d"
        f"| ?[{kinds['L']}]+| ?[{kinds['N']}]+| ?[^{blank}{kinds['L']}{kinds['N']}]+"
        f"|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


class PrefixCounter:
    """Exact token counts of all prefixes of a text."""

    def __init__(self, vocabulary: str) -> None:
        if not os.path.exists(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        special = set(self.special)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left_raw, right_raw = raw(left), raw(right)
            key = (self.ids[left_raw], self.ids[right_raw])
            whole = self.ids[left_raw + right_raw]
            self.merge[key] = (rank, whole)
            # A token that can be made in two ways is made by the merge that comes first.
            self.parts.setdefault(whole, (rank, *key))
        # Finds, for every position, the tokens that end there, longest first.
        self.endings = ahocorasick.Automaton()
        for token, number in self.ids.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), number))
        self.endings.make_automaton()
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.stands: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.piece = regex.compile(PIECE)
        self.blank_run = regex.compile(r"\s{2,}(?=\S)")
        self.latin_piece = _latin_piece()
        self.latin = re.compile("[\x00-\u024f]*")
        self.unsure = regex.compile(f"[^{AGREED}]")
        self.cut = (
            regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
            if special
            else None
        )
        self.path = vocabulary
        self.library = None
        self.tables: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Token ids by applying the merges in order of rank; for two tokens' bytes only."""
        parts = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            found = [
                (self.merge[pair][0], i)
                for i, pair in enumerate(zip(parts, parts[1:], strict=False))
                if pair in self.merge
            ]
            if not found:
                break
            _, at = min(found)
            parts[at : at + 2] = [self.merge[parts[at], parts[at + 1]][1]]
        return parts

    def _fits(self, before: int, token: int) -> bool:
        known = self.may_follow.get((before, token))
        if known is None:
            if len(self.may_follow) > 2_000_000:
                self.may_follow.clear()
            known = self.may_follow[before, token] = self._parted(before, token)
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts along a token's left (0) or right (1) edge, from its byte to itself.

        Each comes with the rank of the merge that takes it up into the next.
        """
        edge = self.edges[side].get(token)
        if edge is None:
            edge, part, rank = [], token, len(self.merge)
            while True:
                edge.append((part, rank))
                made = self.parts.get(part)
                if made is None:
                    break
                rank, part = made[0], made[1 + side]
            edge.reverse()
            self.edges[side][token] = edge
        return edge

    def _parted(self, before: int, token: int) -> bool:
        """Whether no merge joins the end of one token to the start of the next.

        Merges happen in order of rank, and a part is made before the merge that takes it up.
        So the parts that meet at the border at any time follow from the ranks along both
        edges; a merge of the two that comes before either is taken up would happen.  Of
        equal merges the leftmost comes first.
        """
        left, right = self._edge(before, 1), self._edge(token, 0)
        i = j = 0
        while i < len(left) and j < len(right):
            (one, until), (other, up_to) = left[i], right[j]
            merge = self.merge.get((one, other))
            if merge is not None and merge[0] < until and merge[0] <= up_to:
                return False
            if until <= up_to:
                i += 1
            else:
                j += 1
        return True

    def _stands(self, token: int) -> bool:
        known = self.stands.get(token)
        if known is None:
            known = self.stands[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """Tokens of every byte prefix of one piece, from length 0 on."""
        counts, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        known, done = self.may_follow.get, -1
        for end, (length, token) in self.endings.iter(data.decode("latin-1")):
            if end == done:
                continue  # its one valid token is found
            start = end + 1 - length
            if start:
                before = last[start]
                fits = known((before, token))
                if fits is None:
                    fits = self._fits(before, token)
            else:
                fits = self._stands(token)
            if fits:
                counts[end + 1], last[end + 1], done = counts[start] + 1, token, end
        return counts

    def character_counts(self, piece: str) -> list[int]:
        """Tokens after each character of a piece."""
        counts = self.byte_counts(piece.encode())
        if piece.isascii():
            ends = counts[1:]
        else:
            at = np.cumsum([len(c.encode()) for c in piece])
            ends = [counts[i] for i in at]
        if piece in ("'re", "'ve", "'ll"):
            ends[1] = 2  # an unfinished contraction is two pieces
        return ends

    def remember(self, piece: str) -> bytes:
        """A short piece's counts, one byte each, kept for its next occurrence."""
        if len(self.tables) >= REMEMBERED:
            self.tables.clear()
        table = self.tables[piece] = bytes(self.character_counts(piece))
        return table

    def tables_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts inside each piece, joined, and the length of each piece."""
        known = self.tables.get
        if max(map(len, pieces)) <= SHORT:
            tables = [known(p) or self.remember(p) for p in pieces]
            inside = np.frombuffer(b"".join(tables), dtype=np.uint8).astype(np.int32)
        else:
            tables = [
                known(p) or (self.remember(p) if len(p) <= SHORT else self.character_counts(p))
                for p in pieces
            ]
            # Short tables are bytes, long ones lists; neighbouring short ones go together.
            runs = itertools.groupby(tables, key=type)
            inside = np.concatenate(
                [
                    np.frombuffer(b"".join(run), dtype=np.uint8).astype(np.int32)
                    if kind is bytes
                    else np.fromiter(itertools.chain.from_iterable(run), dtype=np.int32)
                    for kind, run in runs
                ]
            )
        return inside, np.fromiter(map(len, tables), dtype=np.int64, count=len(tables))

    def pieces(self, text: str) -> list[str]:
        if self.latin.fullmatch(text):
            return self.latin_piece.findall(text)
        if not self.unsure.search(text):
            return self.piece.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        spans = [span for _, span in self.library.pre_tokenize_str(text)]
        starts = sorted({start for start, _ in spans})
        return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]

    def _plain(self, text: str) -> np.ndarray:
        """Counts after 0, 1, 2, ... characters of a text without special strings."""
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        if text:
            inside, sizes = self.tables_of(self.pieces(text))
            totals = inside[np.cumsum(sizes) - 1]
            counts[1:] = inside + np.repeat(np.cumsum(totals) - totals, sizes)
            # White space at the end of a prefix is one piece, though in the whole text
            # its last character belongs to what follows.
            for run in self.blank_run.finditer(text):
                blank, _ = self.tables_of([run.group()])
                counts[run.end()] = counts[run.start()] + blank[-1]
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, 2, ... characters of a text."""
        if self.cut is None:
            return self._plain(text)
        out, at, base = [np.zeros(1, dtype=np.int32)], 0, 0
        for found in self.cut.finditer(text):
            # Up to its last character, the special string is ordinary text.
            length = found.start() - at
            counts = self._plain(text[at : found.end() - 1])
            whole = self._plain(text[at : found.start()])[-1]
            counts[length] = whole
            out += [base + counts[1:], np.asarray([base + whole + 1], dtype=np.int32)]
            base, at = base + int(whole) + 1, found.end()
        out.append(base + self._plain(text[at:])[1:])
        return np.concatenate(out)


@lru_cache(maxsize=4)
def counter_of(vocabulary: str) -> PrefixCounter:
    """One counter per worker process and vocabulary; what it remembers serves later tasks."""
    return PrefixCounter(vocabulary)


def prefix_token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_bytes, prefix_counts)``: the whole table of each text.

    ``prefix_counts[i]`` is the number of tokens of the first i characters, so the array
    has one entry more than the text has characters.  A null text counts as empty, with
    the table ``[0]``.  Repeated rows give repeated rows; other columns are not read.
    """

    def make():
        counter = counter_of(vocabulary)

        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                text = text or ""
                yield {
                    "doc_id": [doc_id],
                    "n_bytes": [len(text.encode())],
                    "prefix_counts": [counter.counts(text)],
                }

        return step

    schema = f"doc_id {_type(docs)}, n_bytes bigint, prefix_counts array<int>"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def tokens_at(prefix_counts: Column, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters, from a stored table."""
    position = characters if isinstance(characters, Column) else F.lit(characters)
    within = F.least(F.greatest(position, F.lit(0)), F.size(prefix_counts) - 1)
    return F.get(prefix_counts, within.cast("int"))


def characters_within(prefix_counts: Column, budget: int) -> Column:
    """Length of the longest prefix of at most ``budget`` tokens, from a stored table.

    A longer prefix can have fewer tokens than a shorter one, so this is the last length
    within the budget, not the one before the first beyond it.
    """
    fitting = F.transform(
        prefix_counts, lambda n, i: F.when(n <= budget, i).otherwise(F.lit(-1))
    )
    return F.array_max(fitting)


def token_budget(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, limit_chars)`` per document.

    The answers are read off the prefix table inside the task that builds it:
    ``n_tokens`` is its last entry and ``limit_chars`` the longest prefix of at most
    ``limit`` tokens.  A null text counts as empty: 0 tokens, not over any limit.
    """

    def make():
        counter = counter_of(vocabulary)

        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            texts = [t or "" for t in rows["text"]]
            tokens, fitting = [], []
            for text in texts:
                counts = counter.counts(text)
                tokens.append(int(counts[-1]))
                fitting.append(len(counts) - 1 - int(np.argmax(counts[::-1] <= limit)))
            yield {
                "doc_id": rows["doc_id"],
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
                "limit_chars": fitting,
            }

        return step

    schema = (
        f"doc_id {_type(docs)}, n_bytes bigint, n_tokens bigint, over_limit boolean, "
        "limit_chars bigint"
    )
    return map_rows(docs.select("doc_id", "text"), schema, make)


def _type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()
