"""Personal data in texts: plain patterns, and contexts learned from what they match.

E-mail addresses, IP addresses, card numbers and telephone numbers that match a pattern are
the seeds.  The words around them are lexical patterns.  Other words with a digit or an at
sign are candidates, with patterns of their own.  Patterns and instances (distinct texts)
form a graph, which is scored in rounds: a pattern by the share of its instances that are
accepted as one kind, an instance by the patterns that it is found in.  Instances beyond a
threshold are accepted and induce patterns in the next round.  In the end a candidate is
found where its instance is accepted and a pattern of that kind stands around it.

The rounds are joins and sums over distinct (pattern, instance) pairs.  Patterns of fewer
instances than a pattern must have accepted can never count and are left out beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import WORD, map_rows, stored
from palaver.operators.skew import join_unique

KINDS = ("email", "ip", "card", "phone")
# Accepted instances that a pattern needs, and their least share (one more instance counted).
LEAST_INSTANCES, LEAST_SHARE = 3, 0.75
# Least probability that some pattern of an instance is right.
ACCEPT = 0.9
ROUNDS = 3
# Characters of context read on either side.
LEFT, RIGHT = 80, 40

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]+")
# Signs around a word that are not part of a candidate, and words of digits and such signs.
EDGES = ".,;:!?\"'()[]{}<>|*#&$%`"
ENDS = ".,;:!?"
NUMERIC = re.compile(r"[0-9().+/-]*[0-9][0-9().+/-]*")
MOST_DIGITS = 19


def _digits(text: str) -> int:
    return sum(map(len, DIGITS.findall(text)))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, leftmost first: what stands before each at sign, if a domain follows."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return not (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of every match, by kind, then start."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for found in IP.finditer(text):
            if all(map(_small, found.group().split("."))):
                spans.append((1, *found.span()))
        for found in CARD.finditer(text):
            # The separators are single, so a chain that short has few digits.
            if 16 <= found.end() - found.start() < 2 * MOST_DIGITS:
                digits = "".join(DIGITS.findall(found.group()))
                if 16 <= len(digits) <= MOST_DIGITS and _luhn(digits):
                    spans.append((2, *found.span()))
        if "+" in text:
            for found in PHONE.finditer(text):
                if 8 <= _digits(found.group()) <= 15:
                    spans.append((3, *found.span()))
    return spans


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with a digit or an at sign outside the spans, without the signs around them.

    Neighbouring words of digits and signs between them are one candidate while it has no
    more digits than a card.
    """
    out: list[tuple[int, int]] = []
    taken = sorted((a, b) for _, a, b in spans)
    at = 0
    joined, last = 0, 0  # digits of the last candidate if a number may follow it, and its end
    for found in WORD.finditer(text):
        word = found.group()
        if "@" not in word and not DIGITS.search(word):
            joined = 0
            continue
        while at < len(taken) and taken[at][1] <= found.start():
            at += 1
        if at < len(taken) and taken[at][0] < found.end():
            joined = 0
            continue
        bare = word.lstrip(EDGES)
        start = found.end() - len(bare)
        end = start + len(bare.rstrip(EDGES))
        digits = _digits(word)
        number = NUMERIC.fullmatch(word.rstrip(ENDS)) is not None
        if number and joined and joined + digits <= MOST_DIGITS and found.start() == last + 1:
            out[-1] = (out[-1][0], end)
            joined += digits
        else:
            out.append((start, end))
            joined = digits if number else 0
        if word[-1] in ENDS:
            joined = 0
        last = found.end()
    return out


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: one or two words before it, and one on each side.

    A-Z are lower-cased, digits written as 0; what touches the span counts as a word.
    """
    before = _plain(text[max(0, start - LEFT) : start]).split()[-2:]
    after = _plain(text[end : end + RIGHT]).split()[:1]
    out = [" ".join([*before[i:], "_"]) for i in range(len(before))]
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _plain(text: str) -> str:
    return DIGITS.sub("0", text).lower()


def mark_private(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, base, marks)``: a number of the row, its base spans, all instances.

    ``base`` is an array of (kind, start, end) with the number of the kind and offsets in
    code points, end exclusive.  ``marks`` has the kind (null for candidates), the instance's
    text in lower case, its place and the patterns around it.
    """

    def make():
        def step(rows: dict[str, list]) -> Iterator[dict[str, list]]:
            base, marks = [], []
            for text in rows["text"]:
                text = text or ""
                spans = base_spans(text)
                known = [(k, a, b) for k, a, b in spans]
                if "@" in text or DIGITS.search(text):
                    known += [(None, a, b) for a, b in candidates(text, spans)]
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                marks.append(
                    [
                        {
                            "kind": k,
                            "instance": text[a:b].lower(),
                            "start": a,
                            "end": b,
                            "patterns": patterns_of(text, a, b),
                        }
                        for k, a, b in known
                        if a < b
                    ]
                )
            yield {"row": rows["row"], "doc_id": rows["doc_id"], "base": base, "marks": marks}

        return step

    span = "kind: int, start: bigint, end: bigint"
    mark = "kind: int, instance: string, start: bigint, end: bigint, patterns: array<string>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"),
        f"row bigint, doc_id {kind}, base array<struct<{span}>>, marks array<struct<{mark}>>",
        make,
    )


def _may_be(kind: Column, instance: Column) -> Column:
    """Whether a text can be of the kind by its signs alone."""
    digits = F.length(F.regexp_replace(instance, "[^0-9]", ""))
    return (
        F.when(kind == 0, instance.contains("@"))
        .when(kind == 1, (digits >= 4) & instance.rlike("[.:]"))
        .when(kind == 2, digits.between(12, MOST_DIGITS))
        .otherwise(digits.between(5, 15))
    )


def bootstrap(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pattern, kind, share)`` and ``(instance, kind, confidence, seed)``, learned in rounds.

    ``marked`` is ``mark_private`` of the documents, stored.  A pattern's share is that of
    its distinct instances that are accepted, counting one more that is not; an instance's
    confidence is the probability that not all of its patterns are wrong.  Seeds have
    confidence 1 and keep their kind.
    """
    marks = marked.select(F.explode("marks").alias("m")).select("m.*")
    seeds = marks.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    sure = [F.lit(1.0).alias("confidence"), F.lit(True).alias("seed")]
    seeds = stored(seeds.select("instance", "kind", *sure))
    edges = marks.select("instance", F.explode("patterns").alias("pattern")).distinct()
    edges = stored(edges)
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("copies"))
    sizes = stored(sizes.where(F.col("copies") >= LEAST_INSTANCES))
    edges = stored(edges.join(sizes.select("pattern"), "pattern", "left_semi"))
    degrees = stored(edges.groupBy("instance").agg(F.count(F.lit(1)).alias("copies")))

    accepted, many, patterns = seeds, -1, None
    for _ in range(ROUNDS):
        held = join_unique(edges, accepted, "instance", "pattern", "inner", degrees)
        share = F.col("weight") / (F.col("copies") + 1)
        weights = held.groupBy("pattern", "kind").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("weight")
        )
        patterns = stored(
            weights.where(F.col("n") >= LEAST_INSTANCES)
            .join(sizes, "pattern")
            .where(share >= LEAST_SHARE)
            .select("pattern", "kind", share.alias("share"))
        )
        # Shares beyond one half leave room for one kind a pattern.
        matched = join_unique(edges, patterns, "pattern", "instance", "inner", sizes)
        wrong = F.exp(F.sum(F.log1p(-F.col("share"))))
        scored = matched.groupBy("instance", "kind").agg(F.round(1 - wrong, 6).alias("confidence"))
        scored = scored.where(
            (F.col("confidence") >= ACCEPT) & _may_be(F.col("kind"), F.col("instance"))
        ).join(seeds.select("instance"), "instance", "left_anti")
        best = F.max(F.struct("confidence", -F.col("kind"))).alias("best")
        new = scored.groupBy("instance").agg(best)
        new = new.select("instance", (-F.col("best.col2")).alias("kind"), "best.confidence")
        accepted = stored(seeds.unionByName(new.withColumn("seed", F.lit(False))))
        before, many = many, accepted.count()
        if many == before:
            break
    return patterns, accepted


def find_private(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)``: the base spans of every document, and all that are found.

    Spans are (kind, start, end) by kind, then start; kinds are numbers into ``KINDS``,
    offsets count code points, the end is exclusive.  Base spans stay.  A null or empty text
    has none.  Repeated rows give repeated rows; other columns are not read.
    """
    marked = stored(mark_private(docs))
    patterns, accepted = bootstrap(marked)
    free = marked.select("row", F.explode("marks").alias("m")).where("m.kind is null")
    free = free.select("row", "m.instance", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    new = accepted.where("not seed").select("instance", F.col("kind").alias("of"))
    placed = join_unique(free, patterns, "pattern", "row", "inner")
    placed = join_unique(placed, new, "instance", "row", "inner").where("kind = of")
    found = (
        placed.select("row", "kind", "start", "end")
        .distinct()
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    )
    both = F.array_sort(F.concat("base", "found"))
    spans = F.when(F.col("found").isNull(), F.col("base")).otherwise(both)
    return marked.drop("marks").join(found, "row", "left").select(
        "doc_id", "base", spans.alias("spans")
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])),
    )


def private_table(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every document."""
    found = find_private(docs)

    def count(kind: int) -> Column:
        some = F.filter("base", lambda s: s["kind"] == kind)
        return F.size(some).cast("bigint").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id",
        *[count(k) for k in range(len(KINDS))],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
