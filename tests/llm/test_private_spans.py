"""Personal data: base spans against the plain expressions, contexts against a plain loop."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from palaver.llm import private_spans
from palaver.llm.common import stored
from palaver.llm.private_spans import (
    ACCEPT,
    KINDS,
    LEAST_INSTANCES,
    LEAST_SHARE,
    ROUNDS,
    base_spans,
    bootstrap,
    candidates,
    find_private,
    mark_private,
    patterns_of,
    private_table,
)

DOCS = "doc_id bigint, text string, spans string, base string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def slow(text: str) -> list[tuple[int, int, int]]:
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [
        (1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))
    ]
    for kind, expression, low, high in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
        for m in expression.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_expressions():
    rng = random.Random(3)
    parts = [*"0123456789..@@+-- ()a_%é\n", "4111111111111111", "a@b.c", "1.2.3.4", "255", "+1 "]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 24)))
        assert base_spans(text) == slow(text), text


def test_long_texts_take_linear_work():
    for text in ("a" * 300_000, "@" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000,
                 "a@b" * 100_000, "1 " * 150_000, "+1(" * 100_000, "a@b.c " * 50_000):
        spans = base_spans(text)
        assert len(spans) == (50_000 if " " in text and "@" in text else len(spans))
        candidates(text, spans)


def test_candidates_and_patterns():
    text = 'Call (051) 555-0588, or mail "x7" at a@b.com; id=AB-12!'
    spans = base_spans(text)
    assert [text[a:b] for _, a, b in spans] == ["a@b.com"]
    found = [text[a:b] for a, b in candidates(text, spans)]
    assert found == ["051) 555-0588", "x7", "id=AB-12"]
    at = text.index("051")
    assert patterns_of(text, at, at + 13) == ["call ( _", "( _", "( _ ,"]
    assert patterns_of("7", 0, 1) == []


def corpus() -> list[tuple]:
    """Seeds in telling contexts, unseen identifiers in the same, and numbers elsewhere."""
    rng = random.Random(11)

    def phone() -> str:
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    texts = [f"for help ring desk {phone()} today item {i}" for i in range(40)]
    texts += [f"contact box clerk{i}@mail.example.com now" for i in range(12)]
    texts += ["for help ring desk 555-0123 today", "Contact box clerk(at)home2 now"]
    # Found by their first place; their second one then teaches a pattern for others.
    bridge = [f"555-77{i:02}" for i in range(9)]
    texts += [f"for help ring desk {b} today" for b in bridge]
    texts += [f"the night porter has {b} only" for b in [*bridge, "555-9911"]]
    texts += [f"it costs {rng.randint(2, 900)} euros in {rng.randint(1000, 2000)}" for _ in range(30)]
    texts += [f"it costs {phone()} euros", "ring desk 7 today", None, "", " "]
    texts += ["contact box joe@elsewhere now", "the joe@elsewhere is far"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    return [*rows, rows[52], (None, "for help ring desk 555-0199 today", None, None)]


def slow_bootstrap(rows: list[tuple]) -> tuple[dict, dict]:
    """The rounds over plain dictionaries."""
    edges, seeds = set(), {}
    for _, text, _, _ in rows:
        text = text or ""
        spans = slow(text)
        for kind, a, b in spans + [(None, *c) for c in candidates(text, spans)]:
            if kind is not None:
                seeds[text[a:b].lower()] = kind
            edges |= {(p, text[a:b].lower()) for p in patterns_of(text, a, b)}
    held, size = defaultdict(set), defaultdict(int)
    for pattern, instance in edges:
        held[pattern].add(instance)
        size[pattern] += 1
    accepted = {i: (k, 1.0) for i, k in seeds.items()}
    patterns: dict = {}
    for _ in range(ROUNDS):
        patterns = {}
        for pattern, instances in held.items():
            for kind in range(4):
                some = [accepted[i][1] for i in instances if accepted.get(i, (9,))[0] == kind]
                share = round(math.fsum(some), 6) / (size[pattern] + 1)
                if len(some) >= LEAST_INSTANCES and share >= LEAST_SHARE:
                    patterns[pattern] = (kind, share)
        wrong = defaultdict(lambda: 1.0)
        for pattern, (kind, share) in patterns.items():
            for instance in held[pattern]:
                wrong[instance, kind] *= 1 - share
        accepted = {i: (k, 1.0) for i, k in seeds.items()}
        for (instance, kind), rest in wrong.items():
            digits = len(re.sub("[^0-9]", "", instance))
            fits = ["@" in instance, digits >= 4 and re.search("[.:]", instance),
                    12 <= digits <= 19, 5 <= digits <= 15][kind]
            if instance not in seeds and round(1 - rest, 6) >= ACCEPT and fits:
                if 1 - rest > accepted.get(instance, (0, 0))[1]:
                    accepted[instance] = (kind, round(1 - rest, 6))
    return patterns, accepted


def test_rounds_match_a_plain_loop(spark):
    rows = corpus()
    marked = stored(mark_private(spark.createDataFrame(rows, DOCS).repartition(4)))
    patterns, accepted = bootstrap(marked)
    plain_patterns, plain_accepted = slow_bootstrap(rows)
    found = {r["pattern"]: (r["kind"], r["share"]) for r in patterns.collect()}
    assert found.keys() == plain_patterns.keys() and len(found) > 5
    for pattern, (kind, share) in plain_patterns.items():
        assert found[pattern] == (kind, pytest.approx(share))
    got = {r["instance"]: (r["kind"], r["confidence"]) for r in accepted.collect()}
    assert got == {i: (k, pytest.approx(c)) for i, (k, c) in plain_accepted.items()}
    assert sum(not r["seed"] for r in accepted.collect()) > 10


def test_unseen_identifiers_are_found(spark):
    rows = corpus()
    found = private_table(spark.createDataFrame(rows, DOCS).repartition(4))
    assert found.columns == (
        "doc_id n_email n_ip n_card n_phone base_sha256 spans".split()
    )
    extra = {}
    by_id = defaultdict(list)
    for got in found.collect():
        by_id[got["doc_id"]].append(got)
    assert sum(map(len, by_id.values())) == len(rows)
    for doc_id, text, _, _ in rows:
        base = slow(text or "")
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        for got in by_id[doc_id]:
            assert got["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
            assert [got[f"n_{k}"] for k in KINDS] == [
                sum(s[0] == i for s in base) for i in range(4)
            ]
            spans = got["spans"].split(",") if got["spans"] else []
            assert set(written.split(",")) - {""} <= set(spans)
            for kind, a, b in (s.split(":") for s in set(spans) - set(written.split(","))):
                extra[doc_id, text[int(a) : int(b)]] = kind
    text_of = {i: t for i, t, _, _ in rows}
    assert {(text_of[i].split()[0], x): kind for (i, x), kind in extra.items()} == {
        ("for", "555-0123"): "phone",
        ("for", "555-0199"): "phone",
        ("contact", "joe@elsewhere"): "email",
        ("the", "555-9911"): "phone",
        **{(w, f"555-77{i:02}"): "phone" for w in ("for", "the") for i in range(9)},
    }


def test_salted_joins_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), DOCS)
    usual = sorted(map(repr, private_table(docs).collect()))
    plain = private_spans.join_unique

    def salted(*args, **kwargs):
        return plain(*args, **kwargs, rows_per_task=3)

    monkeypatch.setattr(private_spans, "join_unique", salted)
    assert sorted(map(repr, private_table(docs).collect())) == usual


def test_no_rows_and_no_seeds(spark):
    assert private_table(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, "room 12 of 14", None, None), (2, "é" * 30_000, None, None)], DOCS)
    assert [(r["base"], r["spans"]) for r in find_private(docs).collect()] == [([], [])] * 2
