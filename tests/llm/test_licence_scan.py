"""Licence scans against a plain search for the base phrases."""

from __future__ import annotations

import random
import re

from palaver.llm.licence_scan import BASE, NOTICES, licence_table

DOCS = "doc_id bigint, text string, labels string, score string"
FILLER = "mit der license under the apache version 2 cc by nc the mit und 0 3 gnu public".split()


def expected(text: str | None) -> tuple:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    places, labels = [], set()
    for template in BASE:
        phrase = template.text.split()
        for at in range(len(words)):
            if words[at : at + len(phrase)] == phrase:
                places.append(at)
                labels.add(template.label)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(labels))


def test_base_phrases_match_a_plain_search(spark):
    rng = random.Random(2)
    texts = [None, "", "...", "Under the MIT license", "CC BY-NC 4.0", "É cc-by\x00nc under é"]
    texts += [" ".join(rng.choices(FILLER, k=rng.randint(1, 300))).upper() for _ in range(60)]
    texts += ["apache license version 2 " * 9_000, texts[-1], texts[-1]]
    rows = [(i % 50, t, "x", None) for i, t in enumerate(texts)] + [(None, "cc by nc", None, None)]
    found = licence_table(spark.createDataFrame(rows, DOCS)).collect()
    own = [
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found
    ]
    brute = [(r[0], *expected(r[1])) for r in rows]
    assert sorted(own, key=repr) == sorted(brute, key=repr)
    for row in found:
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


def test_notices_are_recognised(spark):
    rows = [(i, f"intro words {t.text} and more", None, None) for i, t in enumerate(NOTICES)]
    changed = NOTICES[0].text.replace("obtaining", "getting")
    rows.append((100, changed, None, None))
    rows.append((101, NOTICES[0].text.replace("without restriction", "freely"), None, None))
    found = {r.doc_id: r for r in licence_table(spark.createDataFrame(rows, DOCS)).collect()}
    for i, template in enumerate(NOTICES):
        assert template.label in found[i].labels.split(",")
        assert found[i].score == 1.0
    assert found[100].labels == "mit" and 0.8 < found[100].score < 1
    assert found[101].labels == ""


def test_empty_table(spark):
    assert licence_table(spark.createDataFrame([], DOCS)).count() == 0
