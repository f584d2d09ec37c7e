"""URL rules, aliases and their precedence."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import functions as F

from palaver.llm.queries import URL_RULES
from palaver.llm.url_filter import Rule, filter_urls, resolved

PAGES = "page_id bigint, url string, html string, host string, verdict string"
RULES = (*URL_RULES, Rule("block", "bad.net", "/"), Rule("allow", "bad.net", "/fine/"))


def canonical(url: str) -> str:
    return f'<html><LINK href="{url}" rel="canonical"><body>refresh</body>'


def refresh(url: str) -> str:
    return f"<meta http-equiv='refresh' content='0; URL={url}'>"


def judged(spark, rows, rules=RULES):
    pages = spark.createDataFrame([(*r, "h", None) for r in rows], PAGES)
    return {r.page_id: r for r in filter_urls(pages, rules).collect()}


def test_rules_and_parts(spark):
    found = judged(spark, [
        (1, "https://www.Example.ORG/es/1?x#y", None),
        (2, "http://example.org/en/19#top", ""),
        (3, "http://example.org/en/29", None),
        (4, "http://notexample.org/es/1", None),
        (5, "x://a.com/de/?q", None),
        (6, "x://a.com/fr/b://c.com/de/", None),
        (7, "com/de/", None),
        (8, None, None),
        (9, "http://a.net?x=/de/", None),
        (10, "http://COM/de/", None),
        (11, "http:///de/", None),
        (12, "", None),
        (13, "http://a.dé.com/de/é", None),
    ])
    assert [tuple(found[i])[1:5] for i in range(1, 14)] == [
        ("www.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/19", "example.org/en/1", "block"),
        ("example.org", "/en/29", "org/", "allow"),
        ("notexample.org", "/es/1", "org/", "allow"),
        ("a.com", "/de/", "com/de/", "block"),
        ("a.com", "/fr/b://c.com/de/", "com/fr/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.net", "", None, "allow"),
        ("com", "/de/", "com/de/", "block"),
        ("", "/de/", None, "allow"),
        ("", "", None, "allow"),
        ("a.dé.com", "/de/é", "com/de/", "block"),
    ]


def test_decisions_reach_aliases(spark):
    found = judged(spark, [
        # 1 -> 2 -> 3 -> a blocked page that is not in the table
        (1, "http://one.net/a", canonical("//two.net/b/")),
        (2, "https://two.net/b#part", refresh("/c?d=1")),
        (3, "http://two.net/c?d=1", canonical("http://bad.net/x")),
        # another query is another page
        (4, "http://two.net/c?d=2", ""),
        # blocked and allowed members: allowing takes precedence for those without a rule
        (5, "http://three.net/", canonical("http://bad.net/y")),
        (6, "http://bad.net/y", canonical("http://bad.net/fine/y")),
        # an own rule stands
        (7, "http://any.org/", canonical("http://bad.net/z")),
        (8, "http://four.net/", '<link rel="stylesheet" href="http://bad.net/x">'),
        (9, None, canonical("http://bad.net/x")),
        (1, "http://one.net/a", canonical("//two.net/b/")),
    ])
    verdicts = {i: r.verdict for i, r in found.items()}
    assert verdicts == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow",
        8: "allow", 9: "allow",
    }
    assert {i for i, r in found.items() if r.by_alias} == {1, 2, 3}


TARGETS = (
    "page.html", "./page.html", "../x", "../../x", "../../../x", "a/./b/../c", "?id=3", "/a/../b",
    "/", ".", "..", "../", "x/.", "x/..", "//other.net/x", "http://other.net/a", "/go?u=http://b.net/",
    "go?u=http://b.net/", "x#part", "a/b/", "%2e", "/a/b/../..", "x?a=../b",
)


def test_relative_targets_are_resolved_as_the_standard_says(spark):
    bases = ["http://h.net/dir/sub/page", "https://h.net/", "http://h.net", "http://h.net/d/?q=1#f"]
    rows = [(b, t) for b in bases for t in TARGETS]
    found = spark.createDataFrame(rows, "url string, target string")
    found = found.withColumn("whole", resolved(F.col("target"), F.col("url"))).collect()
    for r in found:
        # The base without its path has the root as its directory.
        base = r.url if r.url.count("/") > 2 else r.url + "/"
        expected = urljoin(base, r.target)
        whole = r.whole.replace("net?", "net/?")  # the same node
        assert whole.split("#")[0].rstrip("/") == expected.split("#")[0].rstrip("/"), r
    odd = [("http://h.net/x", t) for t in ("", "#top", "mailto:a@b.net", "javascript:void(0)")]
    frame = spark.createDataFrame(odd, "url string, target string")
    assert {r[0] for r in frame.select(resolved(F.col("target"), F.col("url"))).collect()} == {None}


def test_decisions_reach_relative_aliases(spark):
    found = judged(spark, [
        (1, "http://one.net/d/a", canonical("b.html")),
        (2, "http://one.net/d/b.html", canonical("../e/c?x=1&amp;y=2")),
        (3, "http://one.net/e/c?x=1&y=2", refresh("?x=2&#38;y=3")),
        (4, "http://one.net/e/c?x=2&y=3", canonical("http://bad.net/x")),
        (5, "http://one.net/e/c?x=2", canonical("#top")),
        (6, "http://two.net/go", refresh("/out?u=http://bad.net/x")),
    ])
    assert {i: r.verdict for i, r in found.items()} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow",
    }


def test_long_pages_and_urls(spark):
    filler = "<p>" + "text " * 60_000 + "</p>"
    far = "http://long.net/" + "a/" * 5_000
    rows = [
        (1, "http://one.net/", filler + canonical("http://bad.net/x") + filler),
        (2, far, canonical("../" * 5_000 + "up")),
        (3, "http://long.net/up", canonical("http://bad.net/y")),
    ]
    assert {i: r.verdict for i, r in judged(spark, rows).items()} == {1: "block", 2: "block", 3: "block"}


def test_long_chain_and_shared_url(spark):
    rows = [(i, f"http://h{i}.net/", canonical(f"http://h{i + 1}.net/")) for i in range(40)]
    rows += [(100 + i, "http://h0.net", None) for i in range(200)]
    rows.append((40, "http://h40.net", canonical("http://bad.net/")))
    found = judged(spark, rows)
    assert {r.verdict for r in found.values()} == {"block"} and len(found) == 241


def test_empty_table(spark):
    assert judged(spark, []) == {}
