"""URL rules whose block decisions reach the aliases of a page.

A page names its aliases by a canonical link or a redirect.  Pages and link targets that
hang together are one resource: connected components over those edges.  A page's own rule
decides it.  A page without one is blocked if any member of its component is blocked,
unless a member is explicitly allowed; allowing takes precedence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import ascii_lower, checkpointed, fold
from palaver.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?((?:&(?:[a-z]+|#\w+);|[^\"'\s>;])+)"


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty for null and without ``://``."""
    return ascii_lower(F.regexp_extract(fold(url), PARTS, 1))


def path_of(url: Column) -> Column:
    """Path of a URL, up to query or fragment; empty for null and without ``://``."""
    return F.regexp_extract(fold(url), PARTS, 2)


def node_of(url: Column) -> Column:
    """What URLs of one resource share: scheme, fragment and a last slash do not count.

    Null for what is no absolute URL, which then has no aliases.
    """
    query = F.regexp_extract(fold(url), r"(?s)^[^#?]*(\?[^#]*)", 1)
    node = F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), query)
    return F.when(host_of(url) != "", node)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Text of the longest rule that fits; null if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r.text), r.text))
    tests = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path),
            F.lit(r.text),
        )
        for r in longest_first
    ]
    return F.coalesce(*tests, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    """Verdict of a rule given by its text; null for null."""
    blocking = [r.text for r in rules if r.verdict == "block"]
    return F.when(rule.isin(blocking), "block").when(rule.isNotNull(), "allow")


def decoded(text: Column) -> Column:
    """Text with the character references that URLs in attributes have, once."""
    for reference, sign in (
        (r"(?i)&(?:quot|#34|#x22);", "\""),
        (r"(?i)&(?:apos|#39|#x27);", "'"),
        (r"(?i)&(?:#47|#x2f|sol);", "/"),
        (r"(?i)&(?:amp|#38|#x26);", "&"),
    ):
        text = F.regexp_replace(text, reference, sign)
    return text


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` parts; ``..`` at the root stays there."""

    def walk(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(
            F.concat(kept, F.array(part))
        )

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    start = F.array().cast("array<string>")
    ended = F.when(path.rlike(r"(?:^|/)\.\.?$"), "/").otherwise("")
    walked = F.array_join(F.aggregate(parts, start, walk), "/")
    return F.concat(F.lit("/"), walked, F.when(walked == "", "").otherwise(ended))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an absolute URL, seen from the page at ``url``.

    Null for an empty target, a mere fragment, and schemes without a host such as mailto.
    A target that is neither absolute nor begins with a slash or a question mark is relative
    to the directory of the page's path.
    """
    base = F.concat(
        F.regexp_extract(fold(url), "(?s)^(.*?:)//", 1), F.lit("//"), host_of(url)
    )
    own = path_of(url)
    folder = F.regexp_extract(own, "(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.regexp_extract(target, "(?s)^([^?#]*)", 1)
    rest = F.substr(target, F.length(path) + 1)
    scheme = target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return (
        F.when(scheme, F.when(target.contains("://"), target))
        .when(target.startswith("//"), F.concat(F.regexp_extract(fold(url), "(?s)^(.*?:)//", 1), target))
        .when((target == "") | target.startswith("#"), None)
        .when(target.startswith("?"), F.concat(base, own, target))
        .when(target.startswith("/"), F.concat(base, without_dots(path), rest))
        .otherwise(F.concat(base, without_dots(F.concat(folder, path)), rest))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """``(node, url)``: the pages' nodes and the URLs they name as canonical or go on to.

    Targets may be absolute or relative, and written with character references.
    """
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    tagged = pages.where(F.lower(html).rlike("canonical|refresh")).select(
        node_of(url).alias("node"), url.alias("url"), F.explode(tags).alias("tag")
    )
    target = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(
        F.col("tag").rlike(REFRESH), F.regexp_extract("tag", REFRESH_URL, 1)
    )
    found = tagged.where("node is not null").withColumn("target", decoded(target))
    whole = resolved(F.col("target"), F.col("url"))
    return found.select("node", whole.alias("url")).where(F.col("url").isNotNull())


def blocked_nodes(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``node``: nodes that a block decision reaches and no explicit allow protects."""
    links = checkpointed(alias_links(pages).distinct())
    named = links.select("url", "node", node_of(F.col("url")).alias("target"))
    components = connected_components(named, "node", "target")
    urls = pages.select("url").unionByName(links.select("url"))
    rule = matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    decided = urls.select(
        node_of(F.col("url")).alias("node"), verdict_of(rule, rules).alias("verdict")
    ).where("node is not null and verdict is not null")
    component = F.coalesce("component", "node")
    grouped = decided.distinct().join(components, "node", "left").groupBy(
        component.alias("component")
    )
    blocked = grouped.agg(F.max("verdict").alias("most"), F.min("verdict").alias("least")).where(
        "least = 'block'"
    )
    members = components.join(blocked, "component").select("node")
    return checkpointed(
        members.unionByName(blocked.select(F.col("component").alias("node"))).distinct()
    )


def filter_urls(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict, by_alias)`` of every page.

    ``rule`` is the page's own; ``by_alias`` says that the verdict came from an alias.
    Pages that nothing decides get ``otherwise``.  A null or relative URL has no host, no
    path, no rule and no alias.  Repeated rows are judged alike.  A URL that very many
    pages share is split by the join's adaptive handling; its other side has it once.
    """
    blocked = blocked_nodes(pages, rules).select(F.col("node"), F.lit(True).alias("_blocked"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        matching_rule(host, path, rules).alias("rule"),
        # A page that no alias can decide joins nothing; its own key spreads it.
        F.coalesce(node_of(F.col("url")), F.concat(F.lit("\n"), fold(F.col("page_id"))))
        .alias("node"),
    )
    joined = judged.join(blocked, "node", "left")
    own = verdict_of(F.col("rule"), rules)
    by_alias = F.col("rule").isNull() & F.col("_blocked").isNotNull()
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(own, F.when(by_alias, "block"), F.lit(otherwise)).alias("verdict"),
        by_alias.alias("by_alias"),
    )
