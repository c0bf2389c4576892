"""URL filtering with redirect equivalence: decisions reach every alias of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import ascii_lower, attach
from emberlake.llm.components import components
from emberlake.session import materialize

#: (verdict, rule); a rule is a host, for it and its subdomains, and the start of a path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Query parameters that name where a visitor came from, not what is shown.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does. For lists of up to a few thousand rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        out = F.when(fits & path.startswith(slash + start), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What a server is asked for: lower-case scheme and host, no fragment."""
    asked = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.regexp_extract(asked, "(?s)^(.*?://[^/?]*)", 1)
    return F.when(F.length(head) > 0, F.concat(ascii_lower(head), F.substring(asked, F.length(head) + 1, F.length(asked)))).otherwise(asked)


def plain_of(node: Column) -> Column:
    """Where servers commonly redirect a url: https, without tracking parameters and closing slash."""
    asked = F.regexp_replace(node, "^http://", "https://")
    parts = F.filter(F.split(F.regexp_extract(asked, r"(?s)\?(.*)$", 1), "&"), lambda p: ~p.rlike(TRACKING) & (p != ""))
    stem = F.regexp_replace(F.regexp_replace(asked, r"(?s)\?.*$", ""), r"(?<=[^:/])/$", "")
    return F.when(F.size(parts) > 0, F.concat_ws("?", stem, F.array_join(parts, "&"))).otherwise(stem)


def resolved(base: Column, link: Column) -> Column:
    """The absolute form of ``link`` on the page ``base``; null for an empty link."""
    scheme = F.regexp_extract(base, "(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(F.coalesce(F.length(link), F.lit(0)) == 0, F.lit(None))
        .when(link.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame, implied: bool = True) -> DataFrame:
    """Edges ``a, b`` between urls that show one page: canonical links, refresh redirects and, if ``implied``, the usual server redirects."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = [F.regexp_extract(F.regexp_extract(html, tag, 0), at, 1) for tag, at in ((CANONICAL, HREF), (REFRESH, TARGET))]
    known = pages.where(F.col("url").contains("://"))
    found = known.select("url", F.explode(F.array(*links)).alias("link")).where("link <> ''")
    found = found.select("url", resolved(F.col("url"), F.regexp_replace("link", "&amp;", "&")).alias("link"))
    edges = found.select(node_of(F.col("url")).alias("a"), node_of(F.col("link")).alias("b")).where("b is not null and a <> b").distinct()
    if not implied:
        return edges
    nodes = known.select(node_of(F.col("url")).alias("a")).union(edges.select("b")).distinct()
    return edges.union(nodes.select("a", plain_of(F.col("a")).alias("b")).where("a <> b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, implied: bool = True) -> DataFrame:
    """Every row of ``pages`` (``page_id``, ``url``, ``html``) with ``host, path, rule, verdict, alias_of``.

    A page's own rule decides. Without one, the rules of its aliases do: an explicit allow
    on any alias comes before blocks, a block on any alias blocks; else the page is
    allowed. Aliases are the connected components over ``alias_edges``; urls that are only
    linked to are judged as well. ``alias_of`` names the component, the least of its urls,
    and is null for a page without aliases. A null url or one without ``://`` has an empty
    host and path, no rule and no aliases, and is allowed; null html has no links; repeated
    rows are each judged; other columns are not looked at; an empty table gives no rows.
    """
    edges = materialize(alias_edges(pages, implied), "url-edges")
    groups = materialize(components(edges), "url-groups")
    judged = groups.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    judged = judged.select("component", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("own"))
    # min over 'allow' and 'block' is allow where any alias is allowed
    decided = judged.groupBy("component").agg(F.min("own").alias("_group")).where("_group is not null")
    named = attach(groups, decided, ["component"], ["node"], "left").select(F.col("node").alias("_node"), F.col("component").alias("alias_of"), "_group")

    url = F.col("url")
    lone = F.concat(F.lit("\x00"), F.coalesce(F.xxhash64("page_id").cast("string"), F.lit("")))  # no url: spread, joins nothing
    node = F.when(url.contains("://"), node_of(url)).otherwise(lone)
    found = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node.alias("_node"))
    found = found.withColumn("_own", rule_of(F.col("host"), F.col("path"), rules))
    joined = attach(found, named, ["_node"], ["page_id"], "left")
    verdict = F.coalesce(F.col("_own.verdict"), F.col("_group"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"), "alias_of")
