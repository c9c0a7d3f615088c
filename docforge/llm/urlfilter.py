"""URL filters over classes of redirect-equivalent URLs.

Rules of (action, host, path) judge a URL by its longest fitting rule.  Where
none fits, the decision comes from the URL's aliases: canonical links and
redirects (``<link rel=canonical>``, ``<meta http-equiv=refresh>`` or rows of
an explicit redirect table) are edges, connected components of the edges are
classes of one resource, and a class with a blocked URL blocks its members.  A
URL with an allow rule of its own stays allowed; without any block it is
allowed.

Native: parsing, edges, components and joins are DataFrame functions only.  A
rule list is configuration and becomes one expression; URLs are never grouped
by host, so a hot host is no hot key.  Equal edges are collapsed before the
component rounds, in which hubs are pre-aggregated.

Edge cases: a null URL, or one without ``://``, has empty host and path and
fits no rule; it has no edges and is allowed.  Relative link targets are
resolved against the page; fragments and the scheme do not distinguish URLs;
an unresolvable target gives no edge.  Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import component_labels, lower_ascii, materialised

#: (action, host, path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Name of a URL without scheme and fragment; null where it cannot be parsed."""
    tail = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def _fitting(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    return _fitting(host, path, rules, lambda r: r[1] + r[2])


def action_of(host: Column, path: Column, rules=RULES) -> Column:
    return _fitting(host, path, rules, lambda r: r[0])


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.trim(F.regexp_replace(found, "^[\"']|[\"']$", ""))


def link_targets(html: Column) -> Column:
    """Array of canonical and refresh targets as written in a page."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0)
    canonical = F.transform(F.filter(links, lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")), lambda t: _attribute(t, "href"))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0)
    refresh = F.transform(
        F.filter(metas, lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1),
    )
    targets = F.transform(F.concat(canonical, refresh), lambda t: F.trim(F.replace(t, F.lit("&amp;"), F.lit("&"))))
    return F.coalesce(F.filter(targets, lambda t: t != ""), F.array().cast("array<string>"))


def resolved(url: Column, target: Column) -> Column:
    """A link target against its page's URL."""
    host, path = host_of(url), path_of(url)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(host == "", F.lit(None).cast("string"))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host, target))
        .when(target.startswith("?") | target.startswith("#"), F.concat(F.lit("http://"), host, path, target))
        .otherwise(F.concat(F.lit("http://"), host, folder, target))
    )


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``a, b`` URL names that are one resource; redirects: rows of ``source, target``."""
    found = pages.where(F.col(html_col).rlike(r"(?is)<(link|meta)\b[^>]*(canonical|refresh)")).select(F.col(url_col).alias("source"), F.explode(link_targets(F.col(html_col))).alias("target"))
    if redirects is not None:
        found = found.unionByName(redirects.select("source", "target"))
    # in steps, each of whose columns is used several times, so that Catalyst keeps them apart
    full = found.select("source", resolved(F.col("source"), F.col("target")).alias("full"))
    out = full.select(node_of(F.col("source")).alias("a"), node_of(F.col("full")).alias("b"))
    return out.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``id, host, path, rule, verdict`` and ``via`` (rule, alias or default) for every row."""
    links = materialised(edges(pages, url_col, html_col, redirects))
    label = component_labels(links)
    url = F.concat(F.lit("http://"), F.col("node"))
    blocked = label.where(action_of(host_of(url), path_of(url), rules) == "block").select("root").distinct()
    aliases = label.join(blocked, "root").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked"))
    u = F.col(url_col)
    rows = pages.select(F.col(id_col), u.alias("_url"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "_action": action_of(F.col("host"), F.col("path"), rules), "_node": node_of(F.col("_url"))})
    rows = rows.join(aliases, "_node", "left")
    verdict = F.coalesce(F.col("_action"), F.when(F.col("_blocked"), "block"), F.lit("allow"))
    via = F.when(F.col("_action").isNotNull(), "rule").when(F.col("_blocked"), "alias").otherwise("default")
    return rows.select(id_col, "host", "path", "rule", verdict.alias("verdict"), via.alias("via"))
