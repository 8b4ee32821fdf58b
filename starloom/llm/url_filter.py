"""URL filters with redirect equivalence (native).

A rule (verdict, host, path) fits a url whose host is the rule's or one of its
subdomains and whose path starts with the rule's; the longest rule wins (of
equally long ones that with the longer host).  A url's own rule always decides.

A url without a rule takes the decision of its aliases.  Edges between urls come
from the pages: ``<link rel=canonical href>`` and ``<meta http-equiv=refresh>``
outside comments and scripts, taken as two-way.  Connected components of all edges
group the aliases; a component that holds a blocked url blocks each of its urls
that no rule allows (an explicit allow takes precedence over a block that
came along an edge, for the url it names).  Targets need not be pages: a page that
redirects to a blocked url outside the table is blocked.  Everything else is
allowed.

Aliases are compared after the fragment is dropped, scheme and host are
lower-cased, an empty path is made ``/`` and dot segments are resolved.

Only edges, and of pages their url columns, are shuffled; the html stays where it
is read.  Everything is DataFrame expressions; the rules are a parameter list
and become one expression.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; its page can still be blocked through its own links.  Null and empty
html have no edges.  Repeated rows are judged once each; an empty table gives an
empty result; other columns are kept as they are unless named like a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialise

Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.coalesce(F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _by_length(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The fitting rule as a struct (rule, verdict), or null."""
    out = F.lit(None)
    for verdict, rule_host, rule_path in reversed(_by_length(rules)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; empty where it is missing."""
    pattern = rf"(?i)[\s\"'/]{name}{_VALUE}"
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.trim(F.regexp_replace(value, "(?i)&(?:amp|#0*38|#x0*26);", "&"), F.lit(" \t\r\n\f"))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def link_targets(html: Column) -> Column:
    """Array of the canonical and redirect targets, as written in the page."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?is)<script\b.*?</script\s*>", " ")
    canonical = F.filter(_tags(bare, "link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(_tags(bare, "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    content = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?i)^[\d.\s]*[;,]?\s*url\s*=\s*[\"']?([^\"']*)", 1))
    return F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(content, F.trim))


def _without_dots(path: Column) -> Column:
    """``/a/./b/../c`` as ``/a/c``."""
    steps = F.aggregate(
        F.split(path, "/"), F.slice(F.array(F.lit("")), 1, 0),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
        .when(s == ".", kept).otherwise(F.concat(kept, F.array(s))))
    joined = F.array_join(steps, "/")
    ends_open = path.rlike(r"/\.\.?$")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.when(ends_open, F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(path)


def normal_url(url: Column) -> Column:
    """The form in which aliases are compared; null for a url without ``://``."""
    host, path = host_and_path(url)
    scheme = F.lower(F.regexp_extract(url, "^[^:]*", 0))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    path = F.when(path == "", "/").otherwise(_without_dots(path))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, path, query))


def resolved(target: Column, base: Column) -> Column:
    """A link as an absolute url, read on the page ``base``; null where it
    names nothing else than the page itself or has no base to stand on."""
    host, path = host_and_path(base)
    scheme = F.regexp_extract(base, "^[^:]*", 0)
    site = F.when(base.contains("://"), F.concat(scheme, F.lit("://"), host))
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/"))
    return (F.when(target.isNull() | (target == "") | target.startswith("#"), F.lit(None))
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?"), F.concat(site, path, target))
            .otherwise(F.concat(site, folder, target)))


def _node(url: Column, page_id: Column) -> Column:
    """Key of a url's node; a page without an absolute url is its own node."""
    return F.md5(F.coalesce(normal_url(url), F.concat(F.lit("page "), page_id.cast("string")), F.lit("page")))


def alias_edges(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b, a_verdict, b_verdict) of every link: node keys and the verdicts of
    their own rules."""
    def verdict(prefix):
        return longest_rule(F.col(f"{prefix}_host"), F.col(f"{prefix}_path"), rules)["verdict"].alias(f"{prefix}_verdict")

    def parts(column, prefix):
        host, path = host_and_path(F.col(column))
        return [host.alias(f"{prefix}_host"), path.alias(f"{prefix}_path")]

    # written step by step: the planner would otherwise nest these long expressions into each other
    found = materialise(pages.where(F.col(html_col).rlike("(?i)canonical|refresh")).select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.explode(link_targets(F.col(html_col))).alias("target")), "url-links")
    links = materialise(found.select("id", "url", resolved(F.col("target"), F.col("url")).alias("target")), "url-targets")
    keyed = materialise(links.where("target IS NOT NULL").select(
        _node(F.col("url"), F.col("id")).alias("a"), _node(F.col("target"), F.lit(None)).alias("b"),
        *parts("url", "a"), *parts("target", "b")), "url-keys")
    return keyed.where("a <> b").select("a", "b", verdict("a"), verdict("b")).distinct()


def blocked_aliases(edges: DataFrame) -> DataFrame:
    """(node) of every component that holds a blocked url."""
    labels = components(edges.select("a", "b"))
    seeds = reduce(DataFrame.unionAll, [edges.where(F.col(f"{s}_verdict") == "block").select(F.col(s).alias("node")) for s in "ab"]).distinct()
    blocked = labels.join(seeds, "node", "left_semi").select("component").distinct()
    return labels.join(blocked, "component", "left_semi").select("node")


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with host, path, rule and verdict.  ``pages``
    should be a stored table: its html is read for the edges, its other columns for
    the result."""
    edges = materialise(alias_edges(pages, rules, id_col, url_col, html_col), "url-edges")
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = host_and_path(url)
    results = ["host", "path", "rule", "verdict"]
    kept = [F.col(c) for c in pages.columns if c not in (html_col, *results)]
    own = pages.select(*kept, host.alias("host"), path.alias("path"), _node(F.col(url_col), F.col(id_col)).alias("__u_node"))
    own = own.withColumn("__u_rule", longest_rule(F.col("host"), F.col("path"), rules))
    aliased = F.lit(False)
    if not edges.isEmpty():
        marks = blocked_aliases(edges).select(F.col("node").alias("__u_node"), F.lit(True).alias("__u_blocked"))
        own = own.join(marks, "__u_node", "left")
        aliased = F.coalesce(F.col("__u_blocked"), F.lit(False))
    return own.select(*kept, "host", "path", F.col("__u_rule.rule").alias("rule"),
                      F.coalesce(F.col("__u_rule.verdict"), F.when(aliased, "block").otherwise("allow")).alias("verdict"))
