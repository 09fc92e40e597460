"""URL filter with redirect equivalence.

Pages are judged by host and path rules. Redirects (`http-equiv=refresh`) and
canonical links (`rel=canonical`) in the pages tie addresses together; a block
reaches every alias of a blocked address that no rule names itself, and an
explicit allow anywhere among the aliases keeps them. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the query's rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule; null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    options = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in ordered
    ]
    return F.coalesce(*options) if options else F.lit(None).cast("struct<rule:string,verdict:string>")


def address(url: Column) -> Column:
    """An address without scheme, fragment and trailing slash: what names the same page."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(url_host(url), F.regexp_replace(rest, "/+$", ""))


def resolved(link: Column, base: Column) -> Column:
    """`link` as an absolute address, seen from the page at `base`; empty if it names no page of a host.

    Takes //host/path, /path, ?query and relative paths; `.` and `..` steps are worked off
    in these. A fragment alone and schemes without `//` name none.
    """
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = url_path(base)
    stem = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1))
    tail = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    way = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    steps = F.split(F.when(way.startswith("/"), way).otherwise(F.concat(stem, way)), "/")
    # a last `.` or `..` names a folder
    steps = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda have, x: F.when(x == ".", have).when(x == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.concat(have, F.array(x))),
    )
    return (
        F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when((link == "") | link.startswith("#") | link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "")
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, F.lit("/"), F.array_join(kept, "/"), tail))
    )


# One match takes one sign or one whole attribute and gives nothing back, so that no tag is too long for it.
_TAG = r"(?is)<(?:link|meta)\b(?:\"[^\"]*+\"|'[^']*+'|[^<>\"']++)*+>"
_ATTRIBUTE = r"(?is)[\s/][^\s=>\"'/]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name, in double, single or no quotes; empty if it has none. What stands inside another's value is no attribute."""
    named = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 0), lambda a: F.lower(F.regexp_extract(a, r"(?s)^.([^\s=]++)", 1)) == name)
    value = F.regexp_extract(F.get(named, F.lit(0)), r"(?s)^[^=]*+=\s*+(.*)$", 1)
    quoted = value.startswith('"') | value.startswith("'")
    return F.coalesce(F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value), F.lit(""))


def link_targets(html: Column, base: Column) -> Column:
    """Targets of canonical links and refresh redirects in the page at `base`, made absolute.

    A tag ends at the first > outside quotes; a < outside quotes before it makes it none, and so does an unclosed quote. A
    tag may be of any length.
    A link counts if `canonical` is a word of its rel, a meta tag if its http-equiv is `refresh`; its address stands in content behind `url=`.
    """
    tags = F.regexp_extract_all(html, F.lit(_TAG), 0)
    tags = F.filter(tags, lambda t: t.rlike("(?i)canonical|refresh"))
    canonical = lambda t: t.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical")
    refresh = lambda t: t.rlike("(?i)^<meta") & (F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh")
    content = lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)^[\s0-9.]*[;,\s]\s*(?:url\s*=)\s*[\"']?\s*([^\s\"']+)", 1)
    target = F.transform(tags, lambda t: F.when(canonical(t), F.trim(attribute(t, "href"))).when(refresh(t), content(t)).otherwise(F.lit("")))
    target = F.transform(target, lambda t: resolved(F.regexp_replace(t, "(?i)&(?:amp|#38|#x26);", "&"), base))
    return F.filter(target, lambda t: t != "")


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every page.

    Takes `page_id`, `url` and `html`. The verdict is the rule's; else `block` if
    an alias is blocked and none is explicitly allowed; else `default`. A null
    url or one without `://` has an empty host and path, fits no rule and has no
    alias. Null html has no links; links without scheme or host are resolved from
    the page's url (a `base` tag is not regarded). Repeated rows are judged each. Other columns
    are left aside.
    """
    seen = pages.select("page_id", "url", "html").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    judged = seen.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", F.when(F.col("host") != "", address(F.col("url"))))
    links = (
        judged.where("node is not null and html is not null")
        .where(F.col("html").rlike("(?i)canonical|refresh"))
        .select("node", F.explode(link_targets(F.col("html"), F.col("url"))).alias("link"))
        .select("node", address(F.col("link")).alias("alias"))
    )
    parts = connected_components(links, "node", "alias")
    # each address of a component speaks once, as many pages as may share it
    voices = judged.where("fit is not null").join(parts, "node").groupBy("component").agg(
        F.max(F.col("fit.verdict") == "allow").alias("allowed"), F.max(F.col("fit.verdict") == "block").alias("blocked")
    )
    # a linked address that no page has may still be named by a rule
    ruled = parts.select("component", rule_of(F.regexp_extract("node", "^[^/?]*", 0), F.regexp_extract("node", "^[^/?]*([^?]*)", 1), rules)["verdict"].alias("v")).where("v is not null")
    voices = (
        voices.unionAll(ruled.groupBy("component").agg(F.max(F.col("v") == "allow"), F.max(F.col("v") == "block")))
        .groupBy("component")
        .agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    )
    classes = parts.join(voices, "component", "left")
    method = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise(default)
    return judged.drop("url", "html").join(classes, "node", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "component"
    )
