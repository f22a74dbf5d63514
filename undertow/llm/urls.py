"""URL filters: rules by host and path, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .components import labelled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<link\b[^>]*>"
_META = r"(?i)<meta\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?i)\burl\s*=\s*'?([^\"'\s>;]+)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What names a resource: the url without its fragment, with A-Z of scheme and host lower-cased."""
    plain = F.split_part(url, F.lit("#"), F.lit(1))
    site = F.regexp_extract(plain, r"^(?s:.*?)://[^/?]*", 0)
    return F.concat(F.translate(site, UPPER, LOWER), F.substring(plain, F.length(site) + 1, F.length(plain)))


def links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of canonical links and refresh redirects found in the html of ``pages``.

    A target may be absolute, begin with ``//`` or ``/``, or be relative to the folder of the page.
    """
    canonical = F.filter(
        F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)),
        lambda t: F.regexp_like(t, F.lit(r"(?i)\brel\s*=\s*[\"']?canonical\b")),
    )
    refresh = F.filter(
        F.regexp_extract_all("html", F.lit(_META), F.lit(0)),
        lambda t: F.regexp_like(t, F.lit(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")),
    )
    targets = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, _TARGET, 1)),
    )
    found = pages.where("html is not null and instr(url, '://') > 0")
    found = found.select("url", F.explode(targets).alias("t")).where("t <> ''")
    scheme, t = F.substring_index("url", "://", 1), F.col("t")
    site = F.concat(scheme, F.lit("://"), host(F.col("url")))
    folder = F.regexp_replace(path(F.col("url")), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    to = (
        F.when(F.instr(t, "://") > 0, t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .otherwise(F.concat(site, folder, t))
    )
    return found.select(F.col("url").alias("from_url"), to.alias("to_url"))


def ruled(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path and of the longest fitting rule its ``rule`` text and ``verdict``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains where the path starts with the rule's. Every address asks the rule table for each
    of its host's suffixes, so the rules may be many; of rules of equal length the longer host
    wins, then allow. Addresses are made distinct first; the adaptive join splits a hot suffix.
    """
    both = urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    asked = both.select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    asked = asked.where("_host <> ''").withColumn("_suffix", F.explode(suffixes))
    known = rules.select(
        F.col("host").alias("_suffix"),
        F.col("path").alias("_prefix"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
    )
    order = F.struct(
        F.length("rule"), F.length("_suffix"), (F.col("rule_verdict") == "allow").alias("allow"), "rule", "rule_verdict"
    )
    best = (
        asked.join(known, "_suffix")
        .where("startswith(_path, _prefix)")
        .groupBy("_host", "_path")
        .agg(F.max(order).alias("_best"))
    )
    return (
        both.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
        .withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.rule_verdict")})
        .drop("_host", "_path", "_best")
    )


def judge(pages: DataFrame, rules: DataFrame, more_links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Addresses joined by redirects or canonical links (those in the html and ``more_links`` with
    from_url and to_url) are one resource. A rule decides its own page. Any other page is blocked
    if a rule blocks an address it is joined with, else allowed; so an explicit allow holds
    against a block that comes over links, but does not free its aliases.

    Null urls and urls without ``://`` have empty host and path and no links, and are allowed;
    repeated pages are all judged; no links or no pages are no special case.
    """
    edges = links(pages)
    if more_links is not None:
        edges = edges.union(more_links.select("from_url", "to_url"))
    edges = edges.select(alias_key(F.col("from_url")).alias("u"), alias_key(F.col("to_url")).alias("v"))
    edges = pin(edges.distinct(), "links").where("u <> v")
    ends = edges.select(F.col("u").alias("url")).union(edges.select("v")).distinct()
    linked = labelled(ruled(ends, rules), "url", edges, "component")
    blocked = linked.where("rule_verdict = 'block'").select("component").distinct()
    tainted = linked.join(blocked, "component", "left_semi").select(F.col("url").alias("_key"))
    judged = ruled(pages.select("page_id", "url"), rules).withColumn("_own", alias_key(F.col("url")))
    judged = judged.join(tainted.withColumn("_tainted", F.lit(True)), F.col("_own") == F.col("_key"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("_tainted"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
