"""Block and allow rules over addresses, carried to aliases (operator 11).

A rule is a host and a path; it fits an address whose host is that host or below it and whose path starts with that
path.  The longest rule decides (by characters of host and path; of equally long ones that of the longer host, and of
one rule given both ways, allow).  Addresses that redirect or name a canonical address are aliases: their graph's
connected components share a block.  An address that no rule fits is blocked if its component holds an address that a
rule blocks.  An allow stands for its own address only: it outweighs an alias's block, and isn't carried on.

1. Every page is read once for its address and its links (`<link rel=canonical>`, `<meta http-equiv=refresh>`); what
   follows is without the markup.
2. Rules meet addresses by equality: an address gives one key (last labels of the host, first characters of the path)
   for each pair of a label count and a path length that some rule has, so neither the number of rules nor of addresses
   matters to a key, and no list of a host's rules is gathered.
3. Components come by contraction of the links' graph, in written tables (components.py); vertices are 128 bits of the
   address's SHA-256.  Blocks of rules on linked addresses go to components, and from these to their members.

Edge cases: a null address, or one without `://`, has neither host nor path, no rule and no alias, and is allowed; an
empty table gives no rows; repeated pages are judged each; links to nowhere, to themselves or in comments and scripts
count for nothing; rules without host or path are no rules; markup of any length is searched whole; columns of pages
other than the named ones don't enter.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages
from .components import components
from .jaccard import checked

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z folded; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """The vertex of an address: its scheme and host folded, an empty path as /, no fragment; null without ://."""
    path = path_of(url)
    plain = F.concat(F.translate(F.regexp_extract(url, _ADDRESS, 1), _UPPER, _LOWER), F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, _ADDRESS, 4))
    return F.when(F.instr(url, "://") > 0, F.substring(F.unhex(F.sha2(plain, 256)), 1, 16))


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*(F.regexp_extract(tag, value, k) for k in (1, 2, 3))))


def linked_addresses(html: Column) -> Column:
    """Addresses, as written, that a page names as its canonical one or redirects to."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    tags = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?i)^<link") & F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh"))
    goes = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)^[^;,]*[;,]\s*url\s*=\s*["']?\s*([^"']*)""", 1))
    found = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), goes)
    found = F.filter(F.transform(found, lambda x: F.regexp_replace(F.trim(x), "&amp;", "&")), lambda x: x != "")
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), found)


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link of a page as an address of its own; null if it is none."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if b is None or x is None else urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def ruled(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, action) for each row of urls (key: unique, host, path) that a rule (host, path, action) fits."""
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), "action").where("r_host <> '' AND r_path <> ''")
    # one rule, given both ways, allows
    own = own.groupBy("r_host", "r_path").agg(F.min("action").alias("action"))
    labels = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) + 1
    shapes = own.select(labels(F.col("r_host")).alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    if not shapes:
        return urls.select(key).limit(0).select(key, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    kinds = F.array(*(F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in sorted(shapes)))
    fits = F.filter(kinds, lambda s: (s["labels"] <= labels(F.col("host"))) & (s["chars"] <= F.length("path")))
    keyed = urls.select(key, "host", "path", F.explode(fits).alias("s"))
    keyed = keyed.select(key, F.expr("substring_index(host, '.', -s.labels)").alias("r_host"), F.expr("substring(path, 1, s.chars)").alias("r_path"))
    met = keyed.join(checked(own), ["r_host", "r_path"])
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), "action")
    return met.groupBy(key).agg(F.max(rank).alias("best")).select(key, "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(id, url, host, path, rule, verdict, component) for each page.

    rules: (host, path, action: allow or block); redirects: known ones (from_url, to_url), beside those in the markup.
    component: the vertex, in hexadecimal, that stands for the page's aliases; null if it has none.
    """
    spark = pages.sparkSession
    stages = Stages(spark, "urls")
    u = F.col(url)
    links = F.lit(None).cast("array<string>") if html is None else linked_addresses(F.col(html))
    read = pages.select(F.col(id).alias("id"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"), links.alias("links"), F.monotonically_increasing_id().alias("row"))
    read = stages.write(read, "pages")
    sent = read.where("node IS NOT NULL").select(F.col("url").alias("a"), F.explode("links").alias("b")).select("a", resolved("a", "b").alias("b"))
    if redirects is not None:
        sent = sent.union(redirects.select("from_url", "to_url"))
    sent = stages.write(sent.select(node_of(F.col("a")).alias("x"), F.col("a"), node_of(F.col("b")).alias("y"), F.col("b")).where("x <> y"), "links")
    alias = components(sent.select(F.col("x").alias("a"), F.col("y").alias("b")), stages)
    ends = sent.select(F.col("x").alias("node"), F.col("a").alias("u")).union(sent.select("y", "b")).groupBy("node").agg(F.min("u").alias("u"))
    ends = stages.write(ends.select("node", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), "ends")
    blocked = ruled(ends, rules, "node").where("action = 'block'").select(F.col("node").alias("v"))
    bad = stages.write(alias.join(blocked, "v").select("comp").distinct().withColumn("bad", F.lit(True)), "bad")
    alias = stages.write(alias.join(checked(bad), "comp", "left").select(F.col("v").alias("node"), "comp", "bad"), "alias")
    own = stages.write(ruled(read, rules, "row"), "ruled")
    out = read.drop("links").join(own, "row", "left").join(checked(alias), "node", "left")
    verdict = F.coalesce("action", F.when(F.col("bad"), F.lit("block")), F.lit("allow"))
    return out.select(F.col("id").alias(id), F.col("url"), "host", "path", "rule", verdict.alias("verdict"), F.lower(F.hex("comp")).alias("component"))
