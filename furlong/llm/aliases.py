"""URL filters: rules on hosts and paths, and block decisions handed on along redirects and canonical links."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .work import broadcast_if, discard, materialize


class Rule(NamedTuple):
    """A rule fits its host and all subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str  # allow or block


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are constants of the plan, and each is tried on each url: a longer list is refused.
MOST_RULES = 10_000
REFRESH = re.compile(r"\s*[\d.]*\s*[;,]?\s*(?:url\s*=)?\s*[\"']?([^\"']+)", re.I)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """One spelling for the forms of a url that name the same resource: no scheme, default port, fragment, slash at the end of
    the path, or ``utm_`` parameter. Null where there is no host."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def judge(df: DataFrame, url: str, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with host, path, and the rule and ruling of the longest rule (of two equally long ones, that of the longer host)
    that fits; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if bad := [r for r in rules if r.verdict not in ("allow", "block")]:
        raise ValueError(f"a verdict is allow or block: {bad}")
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if not rules:
        return df.withColumn("rule", F.lit(None).cast("string")).withColumn("ruling", F.lit(None).cast("string"))
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r))
    known = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in ordered])
    fits = lambda r: ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))) & F.col("path").startswith(r["path"])
    df = df.withColumn("__first", F.get(F.filter(known, fits), F.lit(0)))
    return df.withColumn("rule", F.concat("__first.host", "__first.path")).withColumn("ruling", F.col("__first.verdict")).drop("__first")


class Declared(HTMLParser):
    """Targets that a page declares for itself: canonical links, and refreshes to another url."""

    def __init__(self):
        super().__init__()
        self.base, self.targets = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and not self.base:
            self.base = a.get("href", "")
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.targets.append(a.get("href", ""))
        elif tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and (m := REFRESH.match(a.get("content", ""))):
            self.targets.append(m[1])


def declared_targets(url: str, html: str) -> list[str]:
    """Absolute urls of the declared targets; what cannot be read as a url is no target."""
    parser, out = Declared(), []
    parser.feed(html)
    for t in parser.targets:
        try:
            out.append(urljoin(urljoin(url, parser.base), t.strip()))
        except ValueError:
            continue
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the redirects and canonical links that ``pages`` (url, html) declare. Spark drops the pages without such
    words before any text goes to Python."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(u, t) for u, h in zip(b["url"], b["html"], strict=True) for t in declared_targets(u, h)]
            yield pd.DataFrame(found, columns=["url", "target"])

    likely = pages.filter(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    return likely.mapInPandas(read, "url string, target string")


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html",
) -> DataFrame:
    """A verdict for each row: page_id, host, path, rule, verdict, via (rule, alias, none).

    A url that a rule fits has that rule's verdict. The rest follows its aliases: urls of one ``address``, and all that
    redirects (``redirects``: url, target; and refreshes in the html) and canonical links connect, pages or not. A class
    with a blocked member is blocked, unless a rule explicitly allows a member; a class without decisions is allowed.

    Null urls, and urls without ``://``, have empty host and path, no aliases and the verdict allow. Null html declares
    nothing. Repeated rows and ids each have their row; an empty table gives none; other columns are ignored.

    Only decided addresses, linked addresses and the addresses of undecided pages are shuffled, each reduced to distinct
    ones first, so one url or class with a third of all rows is no hot key. What an undecided page must look up are the
    addresses that inherit a block; they are broadcast when measured small, else joined by shuffle (skewed partitions are
    split by adaptive execution)."""
    spark = pages.sparkSession
    own = judge(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "url", rules)
    own = own.withColumn("address", address(F.col("url")))
    links = spark.createDataFrame([], "url string, target string")
    if html_col:
        links = page_links(pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("url").cast("string"), F.col("target").cast("string")))
    links = materialize(links)
    classes = materialize(connected_components(links.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b")).dropna()))

    ends = links.select(F.explode(F.array("url", "target")).alias("url")).distinct()
    decided = own.select("address", "ruling").unionByName(judge(ends, "url", rules).select(address(F.col("url")).alias("address"), "ruling"))
    says = lambda v: F.max(F.col("ruling") == v).alias(v)
    votes = decided.filter("ruling is not null and address is not null").groupBy("address").agg(says("allow"), says("block"))
    votes = votes.join(classes.withColumnRenamed("node", "address"), "address", "left").withColumn("class", F.coalesce("component", "address"))
    blocked = votes.groupBy("class").agg(F.max("allow").alias("allow"), F.max("block").alias("block")).filter("block and not allow").select("class")
    blocked = materialize(blocked).hint("merge")  # it grows with the urls: never broadcast, however well its files are packed
    members = classes.join(blocked.withColumnRenamed("class", "component"), "component", "left_semi").select(F.col("node").alias("address"))
    need = own.filter("ruling is null and address is not null").select("address").distinct()
    hit = materialize(need.join(blocked.withColumnRenamed("class", "address").union(members).distinct(), "address", "left_semi"))
    size = hit.agg(F.sum(F.octet_length("address") + 32)).first()[0] or 0
    for df in (links, classes, blocked):
        discard(df)

    looked = own.join(broadcast_if(hit.withColumn("inherits", F.lit(True)), size), "address", "left")
    return looked.select(
        "page_id", "host", "path", "rule", F.when(F.col("ruling").isNotNull(), F.col("ruling")).when(F.col("inherits"), "block").otherwise("allow").alias("verdict"),
        F.when(F.col("ruling").isNotNull(), "rule").when(F.col("inherits"), "alias").otherwise("none").alias("via"),
    )
