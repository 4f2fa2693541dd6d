"""URL filters by rules and redirect equivalence.

A rule is (verdict, host, path).  It fits the urls of its host and all
subdomains whose path starts with the rule's path; of the fitting rules the
longest (host and path) wins.  Urls without a rule of their own take the
verdict of their aliases: redirects (a table of edges, if there is one),
canonical links and refreshes found in the pages are edges between urls;
a connected component with a blocked url blocks its members, unless it also has
an explicitly allowed one.  A url's own rule always stands.  Else: allow.

Links and refreshes may be relative: they are resolved against the page's base.
All of them count, with their character references decoded.

Null urls and urls without ``://`` have an empty host and path, no rule, and
verdict allow; they take no part in edges.  All on the JVM but for the parsing
of pages that hold the words of such a link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .components import components
from .htmltext import PageParser

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"
#: The target of a refresh's content, and what an absolute url begins with.
TARGET = re.compile(r"""(?is)\s*(?:[\d.]+\s*[;,\s]\s*|.*?(?=\burl\s*=))(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""")
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def own_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (name, verdict), else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


class Links(PageParser):
    """The canonical links and refresh targets of a page as written, and its base."""

    def __init__(self):
        super().__init__()
        self.base: str | None = None
        self.targets: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ("link", "meta", "base"):
            return
        own = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        if tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.targets.append(own.get("href", ""))
        elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            found = TARGET.match(own.get("content", ""))
            self.targets.append(next((x for x in found.groups() if x), "") if found else "")
        elif tag == "base" and self.base is None:
            self.base = own.get("href")


def resolved(base: str, target: str) -> str | None:
    """The absolute url of a target, null where there is none."""
    target = target.strip()
    if target and not ABSOLUTE.match(target):
        try:
            target = urljoin(base, target)
        except ValueError:
            return None
    return target if ABSOLUTE.match(target) else None


def page_links(url: str, html: str) -> list[str]:
    """Absolute targets of the page's canonical links and refreshes, in order."""
    parser = Links()
    parser.feed(html)
    parser.close()
    base = resolved(url, parser.base or "") or url
    return [x for t in parser.targets if (x := resolved(base, t))]


def _edge_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges = [(u, x) for u, h in zip(texts_of(batch, 0), texts_of(batch), strict=True) for x in page_links(u, h)]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.string()) for i in (0, 1)], ["src", "dst"])


def page_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst) of all canonical links and refreshes, targets resolved."""
    found = pages.where(F.col(url_col).contains("://")).where(F.lower(html_col).contains("canonical") | F.lower(html_col).contains("http-equiv"))
    return map_batches(found.select(F.col(url_col).alias("src"), F.col(html_col).alias("html")), _edge_kernel, "src string, dst string")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; redirects: (src, dst) of urls."""
    rule = own_rule(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), path_of(url_col).alias("path")).withColumn("r", rule)
    edges = None if html_col is None else page_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src is not null and dst is not null")
        edges = more if edges is None else edges.unionByName(more)
    plain = F.coalesce(F.col("r.verdict"), F.lit("allow"))
    if edges is None:
        return base.select("page_id", "host", "path", F.col("r.name").alias("rule"), plain.alias("verdict"))
    same = components(edges)
    known = same.withColumn("host", host_of("node")).withColumn("path", path_of("node")).withColumn("v", own_rule(F.col("host"), F.col("path"), rules)["verdict"])
    decided = known.groupBy("component").agg(F.coalesce(F.max(F.col("v") == "block"), F.lit(False)).alias("b"), F.coalesce(F.max(F.col("v") == "allow"), F.lit(False)).alias("a"))
    blocked = same.join(decided.where("b and not a").select("component"), "component", "left_semi").select(F.col("node").alias("url"), F.lit(True).alias("alias_blocked"))
    verdict = F.when(F.col("r").isNull() & F.col("alias_blocked"), F.lit("block")).otherwise(plain)
    return base.join(blocked, "url", "left").select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"))
