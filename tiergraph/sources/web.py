"""Crawled pages: challenges, caches, tables, sitemaps, and their versioned graph. Fetching is left to others."""

from __future__ import annotations

from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.functions.text import chunks
from tiergraph.functions.url import bare_host, defragment, links
from tiergraph.model import make_edges, make_nodes

# Marks of challenge pages, and how much of a body is looked at.
CHALLENGE_HEADERS = (("server", "datadome"), ("cf-mitigated", "challenge"), ("server", "cloudflare"))
CHALLENGE_COOKIES = ("_pxhd=", "datadome=")
CHALLENGE_BODIES = ("cf-chl-bypass", "px-captcha-data", "DataDome.captchaPage()", "Just a moment...")
CHALLENGE_BYTES = 16_384


def is_challenge(headers: Column, body: Column) -> Column:
    """A challenge page in place of the content. headers: a map with keys in lower case."""
    out = F.lit(False)
    for name, mark in CHALLENGE_HEADERS:
        out = out | F.coalesce(F.contains(F.lower(F.try_element_at(headers, F.lit(name))), F.lit(mark)), F.lit(False))
    cookies = F.coalesce(F.lower(F.try_element_at(headers, F.lit("set-cookie"))), F.lit(""))
    for mark in CHALLENGE_COOKIES:
        out = out | F.contains(cookies, F.lit(mark))
    head = F.substring(F.coalesce(body, F.lit("")), 1, CHALLENGE_BYTES)
    for mark in CHALLENGE_BODIES:
        out = out | F.contains(head, F.lit(mark))
    return out


def unchanged(fetches: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds content_hash and cache_hit: whether the URL's cached body is the same. cache: url_key, content_hash."""
    keyed = fetches.withColumns({"url_key": F.substring(F.sha2("url", 256), 1, 16), "content_hash": F.sha2("body", 256)})
    known = cache.select("url_key", F.col("content_hash").alias("__cached"))
    return keyed.join(known, "url_key", "left").withColumn("cache_hit", F.coalesce(F.col("content_hash") == F.col("__cached"), F.lit(False))).drop("__cached")


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.open:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            if rows := [r for r in self.open.pop() if r]:
                self.tables.append(rows)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def tables_of(html: str) -> list[dict]:
    parser = _Tables()
    parser.feed(html or "")
    return [{"ordinal": i, "rows": len(t), "cols": max(map(len, t)), "cells": t} for i, t in enumerate(parser.tables)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))])))
def html_tables(html: pd.Series) -> pd.Series:
    """The tables of a page as cell grids."""
    return html.map(tables_of)


def sitemap_urls(sitemaps: DataFrame, body_col: str, *, is_index: bool = False) -> DataFrame:
    """(…, loc) of the pages that sitemaps list, or of the sitemaps that indexes list."""
    tag = "sitemap" if is_index else "url"
    loc = F.regexp_extract_all(F.col(body_col), F.lit(rf"(?is)<{tag}>.*?<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return sitemaps.select(*[c for c in sitemaps.columns if c != body_col], F.explode(F.array_distinct(loc)).alias("loc"))


def page_versions(records: DataFrame, *, key: str, time: str, content: str) -> DataFrame:
    """Versions of pages: a row each time the content of a key changes, closed where the next begins."""
    order = Window.partitionBy(key).orderBy(time)
    changed = records.withColumn("__was", F.lag(content).over(order)).where(F.col("__was").isNull() | (F.col("__was") != F.col(content)))
    closed = F.lead(time).over(order)
    return changed.withColumns({"t_valid_to": closed, "t_ingest_to": closed}).drop("__was")


def assemble_pages(records: DataFrame, *, url_col: str, html_col: str, time_col: str, tier: str, ingest: datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): pages, links to pages of this run, and references to other sites; links to unseen pages of the own site are dropped."""
    pages = records.select(defragment(F.col(url_col)).alias("url"), F.col(html_col).alias("html"), F.col(time_col).cast("timestamp").alias("at"))
    pages = pages.groupBy("url").agg(F.max_by(F.struct("html", "at"), "at").alias("p")).select("url", "p.*")
    page_id = lambda c: F.concat(F.lit("page:"), F.substring(F.sha2(c, 256), 1, 16))
    out = pages.select("url", "at", F.explode(links(F.col("html"))).alias("target")).where("target <> url")
    inside = out.join(pages.select(F.col("url").alias("target")), "target", "left_semi")
    outside = out.join(pages.select(F.col("url").alias("target")), "target", "left_anti").where(bare_host(F.col("url")) != bare_host(F.col("target")))
    nodes = make_nodes(pages, "Page", tier, page_id(F.col("url")), F.struct("url", bare_host(F.col("url")).alias("domain"), F.sha2("html", 256).alias("content_hash"), F.octet_length("html").alias("bytes")))
    nodes = nodes.unionByName(make_nodes(outside.select("target").distinct(), "ExternalRef", tier, F.concat(F.lit("external:"), F.substring(F.sha2("target", 256), 1, 16)), F.struct(F.col("target").alias("url"))))
    known = (F.lit(ingest), None)
    edges = make_edges(inside, "LINKS_TO", tier, page_id(F.col("url")), page_id(F.col("target")), valid=(F.col("at"), None), ingest=known)
    return nodes, edges.unionByName(make_edges(outside, "REFERENCES_EXTERNAL", tier, page_id(F.col("url")), F.concat(F.lit("external:"), F.substring(F.sha2("target", 256), 1, 16)), valid=(F.col("at"), None), ingest=known))


# Words of a chunk, and of the overlap of two.
CHUNK_WORDS, CHUNK_OVERLAP = 512, 64
#: From which score a mention is a link, and from which one it is to be reviewed.
LINKED, REVIEWED = 95.0, 75.0


def _short(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def tag_pages(pages: DataFrame, mentions: DataFrame, known: DataFrame, *, tier: str, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, reviews) of pages (page_id, url, body) and what they mention (page_id, entity_id, name, score).

    Pages get chunks; an entity without a node in ``known`` (id) gets a stub, so that one that has is never overwritten;
    a mention below a link's score is an edge as well, and one to be reviewed.
    """
    cut = pages.select("page_id", F.posexplode(chunks(F.col("body"), CHUNK_WORDS, CHUNK_OVERLAP)).alias("ordinal", "c")).select("page_id", "ordinal", "c.chunk")
    chunk_id = F.concat(F.lit("chunk:"), _short(F.col("page_id"), F.col("ordinal").cast("string"), F.col("chunk")))
    words = F.size(F.filter(F.split("chunk", r"\s+"), lambda w: w != ""))
    nodes = make_nodes(cut, "Chunk", tier, chunk_id, F.struct("page_id", "ordinal", F.col("chunk").alias("text"), words.alias("token_count"), F.substring(F.sha2("chunk", 256), 1, 16).alias("content_hash")))
    met = mentions.where(F.col("score") >= REVIEWED)
    stubs = met.groupBy("entity_id").agg(F.min("name").alias("canonical_name")).join(known.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    nodes = nodes.unionByName(make_nodes(stubs, "Entity", tier, F.col("entity_id"), F.struct("canonical_name")))
    since = {"valid": (F.lit(now), None), "ingest": (F.lit(now), None)}
    edges = make_edges(cut, "HAS_CHUNK", tier, F.col("page_id"), chunk_id, **since)
    best = met.groupBy("page_id", "entity_id").agg(F.max("score").alias("score"))
    edges = edges.unionByName(make_edges(best, "MENTIONS", tier, F.col("page_id"), F.col("entity_id"), confidence=F.col("score") / 100, **since))
    reviews = best.where(F.col("score") < LINKED).join(pages.select("page_id", "url"), "page_id").select(F.lit("entity_link_ambiguous").alias("item_type"), "page_id", "url", "entity_id", "score")
    return nodes, edges, reviews


def page_groups(pages: DataFrame, size: int) -> DataFrame:
    """(cluster_id, members): pages (url, content_hash) in groups of at most ``size``, by the hash of their URL; ids depend on the members alone.

    A group is a hash bucket cut into runs, so no task sees all pages.
    """
    buckets = max(1, -(-pages.count() // (size * 64)))
    order = Window.partitionBy("__bucket").orderBy("url", "content_hash")
    placed = pages.select("url", "content_hash").withColumn("__bucket", F.pmod(F.xxhash64("url"), F.lit(buckets))).withColumn("__run", F.floor((F.row_number().over(order) - 1) / size))
    grouped = placed.groupBy("__bucket", "__run").agg(F.array_sort(F.collect_list(F.concat_ws("|", "url", "content_hash"))).alias("keys"), F.array_sort(F.collect_list("url")).alias("members"))
    return grouped.select(F.concat(F.lit("cluster:"), F.substring(F.sha2(F.array_join("keys", "|"), 256), 1, 16)).alias("cluster_id"), "members")


def within_budget(n_clusters: int, *, spent: float, cap: float, each: float = 0.001) -> tuple[bool, float]:
    """(whether summaries of so many clusters fit into what is left of a month's cap, their projected cost)."""
    projected = n_clusters * each
    return projected <= max(0.0, cap - spent), projected


def media_assets(pages: DataFrame, *, tier: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the images of pages (page_id, html), a node an address, and which page embeds which."""
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1)))).alias("src"))
    asset = F.concat(F.lit("media:"), _short(F.col("src")))
    nodes = make_nodes(found.select("src").distinct(), "MediaAsset", tier, asset, F.struct(F.col("src").alias("url")))
    return nodes, make_edges(found, "EMBEDS", tier, F.col("page_id"), asset, valid=(F.lit(now), None), ingest=(F.lit(now), None))


def page_tables(pages: DataFrame, *, tier: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the tables of pages (page_id, html), each a node of its own page."""
    found = pages.select("page_id", F.explode(html_tables(F.col("html"))).alias("t")).select("page_id", "t.*")
    table = F.concat(F.lit("table:"), _short(F.col("page_id"), F.col("ordinal").cast("string")))
    nodes = make_nodes(found, "Table", tier, table, F.struct("page_id", "ordinal", "rows", "cols", F.to_json("cells").alias("cells")))
    return nodes, make_edges(found, "TABLE_OF", tier, table, F.col("page_id"), valid=(F.lit(now), None), ingest=(F.lit(now), None))
