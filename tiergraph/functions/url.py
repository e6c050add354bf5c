"""URLs: hosts, sites, blocked domains, links, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forums, which have readers of their own, and social media, which are out of scope.
FORUMS = ("reddit.com", "old.reddit.com", "studentdoctor.net", "sdn.net", "stackoverflow.com", "stackexchange.com", "discord.com", "discord.gg", "discourse.org", "discoursehosting.com")
SOCIAL = ("twitter.com", "x.com", "instagram.com", "facebook.com", "linkedin.com", "tiktok.com", "snapchat.com", "youtube.com", "bsky.app", "mastodon.social", "threads.net", "pinterest.com")
BLOCKED = FORUMS + SOCIAL


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """The path, / where there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+(/[^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def defragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def same_site(a: Column, b: Column) -> Column:
    return bare_host(a) == bare_host(b)


def is_blocked(domain: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """A blocked domain or one below it."""
    out = F.lit(False)
    for d in blocked:
        out = out | (domain == d) | domain.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def links(html: Column, attribute: str = "href") -> Column:
    """The distinct absolute targets of an attribute, without fragments."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"""(?i){attribute}=["'](https?://[^"'#\s]+)"""), F.lit(1))
    return F.array_distinct(found)


def parse_robots(bodies: DataFrame, body_col: str, by: list[str]) -> DataFrame:
    """(by, kind, rule, value): the directives for all agents, in lower case, from robots.txt texts.

    Lines keep their place; a user-agent line opens a group for the lines after it.
    """
    lines = bodies.select(*by, F.posexplode(F.split(F.coalesce(F.col(body_col), F.lit("")), r"\r?\n")).alias("at", "line"))
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line like '%:%'")
    parsed = clean.select(*by, "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("kind"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("at")  # a robots file's lines
    agent = F.last(F.when(F.col("kind") == "user-agent", F.col("value")), ignorenulls=True).over(order)
    return parsed.withColumn("agent", agent).where((F.col("kind") == "sitemap") | ((F.col("agent") == "*") & F.col("kind").isin("allow", "disallow", "crawl-delay"))).select(*by, "kind", "value")


def robots_allowed(urls: DataFrame, rules: DataFrame, by: list[str], path_col: str) -> DataFrame:
    """Adds allowed: the longest rule that a path starts with, allow at ties, and allowed without any."""
    kept = rules.where(F.col("kind").isin("allow", "disallow") & (F.col("value") != ""))
    met = urls.join(kept, by).where(F.startswith(F.col(path_col), F.col("value")))
    best = met.groupBy(*by, path_col).agg(F.max(F.struct(F.length("value").alias("n"), (F.col("kind") == "allow").alias("allow"))).alias("m"))
    return urls.join(best, [*by, path_col], "left").withColumn("allowed", F.coalesce("m.allow", F.lit(True))).drop("m")


def crawl_delay(value: Column) -> Column:
    """Seconds, kept in [0.5, 10]."""
    return F.greatest(F.lit(0.5), F.least(F.lit(10.0), value.try_cast("double")))
