"""URL filters by a temporal list join.

Lists of hosts, domains and path prefixes change: an entry is added on one day and
removed on another. Dated entries become validity intervals, and every capture is
judged by the entries that were active when it was fetched, not by today's list. A
capture looks up all keys that could match its URL (its host, each parent domain, and
each path prefix, up to the longest in the lists) by equality, and an interval must contain its fetch
time. Everything is DataFrame functions.

Intervals of one key are cut at months, and the join is on key and month: however long
the history of a key that a third of all captures share, a capture meets only the
entries of its month. Captures that are equal are judged once.

Defined results: the most specific active entry decides (a longer path, then a longer
host, before a shorter one), and of equally specific ones deny wins; without any the
verdict is none. Null and empty URLs, URLs without a host, and null fetch times have
no keys, so none. Entries with a null pattern, date or event are ignored; several
events of one entry on one day count as the last of them in the order remove, add.
Repeated rows are judged alike and all kept, with all their columns. Empty tables give
none for every capture, or an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.llm._common import write_scratch

#: A list's keys are broadcast up to so many (some 10 MB), to sift captures; beyond that the join alone does.
SMALL_ROWS = 100_000


def url_host(url: Column) -> Column:
    """The host of an http(s) URL, in lower case, without user, port and trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^\s*https?://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def url_keys(url: Column, depth: int) -> Column:
    """What list entries of up to ``depth`` path segments may match a URL: structs of key (kind:pattern) and rank, the specificity."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")).alias("key"), (F.size(labels) - i + 1).cast("int").alias("rank")))
    path = F.split(F.regexp_extract(url, r"(?i)^\s*https?://[^/?#]*/([^?#\s]*)", 1), "/")
    segments = F.slice(F.filter(path, lambda s: s != ""), 1, depth)
    prefixes = F.transform(F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("key"), (i + 200).cast("int").alias("rank")))
    exact = F.array(F.struct(F.concat(F.lit("host:"), host).alias("key"), F.lit(100).alias("rank")))
    return F.when(host.isNotNull(), F.concat(domains, exact, prefixes))


def list_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, since, until) from dated entries (list, kind, pattern, action, listed_at, event).

    event is add or remove; an interval is [since, until), with until null while the entry stands.
    """
    known = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("event").isin("add", "remove"))
    #: Hosts have no case, paths do.
    host = F.substring_index("pattern", "/", 1)
    pattern = F.when(F.col("kind") == "path", F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1))).otherwise(F.lower("pattern"))
    keyed = known.select("list", F.concat_ws(":", "kind", pattern).alias("key"), "action", F.col("listed_at").cast("timestamp").alias("since"), F.when(F.col("event") == "add", 1).otherwise(0).alias("on"))
    daily = keyed.groupBy("list", "key", "action", "since").agg(F.max("on").alias("on"))
    order = Window.partitionBy("list", "key", "action").orderBy("since")
    #: Repeated adds prolong an interval, repeated removes do nothing.
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("on <> was")
    return changes.withColumn("until", F.lead("since").over(order)).where("on = 1").select("list", "key", "action", "since", "until")


def judge_captures(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at", depth: int | None = None) -> DataFrame:
    """The captures with verdict (deny, allow or none), matched_key, matched_list, n_active (matching active entries).

    Paths are looked up to ``depth`` segments, by default as many as the longest path entry has.
    """
    if depth is None:
        depth = entries.where("kind = 'path'").agg(F.max(F.size(F.filter(F.split("pattern", "/"), lambda s: s != "")) - 1)).first()[0] or 0
    looked = captures.select(F.col(url_col).alias("__url"), F.col(time_col).cast("timestamp").alias("__at")).where("__url is not null and __at is not null").distinct()
    keys = looked.select("__url", "__at", F.trunc("__at", "MM").alias("month"), F.explode(url_keys(F.col("__url"), depth)).alias("k")).select("__url", "__at", "month", "k.key", "k.rank")
    last = looked.agg(F.max("__at")).first()[0]  # one value: how far open intervals reach
    spans = list_intervals(entries).where(F.col("since") <= F.lit(last)).withColumn("end", F.least(F.coalesce("until", F.lit(last)), F.lit(last)))
    monthly = spans.select("list", "key", "action", "since", "until", F.explode(F.sequence(F.trunc("since", "MM"), F.trunc("end", "MM"), F.expr("interval 1 month"))).alias("month"))
    #: Keys that no list has, such as a top-level domain, stay where they are instead of meeting in one task.
    listed = write_scratch(spans.select("key").distinct(), "listed")
    keys = keys.join(F.broadcast(listed), "key", "left_semi") if listed.count() <= SMALL_ROWS else keys
    met = keys.join(monthly, ["key", "month"]).where((F.col("__at") >= F.col("since")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
    first = F.struct((-F.col("rank")).alias("rank"), F.when(F.col("action") == "deny", 0).otherwise(1).alias("deny"), F.col("key"), F.col("list"))
    judged = met.groupBy("__url", "__at").agg(F.min(F.struct(first.alias("first"), F.col("action"))).alias("m"), F.count("*").alias("__n"))
    found = judged.select("__url", "__at", F.col("m.action").alias("__verdict"), F.col("m.first.key").alias("__key"), F.col("m.first.list").alias("__list"), "__n")
    rows = captures.withColumns({"__own_url": F.col(url_col), "__own_at": F.col(time_col).cast("timestamp")})
    out = rows.join(found, (F.col("__own_url") == F.col("__url")) & (F.col("__own_at") == F.col("__at")), "left")
    return out.select(*captures.columns, F.coalesce("__verdict", F.lit("none")).alias("verdict"), F.col("__key").alias("matched_key"), F.col("__list").alias("matched_list"), F.coalesce("__n", F.lit(0).cast("long")).alias("n_active"))
