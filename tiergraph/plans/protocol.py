"""Research protocols: a question becomes an estimand, and an estimand counted, cited numbers or an abstention."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import stats, text
from tiergraph.operators.filters import is_junk
from tiergraph.operators.vectors import share

# What routes a question, in order, and the least numbers for a year or a cohort.
MONTHS = ("january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")
MODIFIERS = {
    "temporal": r"\b(over time|trend|each year|by year|by month|history|used to|nowadays|201\d|202\d)\b",
    "segment": r"\b(pre-?dental|dental student|specialt|omfs|endo|resident|cohort|segment| vs\.? )\b",
    "price": r"\b(how much|pay|paying|price|pricing|afford|\$|worth paying|willing to pay|comfortable)\b",
}
AMOUNT = r"\b(how much|price point|going rate|what.*(charge|cost)|\$\s?\d)\b"
CONTRAST = r"praise.{0,15}critic|critic.{0,15}praise|pros and cons|pros.{0,8}cons|like.{0,10}dislike|love.{0,10}hate|strengths?.{0,15}weakness|good.{0,10}bad about|best.{0,15}worst about|upsides?.{0,15}downsides?"
RANKING = (
    r"\b(cheapest|most expensive|priciest|lowest tuition|highest tuition|afford)\b", r"\b(worst|best|highest|lowest|top)\b.{0,25}\b(schools?|reviewed|rated|sentiment|reputation)\b",
    r"\bwhich schools?\b", r"\brank(ing|ed)?\b.{0,20}schools?",
)
ESTIMANDS = (
    ("belief", r"\b(gets? .*wrong|misconcept|myth|actually correct|popular.*(wrong|correct)|believe.*(true|false|correct))\b"),
    ("pain", r"\b(pain points?|struggl|fall short|worried|worry|frustrat|biggest (problem|issue|concern)|stuck|fear|anxious|anxiety)\b"),
    ("topic", r"\b(topics?|themes?|ideas?|use ?cases?|discuss|talk about|come up|aspects?|resonat|most.?talked|trending)\b"),
    ("sentiment", r"\b(opinion|sentiment|feel about|feelings|how .*view|perceiv|praise|reputation|likes?|love|hate)\b"),
)
LEAST_YEAR = LEAST_COHORT = 20


def classify_estimand(question: str) -> tuple[str, dict[str, bool]]:
    """(estimand, modifiers) of a question."""
    q = (question or "").lower()
    flags = {name: bool(re.search(p, q)) for name, p in MODIFIERS.items()}
    flags["temporal"] |= any(m in q for m in MONTHS)
    if flags["price"] and re.search(AMOUNT, q):
        return "price", flags
    if re.search(CONTRAST, q):
        return "contrast", flags
    if any(re.search(p, q) for p in RANKING):
        return "ranking", flags
    return next((name for name, p in ESTIMANDS if re.search(p, q)), "stance"), flags


def enrich(docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(doc_id, bucket, thread_id, author, year, cohort, score) of bucketed documents; a comment without a URL has its post's forum."""
    parents = docs.select(F.col("doc_id").alias("thread_id"), F.col("url").alias("__parent_url"))
    rows = buckets.join(docs, "doc_id").join(parents, "thread_id", "left")
    forum = F.coalesce(text.forum_of(F.col("url")), text.forum_of(F.col("__parent_url")))
    cohort = F.when(F.startswith("doc_id", F.lit("reddit")), text.cohort_of(forum)).otherwise("sdn")
    author = F.when(~F.col("author").isin("[deleted]", ""), F.col("author"))
    return rows.select("doc_id", "bucket", F.coalesce("thread_id", "doc_id").alias("thread_id"), author.alias("author"), text.year_of(F.col("created_iso")).alias("year"), cohort.alias("cohort"), F.coalesce("score", F.lit(0)).alias("score"))


def clean_pool(ranked: DataFrame, docs: DataFrame, *, cap: int) -> DataFrame:
    """The best ``cap`` of ranked documents (doc_id, rank) that are no junk."""
    kept = ranked.join(docs.where(~is_junk(F.col("text"), F.col("author"))).select("doc_id"), "doc_id", "left_semi")
    return kept.orderBy("rank").limit(cap)


def analyse(items: DataFrame, *, b: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    """What the protocols share: buckets with intervals, denominators, resonance, consensus, trends by year, shares by cohort."""
    total = items.count()
    #: Numerators by bucket, denominators by thread or year: no document meets the buckets that it isn't in.
    threads = items.groupBy("thread_id").agg(F.count("*").alias("n"))
    hits = items.groupBy("bucket", "thread_id").agg(F.count("*").alias("n"))
    drawn = lambda rows, by: stats.replicates(rows, by, "thread_id", "n", b=b, seed=seed)
    shared = stats.intervals(drawn(hits, ["bucket"]), drawn(threads, []), ["bucket"], [])
    counts = stats.resonance(items, ["bucket"])
    dated = items.where("year is not null")
    sizes_by_year = dated.groupBy("year").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_YEAR)
    known = dated.groupBy("bucket", "year").agg(F.count("*").alias("k"))
    #: A year in which a bucket has no document counts as well.
    years = known.select("bucket").distinct().join(F.broadcast(sizes_by_year)).join(known, ["bucket", "year"], "left").select("bucket", "year", F.coalesce("k", F.lit(0)).alias("k"), "n")
    cohorts = items.groupBy("cohort", "bucket").agg(F.count("*").alias("n"))
    sizes = cohorts.groupBy("cohort").agg(F.sum("n").alias("size")).where(F.col("size") >= LEAST_COHORT)
    shares = share(items, "bucket")
    return {
        "buckets": shared.drop("n", "n_threads").join(counts, "bucket").join(shares.select("bucket", "fraction"), "bucket"),
        "consensus": shares.agg(stats.consensus_index(F.collect_list(F.col("n").cast("double"))).alias("c")).select("c.*", F.lit(total).alias("denominator")),
        "trend": stats.trend(years, ["bucket"], "year", "k", "n"),
        "cohorts": cohorts.join(sizes, "cohort").select("cohort", "bucket", "n", F.round(F.col("n") / F.col("size"), 4).alias("fraction")),
    }


def abstains(evidence: DataFrame, *, least_docs: int = 8, least_authors: int = 5) -> DataFrame:
    """(n, authors, reason): why an answer would rest on too little; a null reason answers."""
    g = evidence.agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"))
    return g.withColumn("reason", F.when(F.col("n") == 0, "no_evidence").when(F.col("n") < least_docs, "too_few_documents").when(F.col("authors") < least_authors, "too_few_authors"))


def provenance(items: DataFrame, prefix: str, *, sample: int = 10) -> DataFrame:
    """(stat_id, label, numerator, denominator, value, sample_ids): every number with the rows behind it."""
    from tiergraph.operators.dashboards import first_ids

    counted = share(items, "bucket").withColumn("denominator", (F.col("n") / F.col("fraction")).cast("long"))
    total = items.count()
    rows = counted.join(first_ids(items, ["bucket"], "doc_id", sample), "bucket")
    return rows.select(text.stat_id(F.lit(prefix), F.col("bucket")).alias("stat_id"), F.col("bucket").alias("label"), F.col("n").alias("numerator"), F.lit(total).alias("denominator"), F.col("fraction").alias("value"), F.col("evidence").alias("sample_ids"))


def drill_down(items: DataFrame, docs: DataFrame, prefix: str, stat: str, *, offset: int = 0, limit: int = 50) -> DataFrame:
    """The exact documents behind a stat_id, a page of them."""
    own = items.where(text.stat_id(F.lit(prefix), F.col("bucket")) == stat).select("doc_id", "bucket")
    return own.join(docs, "doc_id").orderBy("doc_id").offset(offset).limit(limit)


def popular_versus_correct(stances: DataFrame, official: DataFrame) -> DataFrame:
    """(subject, popular, official, verdict): the commonest stance against the official value; without one, no_anchor."""
    counts = stances.groupBy("subject", "stance").agg(F.count("*").alias("n"))
    top = counts.groupBy("subject").agg(F.max(F.struct("n", "stance")).alias("m")).select("subject", F.col("m.stance").alias("popular"))
    joined = top.join(official.select("subject", F.col("value").alias("official")), "subject", "left")
    verdict = F.when(F.col("official").isNull(), "no_anchor").when(F.lower("popular") == F.lower("official"), "popular_is_correct").otherwise("popular_is_wrong")
    return joined.withColumn("verdict", verdict)


def estimand_prices(items: DataFrame, text_col: str) -> DataFrame:
    """(n, p25, median, p75) of the amounts that documents name, inclusive quartiles."""
    amounts = items.select(F.explode(text.prices(F.col(text_col))).alias("v"))
    return amounts.agg(F.count("*").alias("n"), *[F.round(F.percentile("v", q), 2).alias(name) for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])


def signals(items: DataFrame, lexicons: dict[str, tuple[str, ...]], *, since: int = 2020) -> DataFrame:
    """A row a bucket: shares of documents with a word of each lexicon, the exclusive p90 of scores (for ten or fewer their maximum), recency."""
    head = F.lower(F.substring("text", 1, 400))

    def has(words: tuple[str, ...]):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(head, F.lit(w))
        return F.coalesce(out, F.lit(False))

    scores = F.collect_list(F.col("score").cast("double"))
    p90 = F.when(F.size(scores) > 10, stats.quantile_exclusive(scores, 0.9)).otherwise(F.coalesce(F.max("score").cast("double"), F.lit(0.0)))
    return items.groupBy("bucket").agg(*[F.round(F.avg(has(w).cast("double")), 4).alias(n) for n, w in lexicons.items()], F.round(p90, 2).alias("engagement"), F.round(F.avg((F.col("year") >= since).cast("double")), 4).alias("recency"), F.count("*").alias("n_signal"))


def stale_official(metrics: DataFrame, now: datetime, months: int = 6) -> DataFrame:
    return metrics.where(F.col("t_valid_to").isNotNull() & (F.floor((F.unix_seconds(F.lit(now)) - F.unix_seconds("t_valid_to")) / 86400) / 30 > months))
