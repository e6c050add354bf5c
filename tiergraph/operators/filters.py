"""Predicates over nodes and edges: tiers, time, anomalies, levels, and content filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.model import LEVEL_EDGES, LEVEL_NODES, tier_ordinal
from tiergraph.runtime import in_blocks


def tier_passes(tier: Column, minimum: str | None) -> Column:
    """At least as trusted as ``minimum``."""
    return F.lit(True) if minimum is None else tier_ordinal(tier) <= tier_ordinal(F.lit(minimum))


def visible_at(at: datetime | Column, start: str = "t_ingest_from", end: str = "t_ingest_to") -> Column:
    """Known at an instant: [start, end), an open side always passes."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at))


def overlaps(low: datetime, high: datetime) -> Column:
    """Held at some time of [low, high]; edges without a start pass."""
    starts_late, ended = F.col("t_valid_from") > F.lit(high), F.col("t_valid_to") < F.lit(low)
    return F.col("t_valid_from").isNull() | ~(starts_late | F.coalesce(ended, F.lit(False)))


def edge_passes(*, tier_min: str | None = None, as_of: datetime | None = None, time_range: tuple[datetime, datetime] | None = None, include_anomalies: bool = False) -> Column:
    """One predicate for all edge filters."""
    out = tier_passes(F.col("source_tier"), tier_min)
    if not include_anomalies:
        out = out & ~F.coalesce(F.col("qualifiers")["status"] == "anomaly", F.lit(False))
    if as_of is not None:
        out = out & visible_at(as_of)
    if time_range is not None:
        out = out & overlaps(*time_range)
    return out


def nodes_at_level(nodes: DataFrame, level: str) -> DataFrame:
    """Level C is open."""
    return nodes if level == "C" else nodes.where(F.col("label").isin(*LEVEL_NODES[level]))


def edges_at_level(edges: DataFrame, level: str) -> DataFrame:
    return edges if level == "C" else edges.where(F.col("label").isin(*LEVEL_EDGES[level]))


# Markers of opinions, bots' names, and how automatic or removed text begins.
SENTIMENT_MARKERS = ("good", "bad", "great", "awful", "love", "hate", "best", "worst", "recommend", "avoid", "amazing", "terrible")
BOT_NAMES = (r"^AutoModerator$", r"^.*[Bb][Oo][Tt]_$", r"^.*-Bot$")
JUNK_PREFIXES = (
    "this post", "your post", "your submission", "your comment", "please use", "i am a bot", "this comment was removed", "this action was performed", "thank you for your submission", "removed",
    "deleted", "any pre-dental", "all pre-dental", "questions should be directed", "this is an automated", "all questions about", "welcome to r/",
)
MIN_REPLY, MIN_TEXT = 20, 15
#: Vectors of a blocklist that are broadcast at once, some 10 MB.
BLOCK = 4000


def utility_reason(text: Column, author: Column, is_reply: Column, *, is_crosspost: Column | None = None, duplicate_of: Column | None = None, mentions_entity: Column | None = None) -> Column:
    """Why a post is not worth a model's time, or kept. The author is the plain user name."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    mentions = F.lit(False) if mentions_entity is None else F.coalesce(mentions_entity, F.lit(False))
    bot = author.rlike("|".join(BOT_NAMES))
    copied = F.lit(False) if is_crosspost is None or duplicate_of is None else is_crosspost & duplicate_of.isNotNull()
    question = trimmed.rlike(r"\?\s*$")
    opinion = F.lower(trimmed).rlike("|".join(SENTIMENT_MARKERS))  # anywhere, also within words: "loved" counts
    return (
        F.when(author.isNull(), "no_author_deleted_or_removed")
        .when(bot, "bot_author")
        .when(copied, "crosspost_duplicate")
        .when(is_reply & (F.length(trimmed) < MIN_REPLY) & ~mentions, "very_short_reply_no_entity")
        .when(~mentions & ~question & ~opinion, "generic_no_entity_no_question_no_sentiment")
        .otherwise("kept")
    )


def is_junk(text: Column, author: Column) -> Column:
    """Automatic, removed or nearly empty text."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    prefixed = F.lit(False)
    for p in JUNK_PREFIXES:
        prefixed = prefixed | low.startswith(p)
    return F.coalesce(author == "AutoModerator", F.lit(False)) | (F.length(low) < MIN_TEXT) | low.isin("[removed]", "[deleted]") | prefixed


def blocklist(rows: DataFrame, text_col: str, blocked: DataFrame, pattern_col: str, *, vectors: tuple[str, str] | None = None, limit: float = 0.92) -> DataFrame:
    """Drops rows whose canonical text is blocked, and with ``vectors`` those too similar to a blocked pattern.

    Patterns are a stated set that all rows are held against: in blocks of ``BLOCK``, each broadcast, and each
    sifting what those before it left.
    """
    canonical = lambda c: F.lower(F.trim(c))
    exact = blocked.select(canonical(F.col(pattern_col)).alias("__blocked")).distinct()
    kept = rows.join(exact, canonical(F.col(text_col)) == F.col("__blocked"), "left_anti")
    if vectors is None:
        return kept
    from tiergraph.operators.vectors import cosine

    patterns = blocked.select(F.col(vectors[1]).alias("__pattern")).where("__pattern is not null").distinct()
    for block in in_blocks(patterns, BLOCK):
        kept = kept.join(F.broadcast(block), cosine(F.col(vectors[0]), F.col("__pattern")) > limit, "left_anti")
    return kept
