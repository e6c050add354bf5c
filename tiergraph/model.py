"""The data model: nodes and edges with a trust tier and two time axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tiers, their weights, rank weights.
TIERS = ("L1", "L2", "L3", "L4", "L5")
TIER_WEIGHTS = {"L1": 1.0, "L2": 0.85, "L3": 0.7, "L4": 0.55, "L5": 0.4}
RANK_WEIGHTS = {"preferred": 1.0, "normal": 0.5, "deprecated": 0.0}
#: Weights of what is in neither table, and the ordinal of an unknown tier.
OTHER_TIER_WEIGHT, OTHER_RANK_WEIGHT, OTHER_ORDINAL = 0.4, 0.5, 99

# What each level of detail shows.
LEVEL_NODES = {
    "A": ("User", "Post", "Comment", "Thread", "SDNThread", "Subreddit", "SDNCategory"),
    "B": ("Topic", "Cluster"),
}
LEVEL_EDGES = {
    "A": ("AUTHORED", "COMMENTED", "REPLIED_TO", "BELONGS_TO_THREAD", "POSTED_IN_FORUM", "UPVOTED", "MENTIONS_SCHOOL", "MENTIONS_PROGRAM"),
    "B": ("IN_CLUSTER", "REFERENCES_TOPIC"),
}

NODE_SCHEMA = "id string, label string, source_tier string, properties_json string"
EDGE_SCHEMA = (
    "id string, label string, from_id string, to_id string, source_tier string, rank string, references array<string>, qualifiers map<string,string>, "
    "t_valid_from timestamp, t_valid_to timestamp, t_ingest_from timestamp, t_ingest_to timestamp, confidence double"
)


def lookup(values: dict[str, float], key: Column, other: float | None) -> Column:
    """A small table of values as a CASE."""
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other)) if other is not None else out


def tier_ordinal(tier: Column) -> Column:
    """L1 is 1; an unknown or null tier counts as 99."""
    return lookup({t: i + 1 for i, t in enumerate(TIERS)}, tier, OTHER_ORDINAL)


def tier_weight(tier: Column) -> Column:
    return lookup(TIER_WEIGHTS, tier, OTHER_TIER_WEIGHT)


def rank_weight(rank: Column) -> Column:
    return lookup(RANK_WEIGHTS, F.coalesce(rank, F.lit("normal")), OTHER_RANK_WEIGHT)


def properties(json: Column, key: str) -> Column:
    """A property; null for null or corrupt JSON."""
    return F.get_json_object(json, f"$.{key}")


def empty_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NODE_SCHEMA)


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGE_SCHEMA)


def make_edges(rows: DataFrame, label: str, tier: str, from_id: Column, to_id: Column, *, id: Column | None = None, rank: str = "normal", references: Column | None = None, qualifiers: Column | None = None, valid: tuple[Column | None, Column | None] = (None, None), ingest: tuple[Column | None, Column | None] = (None, None), confidence: Column | None = None) -> DataFrame:  # noqa: A002
    """Rows projected onto the edge columns."""
    time = lambda c: (F.lit(None) if c is None else c).cast("timestamp")
    return rows.select(
        (id if id is not None else F.concat_ws("|", F.lit(label), from_id, to_id)).alias("id"), F.lit(label).alias("label"), from_id.alias("from_id"), to_id.alias("to_id"), F.lit(tier).alias("source_tier"), F.lit(rank).alias("rank"),
        (references if references is not None else F.array().cast("array<string>")).alias("references"), (qualifiers if qualifiers is not None else F.create_map().cast("map<string,string>")).alias("qualifiers"),
        time(valid[0]).alias("t_valid_from"), time(valid[1]).alias("t_valid_to"), time(ingest[0]).alias("t_ingest_from"), time(ingest[1]).alias("t_ingest_to"), (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("confidence"),
    )


def make_nodes(rows: DataFrame, label: str, tier: str | Column, id: Column, properties: Column) -> DataFrame:  # noqa: A002
    """Rows projected onto the node columns; ``properties`` is a struct."""
    return rows.select(id.alias("id"), F.lit(label).alias("label"), (F.lit(tier) if isinstance(tier, str) else tier).alias("source_tier"), F.to_json(properties).alias("properties_json"))
