"""Recall from the graph for one entity: its claims, the posts behind them, who they are resolved to, tiers and clusters of documents.

``ids`` are the handful of ids that mean one entity (its closure); what is recalled stays a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _refers(ids: list[str]) -> Column:
    """Whether a node's properties hold any of the ids."""
    return reduce(Column.__or__, [F.contains("properties_json", F.lit(i)) for i in ids], F.lit(False))


def official_claims(nodes: DataFrame, ids: list[str], *, limit: int | None = 50) -> DataFrame:
    """(id) of the L1 claims whose properties hold any of the ids, the least ids first."""
    found = nodes.where((F.col("label") == "Claim") & (F.col("source_tier") == "L1") & _refers(ids)).select("id")
    return found if limit is None else found.orderBy("id").limit(limit)


def claimed_posts(nodes: DataFrame, edges: DataFrame, ids: list[str], *, extracted: str = "EXTRACTED_FROM") -> DataFrame:
    """(id) of the posts behind the claims that were resolved to any of the ids."""
    claims = nodes.where((F.col("label") == "Claim") & _refers(ids)).select(F.col("id").alias("from_id"))
    return edges.where(F.col("label") == extracted).join(claims, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()


def schools_named(nodes: DataFrame, text: str, *, label: str = "School", limit: int | None = 5) -> DataFrame:
    """(id) of the schools whose id or properties hold a word of the text of more than three letters."""
    words = [w for w in (text or "").lower().split() if len(w) > 3]
    held = lambda w: F.contains(F.lower("id"), F.lit(w)) | F.coalesce(F.contains(F.lower("properties_json"), F.lit(w)), F.lit(False))
    found = nodes.where(reduce(Column.__or__, map(held, words), F.lit(False)) & (F.col("label") == label)).select("id")
    return found if limit is None else found.orderBy("id").limit(limit)


def node_properties(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, properties) of nodes as a map; missing and unreadable ones are empty."""
    kind = "map<string,string>"
    read = F.coalesce(F.from_json("properties_json", kind), F.create_map().cast(kind))
    return ids.select("id").distinct().join(nodes.select("id", read.alias("properties")), "id", "left").select("id", F.coalesce("properties", F.create_map().cast(kind)).alias("properties"))


def post_tiers(nodes: DataFrame, *, labels: tuple[str, ...] = ("Post", "Comment")) -> DataFrame:
    """(id, source_tier) of documents."""
    return nodes.where(F.col("label").isin(*labels)).select("id", "source_tier")


def post_clusters(edges: DataFrame, *, member: str = "IN_CLUSTER") -> DataFrame:
    """(id, cluster_id): a document's cluster; of several the least."""
    return edges.where(F.col("label") == member).groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("cluster_id"))


# Prefixes of ids that are canonical already, and the properties that a node's text is made of.
CANONICAL = ("school", "specialty", "institution", "program")
TEXTS = ("title", "body", "name", "topic_label", "description")


def canonical_subjects(claims: DataFrame, aliases: DataFrame, *, subject_col: str = "subject_id") -> DataFrame:
    """Claims whose subject is a canonical id where an alias (alias, entity_id) says so: as it stands, trimmed, or in any case, in this order; else it stays.

    Of several entities of one alias the least id counts.
    """
    subjects = claims.select(F.col(subject_col).alias("s")).where("s is not null and s <> ''").distinct()
    open_ = subjects.where(~((F.instr("s", ":") > 0) & F.substring_index("s", ":", 1).isin(*CANONICAL)))
    asked = open_.select("s", F.explode(F.array(F.struct(F.lit(1).alias("way"), F.col("s").alias("key")), F.struct(F.lit(2).alias("way"), F.trim("s").alias("key")), F.struct(F.lit(3).alias("way"), F.lower(F.trim("s")).alias("key")))).alias("a")).select("s", "a.*")
    plain = aliases.where(F.col("alias").isNotNull()).select(F.explode(F.array(F.struct(F.lit(False).alias("low"), F.col("alias").alias("key")), F.struct(F.lit(True).alias("low"), F.lower("alias").alias("key")))).alias("k"), "entity_id").select("k.*", "entity_id")
    known = plain.groupBy("low", "key").agg(F.min("entity_id").alias("entity_id"))
    met = asked.withColumn("low", F.col("way") == 3).join(known, ["low", "key"]).groupBy("s").agg(F.min_by("entity_id", "way").alias("__canonical"))
    own = claims.withColumn("__s", F.col(subject_col)).join(met.withColumnRenamed("s", "__s"), "__s", "left")
    return own.withColumn(subject_col, F.coalesce("__canonical", subject_col)).select(*claims.columns)


def node_texts(nodes: DataFrame) -> DataFrame:
    """(id, text): a node's id and its textual properties, in order; what its vector and postings are made of."""
    parts = [F.nullif(F.get_json_object("properties_json", f"$.{x}"), F.lit("")) for x in TEXTS]
    return nodes.select("id", F.concat_ws(" ", "id", *parts).alias("text"))


def canonical_entity(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(root, id, source_tier): of what is the same as a root the node of the best tier; ties by id."""
    tiered = closure.join(nodes.select("id", "source_tier"), "id")
    return tiered.groupBy("root").agg(F.min(F.struct("source_tier", "id")).alias("m")).select("root", "m.id", "m.source_tier")


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, in the order they came."""
    least = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return least.select("r.*")
