"""The benchmark tables in terms of the data model, for queries and their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.model import make_edges, make_nodes

NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS label, 'L1' AS source_tier, r_name AS name FROM region UNION ALL
  SELECT 'nation:' || n_nationkey, 'Nation', 'L1', n_name FROM nation UNION ALL
  SELECT 'supplier:' || s_suppkey, 'Supplier', 'L2', s_name FROM supplier UNION ALL
  SELECT 'part:' || p_partkey, 'Part', 'L2', p_name FROM part UNION ALL
  SELECT 'page:' || page_id, 'Page', 'L2', url FROM pages UNION ALL
  SELECT 'order:' || o_orderkey, 'Order', 'L3', o_orderpriority FROM orders UNION ALL
  SELECT 'customer:' || c_custkey, 'Customer', 'L4', c_name FROM customer UNION ALL
  SELECT 'document:' || doc_id, 'Post', 'L5', source FROM documents UNION ALL
  SELECT DISTINCT 'source:' || source, 'Subreddit', 'L5', source FROM documents UNION ALL
  SELECT 'turn:' || conv_id || '_' || turn, 'Comment', 'L5', role FROM conversations UNION ALL
  SELECT DISTINCT 'thread:' || conv_id, 'Thread', 'L5', 'thread' FROM conversations)"""

EDGES_SQL = """edges AS (
  SELECT 'IN_REGION' AS label, 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 'L1' AS source_tier, NULL::TIMESTAMP AS t_valid_from, NULL::TIMESTAMP AS t_ingest_from FROM nation UNION ALL
  SELECT 'IN_NATION', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'L2', NULL, NULL FROM supplier UNION ALL
  SELECT 'IN_NATION', 'customer:' || c_custkey, 'nation:' || c_nationkey, 'L2', NULL, NULL FROM customer UNION ALL
  SELECT 'PLACED', 'customer:' || o_custkey, 'order:' || o_orderkey, 'L3', o_orderdate, NULL FROM orders UNION ALL
  SELECT 'CONTAINS', 'order:' || l_orderkey, 'part:' || l_partkey, 'L3', NULL, l_shipdate FROM lineitem UNION ALL
  SELECT 'SUPPLIED_BY', 'part:' || l_partkey, 'supplier:' || l_suppkey, 'L2', NULL, l_shipdate FROM lineitem UNION ALL
  SELECT 'BELONGS_TO_THREAD', 'turn:' || conv_id || '_' || turn, 'thread:' || conv_id, 'L5', NULL, NULL FROM conversations UNION ALL
  SELECT 'POSTED_IN_FORUM', 'document:' || doc_id, 'source:' || source, 'L5', NULL, NULL FROM documents)"""

CLAIMS_SQL = """claims AS (
  SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS claim_id, 'part:' || l_partkey AS subject_id, 'tuition' AS predicate,
         CAST(CAST(round(l_extendedprice / l_quantity / 100, 0) AS BIGINT) AS VARCHAR) AS object_value, 'L' || (l_suppkey % 5 + 1) AS source_tier,
         round(l_discount * 10, 2) AS credibility, l_shipdate AS t_valid_from
  FROM lineitem WHERE l_partkey % 20 = 0)"""


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its zoneless timestamps as timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def key(prefix: str, *columns: str):
    return F.concat(F.lit(prefix + ":"), F.concat_ws("_", *[F.col(c).cast("string") for c in columns]))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the entity tables as a node; what a query doesn't need, column pruning leaves unread."""
    rows = (("region", "Region", "L1", ["r_regionkey"], "r_name"), ("nation", "Nation", "L1", ["n_nationkey"], "n_name"), ("supplier", "Supplier", "L2", ["s_suppkey"], "s_name"), ("part", "Part", "L2", ["p_partkey"], "p_name"), ("orders", "Order", "L3", ["o_orderkey"], "o_orderpriority"), ("customer", "Customer", "L4", ["c_custkey"], "c_name"))
    prefix = {"orders": "order"}
    out = None
    for name, label, tier, keys, title in rows:
        some = make_nodes(t(spark, sf_dir, name), label, tier, key(prefix.get(name, name), *keys), F.struct(F.col(title).alias("name")))
        out = some if out is None else out.unionByName(some)
    docs, turns = t(spark, sf_dir, "documents"), t(spark, sf_dir, "conversations")
    out = out.unionByName(make_nodes(t(spark, sf_dir, "pages"), "Page", "L2", key("page", "page_id"), F.struct(F.col("url").alias("name"))))
    out = out.unionByName(make_nodes(docs, "Post", "L5", key("document", "doc_id"), F.struct(F.col("source").alias("name"))))
    out = out.unionByName(make_nodes(docs.select("source").distinct(), "Subreddit", "L5", key("source", "source"), F.struct(F.col("source").alias("name"))))
    out = out.unionByName(make_nodes(turns, "Comment", "L5", key("turn", "conv_id", "turn"), F.struct(F.col("role").alias("name"))))
    return out.unionByName(make_nodes(turns.select("conv_id").distinct(), "Thread", "L5", key("thread", "conv_id"), F.struct(F.lit("thread").alias("name"))))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t(spark, sf_dir, "lineitem")
    ship = (F.col("l_shipdate"), None)
    four = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    parts = [
        make_edges(t(spark, sf_dir, "nation"), "IN_REGION", "L1", key("nation", "n_nationkey"), key("region", "n_regionkey")),
        make_edges(t(spark, sf_dir, "supplier"), "IN_NATION", "L2", key("supplier", "s_suppkey"), key("nation", "s_nationkey")),
        make_edges(t(spark, sf_dir, "customer"), "IN_NATION", "L2", key("customer", "c_custkey"), key("nation", "c_nationkey")),
        make_edges(t(spark, sf_dir, "orders"), "PLACED", "L3", key("customer", "o_custkey"), key("order", "o_orderkey"), valid=(F.col("o_orderdate"), None)),
        make_edges(line, "CONTAINS", "L3", key("order", "l_orderkey"), key("part", "l_partkey"), id=F.concat(F.lit("CONTAINS|"), four), ingest=ship),
        make_edges(line, "SUPPLIED_BY", "L2", key("part", "l_partkey"), key("supplier", "l_suppkey"), id=F.concat(F.lit("SUPPLIED_BY|"), four), ingest=ship),
        make_edges(t(spark, sf_dir, "conversations"), "BELONGS_TO_THREAD", "L5", key("turn", "conv_id", "turn"), key("thread", "conv_id")),
        make_edges(t(spark, sf_dir, "documents"), "POSTED_IN_FORUM", "L5", key("document", "doc_id"), key("source", "source")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of every twentieth part as claims; claim_id is their place by the four-column key."""
    from pyspark.sql import Window

    line = t(spark, sf_dir, "lineitem").where("l_partkey % 20 = 0")
    order = Window.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.select(
        F.row_number().over(order).cast("long").alias("claim_id"), key("part", "l_partkey").alias("subject_id"), F.lit("tuition").alias("predicate"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100, 0).cast("long").cast("string").alias("object_value"), F.concat(F.lit("L"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("source_tier"),
        F.round(F.col("l_discount") * 10, 2).alias("credibility"), F.col("l_shipdate").alias("t_valid_from"), F.lit(None).cast("timestamp").alias("t_valid_to"),
    )
