"""Queries over the benchmark tables, one an operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.functions import scoring, stats, text, url
from tiergraph.model import make_nodes, tier_ordinal
from tiergraph.operators import conflict, dashboards, filters, graph, recall, retrieval, vectors
from tiergraph.operators.lexical_index import LexicalIndex, build_index
from tiergraph.plans.synthetic import CLAIMS_SQL, EDGES_SQL, NODES_SQL, claims, edges, key, nodes, t
from tiergraph.runtime import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = datetime(2000, 1, 1)
NOW_SQL = "TIMESTAMP '2000-01-01'"
ORDINAL_SQL = "CASE source_tier WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 WHEN 'L3' THEN 3 WHEN 'L4' THEN 4 WHEN 'L5' THEN 5 ELSE 99 END"
WEIGHT_SQL = "CASE source_tier WHEN 'L1' THEN 1.0::DOUBLE WHEN 'L2' THEN 0.85 WHEN 'L3' THEN 0.7 WHEN 'L4' THEN 0.55 ELSE 0.4 END"
TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Graph


@query("q01_counts_by_label", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'node' AS kind, label, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', label, count(*) FROM edges GROUP BY label")
def q01(spark, d):
    n = nodes(spark, d).groupBy("label").count().select(F.lit("node").alias("kind"), "label", F.col("count").alias("n"))
    return n.unionByName(edges(spark, d).groupBy("label").count().select(F.lit("edge").alias("kind"), "label", F.col("count").alias("n")))


@query("q02_tier_filter", f"WITH {NODES_SQL} SELECT label, source_tier, {ORDINAL_SQL} AS ordinal, count(*) AS n FROM nodes WHERE {ORDINAL_SQL} <= 3 GROUP BY ALL")
def q02(spark, d):
    kept = nodes(spark, d).where(filters.tier_passes(F.col("source_tier"), "L3"))
    return kept.groupBy("label", "source_tier", tier_ordinal(F.col("source_tier")).alias("ordinal")).agg(F.count("*").alias("n"))


AS_OF = datetime(1996, 6, 1)


@query("q03_as_of", f"WITH {EDGES_SQL} SELECT label, count(*) AS n FROM edges WHERE t_ingest_from IS NULL OR t_ingest_from <= TIMESTAMP '1996-06-01' GROUP BY label")
def q03(spark, d):
    return edges(spark, d).where(filters.edge_passes(as_of=AS_OF)).groupBy("label").agg(F.count("*").alias("n"))


@query("q04_time_range", f"WITH {EDGES_SQL} SELECT label, source_tier, count(*) AS n FROM edges WHERE {ORDINAL_SQL} <= 3 AND (t_valid_from IS NULL OR NOT t_valid_from > TIMESTAMP '1995-12-31') GROUP BY ALL")
def q04(spark, d):
    kept = edges(spark, d).where(filters.edge_passes(tier_min="L3", time_range=(datetime(1995, 1, 1), datetime(1995, 12, 31))))
    return kept.groupBy("label", "source_tier").agg(F.count("*").alias("n"))


@query("q05_supersede", "SELECT event_id, user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS since, CAST(epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS BIGINT) AS until FROM events")
def q05(spark, d):
    versions = graph.supersede(t(spark, d, "events"), ["user_id", "event_type"], "ts", tie="event_id")
    return versions.select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("since"), F.unix_micros("t_ingest_to").alias("until"))


@query("q06_tier_as_of", "WITH v AS (SELECT user_id, event_type, value, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS until FROM events), m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS noon FROM events) SELECT user_id, event_type, round(value, 4) AS value FROM v, (SELECT date_trunc('day', noon) AS noon FROM m) WHERE ts <= noon AND (until IS NULL OR until > noon)")
def q06(spark, d):
    """What stood at noon of the log, in whole days."""
    ev = t(spark, d, "events")
    low, high = ev.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    day = 86_400_000_000
    at = F.timestamp_micros(F.lit((low + (high - low) // 2) // day * day))
    versions = graph.supersede(ev, ["user_id", "event_type"], "ts", tie="event_id")
    return versions.where(filters.visible_at(at, "ts", "t_ingest_to")).select("user_id", "event_type", F.round("value", 4).alias("value"))


@query("q07_neighbours", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'out' AS direction, e.label, e.from_id, e.to_id, n.id AS neighbour_id, n.label AS neighbour_label FROM edges e JOIN nodes n ON n.id = e.to_id WHERE e.from_id IN ('nation:3', 'nation:7') UNION ALL SELECT 'in', e.label, e.from_id, e.to_id, n.id, n.label FROM edges e JOIN nodes n ON n.id = e.from_id WHERE e.to_id IN ('nation:3', 'nation:7')")
def q07(spark, d):
    anchors = spark.createDataFrame([("nation:3",), ("nation:7",)], "id string")
    return graph.neighbours(edges(spark, d), nodes(spark, d), anchors, direction="both").select("direction", "label", "from_id", "to_id", "neighbour_id", "neighbour_label")


@query("q08_three_hops", "SELECT 'nation:' || c_nationkey AS nation, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q08(spark, d):
    e = edges(spark, d).select("label", "from_id", "to_id")
    hop = lambda name, a, b: e.where(F.col("label") == name).select(F.col("from_id").alias(a), F.col("to_id").alias(b))
    home = hop("IN_NATION", "customer", "nation").where(F.startswith("customer", F.lit("customer:")))
    line = t(spark, d, "lineitem").select(key("order", "l_orderkey").alias("order"), key("part", "l_partkey").alias("part"), key("supplier", "l_suppkey").alias("supplier"))
    met = home.join(hop("PLACED", "customer", "order"), "customer").join(line, "order")
    return met.groupBy("nation").agg(F.countDistinct("order").alias("orders"), F.countDistinct("part").alias("parts"), F.countDistinct("supplier").alias("suppliers"))


@query("q09_levels", f"WITH {NODES_SQL}, {EDGES_SQL}, l AS (SELECT 'A' AS level, 'node' AS kind, label FROM nodes WHERE label IN ('Post', 'Comment', 'Thread', 'Subreddit') UNION ALL SELECT 'C', 'node', label FROM nodes UNION ALL SELECT 'A', 'edge', label FROM edges WHERE label IN ('BELONGS_TO_THREAD', 'POSTED_IN_FORUM') UNION ALL SELECT 'C', 'edge', label FROM edges) SELECT level, kind, count(*) AS n FROM l GROUP BY ALL")
def q09(spark, d):
    out = None
    for level in "AC":
        for kind, rows in (("node", filters.nodes_at_level(nodes(spark, d), level)), ("edge", filters.edges_at_level(edges(spark, d), level))):
            one = rows.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("level", "kind").agg(F.count("*").alias("n"))


@query(
    "q10_query_graph",
    f"""WITH {NODES_SQL}, {EDGES_SQL},
seeds AS (SELECT id FROM nodes WHERE (contains(lower(id), 'supplier:7') OR contains(lower('{{"name":"' || name || '"}}'), 'supplier:7')) AND {ORDINAL_SQL} <= 3),
e AS (SELECT from_id, to_id, label FROM edges WHERE {ORDINAL_SQL} <= 3 AND (t_ingest_from IS NULL OR t_ingest_from <= TIMESTAMP '1996-06-01')),
h1 AS (SELECT to_id AS id, 1 AS hop, min(from_id || chr(1) || label) AS m FROM e WHERE from_id IN (SELECT id FROM seeds) AND to_id NOT IN (SELECT id FROM seeds) GROUP BY to_id),
h2 AS (SELECT to_id AS id, 2 AS hop, min(from_id || chr(1) || label) AS m FROM e WHERE from_id IN (SELECT id FROM h1) AND to_id NOT IN (SELECT id FROM seeds UNION SELECT id FROM h1) GROUP BY to_id),
r AS (SELECT id, 0 AS hop, NULL AS m FROM seeds UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)
SELECT r.id, n.label, n.source_tier, r.hop, split_part(m, chr(1), 1) AS last_from, split_part(m, chr(1), 2) AS last_label, round({WEIGHT_SQL} * 0.5, 6) AS score
FROM r JOIN nodes n ON r.id = n.id WHERE {ORDINAL_SQL} <= 3 ORDER BY score DESC, hop, r.id LIMIT 50""",
)
def q10(spark, d):
    """The flagship: seeds by substring, two hops through what was known and trusted then, ranked."""
    return graph.query_graph(edges(spark, d), nodes(spark, d), "supplier:7", tier_min="L3", as_of=AS_OF, depth=2, limit=50, now=NOW)


SAME_SQL = "same AS (SELECT 'SAME_AS|supplier:' || s_suppkey || '|customer:' || c_custkey AS id, 'supplier:' || s_suppkey AS from_id, 'customer:' || c_custkey AS to_id FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey)"


def same_as(spark, d):
    from tiergraph.model import make_edges

    both = t(spark, d, "supplier").join(t(spark, d, "customer"), (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return make_edges(both, "SAME_AS", "L2", key("supplier", "s_suppkey"), key("customer", "c_custkey"))


@query("q11_crosslinks", f"WITH {SAME_SQL} SELECT id AS edge_id, from_id AS node_id, to_id AS other_id, 'Supplier' AS label, 'L2' AS source_tier FROM same UNION ALL SELECT id, to_id, from_id, 'Customer', 'L4' FROM same")
def q11(spark, d):
    return graph.crosslinks(same_as(spark, d), nodes(spark, d)).drop("confidence")


@query(
    "q12_components",
    """WITH RECURSIVE l AS (SELECT DISTINCT s_suppkey % 97 AS a, s_suppkey % 89 + 1000 AS b FROM supplier WHERE s_suppkey % 3 = 0), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, component) AS (SELECT a, a FROM b UNION SELECT b.b, c.component FROM c JOIN b ON b.a = c.id) SELECT CAST(id AS BIGINT) AS id, CAST(min(component) AS BIGINT) AS component FROM c GROUP BY id""",
)
def q12(spark, d):
    links = t(spark, d, "supplier").where("s_suppkey % 3 = 0").select((F.col("s_suppkey") % 97).alias("a"), (F.col("s_suppkey") % 89 + 1000).alias("b")).distinct()
    return graph.components(links)


@query("q12b_same_as_closure", f"WITH {SAME_SQL} SELECT from_id AS root, from_id AS id FROM same UNION SELECT from_id, to_id FROM same")
def q12b(spark, d):
    same = same_as(spark, d)
    return graph.same_as_closure(same, same.select(F.col("from_id").alias("id"))).select("root", "id")


@query("q12c_anchored_recall", "WITH p AS (SELECT DISTINCT 'turn:' || conv_id || '_' || turn AS id, 'thread:' || conv_id AS thread FROM conversations WHERE role = 'user' AND conv_id % 50 = 0), m AS (SELECT DISTINCT 'turn:' || conv_id || '_' || turn AS id FROM conversations WHERE 'thread:' || conv_id IN (SELECT thread FROM p)) SELECT 'entities' AS stage, 1::BIGINT AS n UNION ALL SELECT 'mentions', count(*) FROM p UNION ALL SELECT 'threads', count(DISTINCT thread) FROM p UNION ALL SELECT 'members', count(*) FROM m")
def q12c(spark, d):
    from tiergraph.model import make_edges

    turns = t(spark, d, "conversations")
    mentions = make_edges(turns.where("role = 'user' and conv_id % 50 = 0"), "MENTIONS_SCHOOL", "L5", key("turn", "conv_id", "turn"), F.lit("school:x"))
    every = mentions.unionByName(make_edges(turns, "BELONGS_TO_THREAD", "L5", key("turn", "conv_id", "turn"), key("thread", "conv_id")))
    return graph.anchored_recall(every, spark.createDataFrame([("school:x",)], "id string")).groupBy("stage").agg(F.count("*").alias("n"))


@query("q12d_graph_candidates", "WITH f AS (SELECT doc_id, 'long' AS source FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'english' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) SELECT array_to_string(sources, ',') AS sources, count(*) AS n FROM (SELECT doc_id, list_sort(list(DISTINCT source)) AS sources FROM f GROUP BY doc_id) GROUP BY 1")
def q12d(spark, d):
    docs = t(spark, d, "documents")
    found = graph.candidates({"long": docs.where("n_chars > 3000"), "english": docs.where("lang = 'en'"), "toxic": t(spark, d, "labels").where("toxic = 1")})
    return found.groupBy(F.array_join("sources", ",").alias("sources")).agg(F.count("*").alias("n"))


# Scores and conflicts

HALF_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 182.0 WHEN '5-LOW' THEN 730.0 ELSE 365.0 END"


@query("q13_decay", f"SELECT o_orderkey, CASE WHEN o_orderdate >= {NOW_SQL} THEN 1.0 ELSE round(power(2.0, -(epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE / {HALF_SQL}), 8) END AS decay FROM orders")
def q13(spark, d):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "opinion_sentiment").when(F.col("o_orderpriority") == "5-LOW", "avg_DAT").otherwise("tuition")
    return t(spark, d, "orders").select("o_orderkey", F.round(scoring.decay(F.lit(NOW), F.col("o_orderdate"), kind), 8).alias("decay"))


@query("q14_ranking_score", f"SELECT o_orderkey, round(0.7::DOUBLE * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END * CASE WHEN o_orderdate >= {NOW_SQL} THEN 1.0 ELSE power(2.0, -(epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE / 365.0) END * greatest(0.0, o_totalprice / 500000.0), 6) AS score FROM orders")
def q14(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", "preferred").when(F.col("o_orderstatus") == "O", "normal").otherwise("deprecated")
    s = scoring.ranking_score(F.lit("L3"), rank, scoring.decay(F.lit(NOW), F.col("o_orderdate"), F.lit("tuition")), F.col("o_totalprice") / 500000.0, F.lit(1.0))
    return t(spark, d, "orders").select("o_orderkey", F.round(s, 6).alias("score"))


@query("q15_consistency", f"WITH {CLAIMS_SQL}, m AS (SELECT subject_id, object_value, sum(CAST(round({WEIGHT_SQL} * 100) AS BIGINT) * CAST(round(credibility * 100) AS BIGINT)) AS mass FROM claims GROUP BY ALL), s AS (SELECT subject_id, sum(mass) AS total FROM m GROUP BY 1) SELECT claim_id, CASE WHEN total > 0 THEN round(mass / total, 5) ELSE 1.0 END AS consistency FROM claims JOIN m USING (subject_id, object_value) JOIN s USING (subject_id)")
def q15(spark, d):
    return conflict.consistency(claims(spark, d)).select("claim_id", F.round("consistency", 5).alias("consistency"))


CASCADE_SQL = f"""WITH {CLAIMS_SQL}, newest AS (SELECT subject_id, max(claim_id) AS nid FROM claims GROUP BY 1),
j AS (SELECT c.*, n.claim_id AS nid, n.object_value AS nv, n.source_tier AS nt, n.credibility AS nc FROM claims c JOIN newest USING (subject_id) JOIN claims n ON n.claim_id = newest.nid),
g AS (SELECT subject_id, any_value(nid) AS nid, any_value(nv) AS nv, any_value(nt) AS nt, any_value(nc) AS nc, count(*) FILTER (WHERE claim_id <> nid) AS n, count(*) FILTER (WHERE claim_id <> nid AND source_tier = nt) AS same,
  min(claim_id) FILTER (WHERE claim_id <> nid AND source_tier = 'L1') AS l1, arg_min(object_value, claim_id) FILTER (WHERE claim_id <> nid AND source_tier <> 'L1') AS other, max(credibility) FILTER (WHERE claim_id <> nid) AS best FROM j GROUP BY subject_id)
SELECT CASE WHEN n = 0 THEN 'no_conflict' WHEN (l1 IS NOT NULL AND nt <> 'L1') OR (nt = 'L1' AND other IS NOT NULL AND other <> nv) THEN 'l1_clash_invalidated' WHEN same = n AND nc <> best THEN 'trust_weighted' ELSE 'hitl_pending' END AS status, count(*) AS n FROM g GROUP BY 1"""


@query("q16_cascade", CASCADE_SQL)
def q16(spark, d):
    return conflict.cascade(claims(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "q17_joint",
    f"""WITH {CLAIMS_SQL}, d AS (SELECT *, CASE WHEN t_valid_from >= {NOW_SQL} THEN 1.0 ELSE power(2.0, -(epoch_us({NOW_SQL}) - epoch_us(t_valid_from)) / 86400000000.0::DOUBLE / 365.0) END AS dec FROM claims),
v AS (SELECT subject_id, object_value, round(sum(CASE WHEN source_tier = 'L1' THEN 3.0 ELSE {WEIGHT_SQL} END * dec * greatest(credibility, 0.05)), 6) AS mass, bool_or(source_tier = 'L1' AND dec >= 0.05) AS cur, bool_or(source_tier = 'L1') AS has FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(mass) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY subject_id ORDER BY mass DESC, object_value)),
g AS (SELECT subject_id, count(*) AS nv, count(*) FILTER (WHERE cur) AS nc, max(object_value) FILTER (WHERE cur) AS l1v, max(object_value) FILTER (WHERE place = 1) AS top, max(mass) FILTER (WHERE place = 1) AS m, max(coalesce(nxt, 0.0)) FILTER (WHERE place = 1) AS r, bool_or(has) FILTER (WHERE place > 1) AS lost FROM r GROUP BY 1),
s AS (SELECT *, CASE WHEN m > 0 THEN (m - r) / m ELSE 0.0 END AS margin FROM g),
o AS (SELECT *, CASE WHEN nv = 1 THEN 'no_conflict' WHEN nc > 1 THEN 'hitl_pending' WHEN nc = 1 THEN 'l1_clash_invalidated' WHEN margin < 0.1 THEN 'hitl_pending' ELSE 'trust_weighted' END AS status FROM s)
SELECT subject_id, status, CASE status WHEN 'l1_clash_invalidated' THEN l1v WHEN 'hitl_pending' THEN NULL ELSE top END AS winner_value,
  round(CASE WHEN status = 'l1_clash_invalidated' THEN 1.0 WHEN nv = 1 OR nc > 1 THEN 0.0 ELSE margin END, 4) AS margin, CASE WHEN status = 'trust_weighted' THEN coalesce(lost, false) ELSE status = 'hitl_pending' END AS low_confidence FROM o""",
)
def q17(spark, d):
    return conflict.joint(claims(spark, d), NOW).drop("predicate")


SIGNALS_SQL = "sig AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'supports' WHEN 'signup' THEN 'supports' WHEN 'error' THEN 'refutes' ELSE 'unknown' END AS verdict, round(value % 1, 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE place <= 3)"


@query(
    "q18_signals",
    f"""WITH {SIGNALS_SQL}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (verdict = 'unknown') AS u, max(confidence) AS most, count(*) FILTER (verdict = 'supports') AS s0, max(confidence) FILTER (verdict = 'supports') AS s1, sum(confidence) FILTER (verdict = 'supports') AS s2, count(*) FILTER (verdict = 'supports' AND confidence >= 0.7) AS s3,
count(*) FILTER (verdict = 'refutes') AS r0, max(confidence) FILTER (verdict = 'refutes') AS r1, sum(confidence) FILTER (verdict = 'refutes') AS r2, count(*) FILTER (verdict = 'refutes' AND confidence >= 0.7) AS r3 FROM sig GROUP BY 1),
p AS (SELECT *, s0 > r0 OR (s0 = r0 AND coalesce(s1, -1) >= coalesce(r1, -1)) AS sup FROM g), q AS (SELECT *, CASE WHEN sup THEN s0 ELSE r0 END AS c, CASE WHEN sup THEN s3 ELSE r3 END AS above, CASE WHEN sup THEN s2 ELSE r2 END / greatest(CASE WHEN sup THEN s0 ELSE r0 END, 1) AS av, s0 + r0 AS act FROM p)
SELECT user_id, CASE WHEN n <> 3 THEN 'disagreement' WHEN u = 3 THEN 'unknown' WHEN act < 2 THEN 'disagreement' WHEN c >= 2 AND above >= 2 THEN CASE WHEN sup THEN 'supports' ELSE 'refutes' END ELSE 'disagreement' END AS outcome,
round(CASE WHEN n <> 3 OR u = 3 THEN 0.0 WHEN act < 2 THEN most ELSE av END, 4) AS confidence, CASE WHEN n <> 3 THEN true WHEN u = 3 THEN false WHEN act < 2 OR NOT (c >= 2 AND above >= 2) THEN true ELSE c < act OR av < 0.7 END AS low_confidence FROM q""",
)
def q18(spark, d):
    from pyspark.sql import Window

    placed = t(spark, d, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("place <= 3")
    verdict = F.when(F.col("event_type").isin("purchase", "signup"), "supports").when(F.col("event_type") == "error", "refutes").otherwise("unknown")
    return conflict.combine_signals(placed.select("user_id", verdict.alias("verdict"), F.round(F.col("value") % 1, 2).alias("confidence")), ["user_id"])


@query(
    "q19_credibility",
    f"""WITH a AS (SELECT c_custkey, count(o_orderkey) AS posts, coalesce(sum(o_totalprice), 0.0) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
f AS (SELECT *, coalesce(CAST(epoch_us({NOW_SQL}) - epoch_us(first) AS DOUBLE) / 86400000000.0 / 365.0, 0.0) AS age, coalesce(greatest(0.0, CAST(epoch_us({NOW_SQL}) - epoch_us(last) AS DOUBLE) / 86400000000.0 / 30.0), 0.0) AS idle FROM a),
r AS (SELECT c_custkey, idle, 0.1 * ln(1 + least(posts, 1000)::DOUBLE) / ln(1001.0::DOUBLE) + 0.15 * ln(1 + greatest(0.0, least(total, 50000.0))) / ln(50001.0::DOUBLE) + 0.1 * greatest(0.0, least(1.0, age / 2.0)) AS raw FROM f)
SELECT c_custkey, round(raw, 5) AS raw_score, round(greatest(0.0, least(1.0, raw)) * power(2.0, -idle / 12.0), 5) AS credibility FROM r""",
)
def q19(spark, d):
    orders = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("post_count"), F.sum("o_totalprice").alias("upvote_total"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    users = t(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    days = lambda c: scoring.age_days(F.lit(NOW).cast("timestamp"), F.col(c))
    users = users.withColumns({"account_age_years": days("first") / 365.0, **{c: F.lit(0.0) for c in ("comment_count", "comment_to_post_ratio", "on_topic_ratio", "sockpuppet_penalty", "gilded_count", "prescient_correct_count")}})
    raw, cred = scoring.credibility(scoring.FORUM_RUBRIC, days("last") / 30.0)
    return users.select("c_custkey", F.round(raw, 5).alias("raw_score"), F.round(cred, 5).alias("credibility"))


# Filters and text


@query("q20_utility_filter", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN role = 'system' THEN 'no_author_deleted_or_removed' WHEN turn > 0 AND length(trim(text)) < 20 THEN 'very_short_reply_no_entity' WHEN NOT regexp_matches(trim(text), '\\?\\s*$') AND NOT list_bool_or(list_transform(['good', 'bad', 'great', 'awful', 'love', 'hate', 'best', 'worst', 'recommend', 'avoid', 'amazing', 'terrible'], lambda m: contains(lower(trim(text)), m))) THEN 'generic_no_entity_no_question_no_sentiment' ELSE 'kept' END AS reason FROM conversations) GROUP BY 1")
def q20(spark, d):
    reason = filters.utility_reason(F.col("text"), F.when(F.col("role") != "system", F.col("role")), F.col("turn") > 0)
    return t(spark, d, "conversations").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("q21_junk", "SELECT source, count(*) FILTER (junk) AS n_junk, count(*) AS n FROM (SELECT source, length(lower(trim(text))) < 15 OR lower(trim(text)) IN ('[removed]', '[deleted]') OR " + " OR ".join(f"starts_with(lower(trim(text)), '{p}')" for p in filters.JUNK_PREFIXES) + " AS junk FROM documents) GROUP BY 1")
def q21(spark, d):
    junk = filters.is_junk(F.col("text"), F.col("source"))
    return t(spark, d, "documents").groupBy("source").agg(F.sum(junk.cast("long")).alias("n_junk"), F.count("*").alias("n"))


QUESTION = "the reed blehe inst"


@query("q22_census", f"SELECT source, count(*) AS n FROM documents WHERE list_has_any({TOKENS_SQL}, ['the', 'reed', 'blehe', 'inst']) GROUP BY 1")
def q22(spark, d):
    return retrieval.census(t(spark, d, "documents"), QUESTION, "text", "source")


_INDEXES: dict[tuple[str, str, bool], LexicalIndex] = {}


def lexical_index(spark: SparkSession, d: str, norms: bool = True) -> LexicalIndex:
    """The index of a folder's documents: built by the first query of a session that asks, as an index is, and read by all. Without norms it is smaller; one that has them serves as well."""
    at = (spark.sparkContext.applicationId, d)
    if (*at, norms) not in _INDEXES:
        held = _INDEXES.get((*at, True))
        _INDEXES[*at, norms] = held or build_index(t(spark, d, "documents"), scratch_path(spark, "index"), id_col="doc_id", text_col="text", norms=norms)
    return _INDEXES[*at, norms]


POSTINGS_SQL = f"p AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), h AS (SELECT doc_id, len(t) AS length, term, len(list_filter(t, lambda x: x = term)) AS tf FROM p, unnest(['blehe', 'inst', 'reed', 'the']) u(term))"


@query("q23_bm25", f"WITH {POSTINGS_SQL}, k AS (SELECT * FROM h WHERE tf > 0), n AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM p), df AS (SELECT term, count(*) AS df FROM k GROUP BY 1) SELECT doc_id AS id, round(sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM k JOIN df USING (term), n GROUP BY 1")
def q23(spark, d):
    return lexical_index(spark, d, norms=False).bm25(QUESTION)


TFIDF_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS t FROM documents),
g AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM w) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS docs FROM documents), i AS (SELECT term, ln((1.0 + docs) / (1.0 + count(*))) + 1.0 AS idf FROM g, n GROUP BY term, docs),
q AS (SELECT term, idf AS qw FROM i WHERE term IN ('the', 'reed', 'blehe', 'inst', 'the reed', 'reed blehe', 'blehe inst')), qn AS (SELECT sqrt(sum(qw * qw)) AS qnorm FROM q),
x AS (SELECT doc_id, (1 + ln(tf::DOUBLE)) * idf AS w, qw FROM g JOIN i USING (term) LEFT JOIN q USING (term)),
s AS (SELECT doc_id AS id, round(sum(w * qw) / (sqrt(sum(w * w)) * any_value(qnorm)), 6) AS score FROM x, qn GROUP BY doc_id HAVING sum(w * qw) > 0)"""


@query("q24_tfidf", f"WITH {TFIDF_SQL} SELECT * FROM s")
def q24(spark, d):
    return lexical_index(spark, d).tfidf(QUESTION)


AXIS = [((i * 37) % 11 - 5) / 10 for i in range(64)]
AXIS_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in AXIS) + "]"
DOT_SQL = f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {AXIS_SQL}[i]))"
NORM_SQL = f"(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({AXIS_SQL}, lambda x: x * x))))"


@query("q25_vector_top_k", f"SELECT vec_id, round({DOT_SQL} / {NORM_SQL}, 5) AS score FROM embeddings ORDER BY {DOT_SQL} / {NORM_SQL} DESC, vec_id LIMIT 20")
def q25(spark, d):
    return vectors.top_k(t(spark, d, "embeddings"), "embedding", vectors.literal(AXIS), 20, id_col="vec_id").select("vec_id", F.round("score", 5).alias("score"))


@query("q26_hybrid", f"WITH {TFIDF_SQL}, v AS (SELECT vec_id AS id, round({DOT_SQL} / {NORM_SQL}, 5) AS score FROM embeddings), r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 100 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v WHERE score > 0 QUALIFY rank <= 100) SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 30")
def q26(spark, d):
    lexical = q24(spark, d)
    similar = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.cosine(F.col("embedding"), vectors.literal(AXIS)), 5).alias("score"))
    return retrieval.fuse([retrieval.ranks(lexical, best=100), retrieval.ranks(similar, best=100)], limit=30)


@query("q27_floors", f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN s IS NULL THEN 'no_vector' WHEN s >= 0.15 THEN 'keep' WHEN s >= 0.05 THEN 'borderline' ELSE 'drop' END AS band FROM (SELECT CASE WHEN vec_id % 10 <> 0 THEN round({DOT_SQL} / {NORM_SQL}, 6) END AS s FROM embeddings)) GROUP BY 1")
def q27(spark, d):
    scored = t(spark, d, "embeddings").select(F.when(F.col("vec_id") % 10 != 0, F.round(vectors.cosine(F.col("embedding"), vectors.literal(AXIS)), 6)).alias("s"))
    return scored.groupBy(vectors.bands(scored, "s", floor=0.15, band=0.1).alias("band")).agg(F.count("*").alias("n"))


@query("q28_classify_counted", "WITH p AS (SELECT label AS bucket, arg_min(embedding, vec_id) AS proto FROM embeddings GROUP BY 1), s AS (SELECT vec_id, bucket, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * proto[i]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(proto, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS sim FROM embeddings, p), b AS (SELECT vec_id, max({'s': sim, 'b': bucket}) AS m FROM s GROUP BY 1) SELECT CASE WHEN m.s >= 0.15 THEN m.b::VARCHAR ELSE 'unclear' END AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS fraction FROM b GROUP BY 1")
def q28(spark, d):
    vecs = t(spark, d, "embeddings")
    protos = vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("proto"))
    scored = vectors.classify_counted(vecs, "embedding", "vec_id", protos.select("proto", F.col("label").alias("bucket")), "proto", "bucket")
    return scored.withColumn("bucket", F.col("bucket").cast("string"))


# Estimators


@query("q29_distribution", "WITH g AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS bucket, count(*) AS n FROM labels GROUP BY 1) SELECT bucket, n, round(n / sum(n) OVER (), 4) AS fraction, substr(sha1('labels|' || bucket), 1, 12) AS stat_id FROM g")
def q29(spark, d):
    bucket = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good")
    return vectors.share(t(spark, d, "labels").select(bucket.alias("bucket")), "bucket").withColumn("stat_id", text.stat_id(F.lit("labels"), F.col("bucket")))


LABELLED_SQL = "g AS (SELECT source, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)"


def labelled(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").cast("long").alias("k"), F.count("*").alias("n"))


@query("q30_wilson", f"WITH {LABELLED_SQL}, c AS (SELECT *, k::DOUBLE / n AS p, 1.959963984540054::DOUBLE AS z FROM g) SELECT source, k, n, round(p, 4) AS point, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))), 4) AS lo, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))), 4) AS hi FROM c")
def q30(spark, d):
    return labelled(spark, d).withColumn("w", stats.wilson(F.col("k"), F.col("n"))).select("source", "k", "n", "w.*")


@query("q31_eb_shrink", f"WITH {LABELLED_SQL}, m AS (SELECT avg(k::DOUBLE / n) AS mean, var_samp(k::DOUBLE / n) AS v FROM g), ab AS (SELECT CASE WHEN v <= 0 OR v >= mean * (1 - mean) THEN 1.0 ELSE mean * (mean * (1 - mean) / v - 1) END AS a, CASE WHEN v <= 0 OR v >= mean * (1 - mean) THEN 1.0 ELSE (1 - mean) * (mean * (1 - mean) / v - 1) END AS b FROM m) SELECT source, k, n, round((k + a) / (n + a + b), 4) AS shrunk, round(a, 3) AS alpha, round(b, 3) AS beta FROM g, ab")
def q31(spark, d):
    return stats.eb_shrink(labelled(spark, d), "k", "n")


@query("q32_rogan_gladen", f"WITH {LABELLED_SQL}, grid AS (SELECT 0.8 + 0.15 * i / 3 AS x FROM range(0, 4) t(i)) SELECT source, round(k::DOUBLE / n, 4) AS observed, round(min(least(1.0, greatest(0.0, (k::DOUBLE / n + s.x - 1) / (r.x + s.x - 1)))), 4) AS corrected_lo, round(max(least(1.0, greatest(0.0, (k::DOUBLE / n + s.x - 1) / (r.x + s.x - 1)))), 4) AS corrected_hi FROM g, grid s, grid r GROUP BY source, k, n")
def q32(spark, d):
    return labelled(spark, d).withColumn("b", stats.rogan_gladen_band(F.col("k") / F.col("n"))).select("source", "b.*")


@query("q33_consensus", "WITH c AS (SELECT user_id % 50 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT bucket, n / sum(n) OVER (PARTITION BY bucket) AS p, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, event_type) AS place FROM c) SELECT bucket, round(CASE WHEN count(*) > 1 THEN 1 + sum(p * ln(p)) / ln(count(*)) ELSE 1.0 END, 4) AS consensus, round(sum(p * p), 4) AS hhi, round(max(p), 4) AS top, round(max(p) - coalesce(max(p) FILTER (place = 2), 0), 4) AS margin FROM p GROUP BY 1")
def q33(spark, d):
    counts = t(spark, d, "events").groupBy((F.col("user_id") % 50).alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    index = counts.groupBy("bucket").agg(stats.consensus_index(F.collect_list(F.col("n").cast("double"))).alias("c"))
    return index.select("bucket", "c.consensus", "c.hhi", "c.top", "c.margin")


@query("q34_trend")
def q34(spark, d):
    years = t(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("k"), F.count("*").alias("n"))
    return stats.trend(years, ["o_orderpriority"], "year", "k", "n")


@query("q34b_trend_slope", "WITH y AS (SELECT o_orderpriority, year(o_orderdate)::DOUBLE AS x, count(*) FILTER (o_totalprice > 250000) / count(*)::DOUBLE AS p, count(*) AS n FROM orders GROUP BY ALL), v AS (SELECT *, p * (1 - p) / n AS v FROM y), w AS (SELECT *, 1 / CASE WHEN v > 0 THEN v ELSE coalesce(avg(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY o_orderpriority), 1e-6) END AS w FROM v), s AS (SELECT o_orderpriority, count(*) AS years, sum(w) AS sw, sum(w * x) AS sx, sum(w * p) AS sp, sum(w * x * x) AS sxx, sum(w * x * p) AS sxp FROM w GROUP BY 1) SELECT o_orderpriority, years, round((sw * sxp - sx * sp) / (sw * sxx - sx * sx), 5) AS slope_per_year FROM s")
def q34b(spark, d):
    years = t(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.sum((F.col("o_totalprice") > 250000).cast("long")).alias("k"), F.count("*").alias("n"))
    return stats.trend(years, ["o_orderpriority"], "year", "k", "n").select("o_orderpriority", "years", "slope_per_year")


@query("q35_kappa", "WITH c AS (SELECT lang, quality AS a, 1 - toxic AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), t AS (SELECT lang, sum(n) AS al, sum(n) FILTER (a = b) AS same FROM c GROUP BY 1), l AS (SELECT lang, a, sum(n) AS na FROM c GROUP BY ALL), r AS (SELECT lang, b, sum(n) AS nb FROM c GROUP BY ALL), e AS (SELECT l.lang, sum(na * nb) AS ch FROM l JOIN r ON l.lang = r.lang AND a = b GROUP BY 1) SELECT lang, CASE WHEN ch / (al * al) >= 1 THEN 1.0 ELSE round((coalesce(same, 0) / al - ch / (al * al)) / (1 - ch / (al * al)), 4) END AS kappa, CAST(al AS BIGINT) AS n FROM t JOIN e USING (lang)")
def q35(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return stats.cohens_kappa("a", "b", rows, ["lang"])


@query("q35b_one_vs_rest", "WITH c AS (SELECT quality AS g, 1 - toxic AS p, count(*) AS c FROM labels GROUP BY ALL), k AS (SELECT g AS class FROM c UNION SELECT p FROM c), x AS (SELECT class, coalesce(sum(c) FILTER (g = class AND p = class), 0) AS tp, coalesce(sum(c) FILTER (g = class), 0) AS pos, coalesce(sum(c) FILTER (g <> class AND p <> class), 0) AS tn, coalesce(sum(c) FILTER (g <> class), 0) AS neg FROM c, k GROUP BY 1) SELECT class, CAST(pos AS BIGINT) AS n, round(tp / pos, 4) AS sens, round(tn / neg, 4) AS spec, round(sqrt(tp / pos * (1 - tp / pos) / pos), 4) AS sens_se, round(sqrt(tn / neg * (1 - tn / neg) / neg), 4) AS spec_se FROM x")
def q35b(spark, d):
    return stats.one_vs_rest(t(spark, d, "labels").select(F.col("quality").alias("g"), (1 - F.col("toxic")).alias("p")), "g", "p")


@query("q36_bootstrap")
def q36(spark, d):
    items = t(spark, d, "events").select("event_type", "user_id", (F.col("value") > 50).alias("hit"))
    return stats.cluster_bootstrap(items, ["event_type"], "user_id", "hit")


@query("q37_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 4) AS p_retailprice_norm, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 4) AS p_size_norm FROM part")
def q37(spark, d):
    return stats.minmax(t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]).drop("p_retailprice", "p_size")


# Dashboards


@query("q38_pain_points", "WITH e AS (SELECT event_type, user_id % 7 AS segment, value / 100 - 0.5 AS s, event_id FROM events), f AS (SELECT DISTINCT event_type, segment, event_id FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, segment ORDER BY event_id) AS place FROM f) SELECT event_type, segment, volume, avg_sentiment, evidence FROM (SELECT event_type, segment, count(*) AS volume, round(avg(s), 4) AS avg_sentiment FROM e GROUP BY ALL) JOIN (SELECT event_type, segment, string_agg(event_id, ',' ORDER BY event_id) AS evidence FROM r WHERE place <= 5 GROUP BY ALL) USING (event_type, segment)")
def q38(spark, d):
    rows = t(spark, d, "events").select("event_type", (F.col("user_id") % 7).alias("segment"), (F.col("value") / 100 - 0.5).alias("s"), "event_id")
    found = dashboards.pain_points(rows, label="event_type", segment="segment", sentiment="s", source_id="event_id")
    return found.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query("q39_daily", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS volume, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def q39(spark, d):
    return dashboards.daily(t(spark, d, "events"), ["event_type"], "ts", "value")


@query("q40_trending", "WITH m AS (SELECT max(ts) AS e FROM events), c AS (SELECT user_id % 400 AS topic, count(*) FILTER (ts >= e - INTERVAL 3 day) AS w, count(*) FILTER (ts >= e - INTERVAL 20 day AND ts < e - INTERVAL 3 day) AS b, avg(value) FILTER (ts >= e - INTERVAL 3 day) AS s FROM events, m WHERE ts >= e - INTERVAL 20 day GROUP BY 1) SELECT topic, w AS window_volume, b AS baseline_volume, round(s, 4) AS avg_sentiment, round((w / 3.0::DOUBLE) / greatest(b / 17.0::DOUBLE, 0.05), 4) AS trend_ratio FROM c WHERE w > 0 AND round((w / 3.0::DOUBLE) / greatest(b / 17.0::DOUBLE, 0.05), 4) >= 2")
def q40(spark, d):
    ev = t(spark, d, "events").withColumn("topic", F.col("user_id") % 400)
    end = ev.agg(F.max("ts")).first()[0]
    return dashboards.trending(ev, topic="topic", time="ts", value="value", as_of=end, window_days=3, baseline_days=20)


@query("q41_content_gaps", "SELECT topic, volume, round(m, 4) AS avg_sentiment, round(volume * greatest(0.0, 0.1 - m), 4) AS gap_severity FROM (SELECT user_id % 300 AS topic, count(*) AS volume, avg(value / 100 - 0.5) AS m FROM events GROUP BY 1) WHERE volume >= 3 AND m < 0")
def q41(spark, d):
    rows = t(spark, d, "events").select((F.col("user_id") % 300).alias("topic"), (F.col("value") / 100 - 0.5).alias("v"))
    return dashboards.content_gaps(rows, topic="topic", value="v")


@query("q42_tier_mix", f"WITH {CLAIMS_SQL}, g AS (SELECT subject_id, source_tier, count(*) AS n FROM claims GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY subject_id), 4) AS fraction FROM g")
def q42(spark, d):
    return dashboards.mix(claims(spark, d), ["subject_id"], "source_tier")


@query("q42b_top_clusters", "SELECT label, count(*) AS volume FROM embeddings GROUP BY 1 ORDER BY volume DESC, label LIMIT 5")
def q42b(spark, d):
    return dashboards.top_clusters(t(spark, d, "embeddings"), "label")


@query("q43_planner", "WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100), b AS (SELECT l_partkey AS p_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 100) SELECT 'both' AS kind, p_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', p_partkey FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first', p_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def q43(spark, d):
    a = t(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey")
    b = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).count().orderBy(F.desc("count"), "p_partkey").limit(100).select("p_partkey")
    name = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "p_partkey")
    return name(a.intersect(b), "both").unionByName(name(a.union(b).distinct(), "either")).unionByName(name(a.subtract(b), "first"))


@query("q44_rank_consensus", "WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL), m AS (SELECT l_partkey, max({'n': n, 'price': price, 'l_suppkey': l_suppkey}) AS m FROM g GROUP BY 1) SELECT l_partkey, m.n AS n, m.price AS price, m.l_suppkey AS l_suppkey FROM m WHERE m.n >= 2")
def q44(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return dashboards.best_per_entity(g, "l_partkey", "n", ["price", "l_suppkey"], least=2)


# Web and text

STRIP_SQL = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g'))"


@query("q45_html", f"SELECT page_id, md5({STRIP_SQL}) AS body_md5, length({STRIP_SQL}) AS n_chars, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def q45(spark, d):
    body = text.strip_html(F.col("html"))
    return t(spark, d, "pages").select("page_id", F.md5(body).alias("body_md5"), F.length(body).cast("long").alias("n_chars"), text.html_title(F.col("html")).alias("title"))


@query("q46_hosts", r"SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '') AS host, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS bare, split_part(url, '#', 1) AS clean, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) = 'example.net' OR ends_with(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '.example.net') AS blocked FROM pages")
def q46(spark, d):
    return t(spark, d, "pages").select("page_id", url.host(F.col("url")).alias("host"), url.bare_host(F.col("url")).alias("bare"), url.defragment(F.col("url")).alias("clean"), url.is_blocked(url.host(F.col("url")), ("example.net",)).alias("blocked"))


@query("q47_page_versions", r"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) || '/' || split_part(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1), '/', 2) AS k, md5(html) AS h FROM pages), l AS (SELECT *, lag(h) OVER (PARTITION BY k ORDER BY page_id) AS before, lead(page_id) OVER (PARTITION BY k ORDER BY page_id) AS until FROM p) SELECT page_id, k AS version_key, before IS NULL OR before <> h AS changed, until FROM l")
def q47(spark, d):
    rows = t(spark, d, "pages").select("page_id", F.concat(url.host(F.col("url")), F.lit("/"), F.split_part(url.path(F.col("url")), F.lit("/"), F.lit(2))).alias("version_key"), F.md5("html").alias("h"))
    from pyspark.sql import Window

    order = Window.partitionBy("version_key").orderBy("page_id")
    return graph.supersede(rows, ["version_key"], "page_id", tie="page_id").withColumn("changed", F.coalesce(F.lag("h").over(order) != F.col("h"), F.lit(True))).select("page_id", "version_key", "changed", F.col("t_ingest_to").alias("until"))


@query("q47b_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']/([^"''#\s/]+)', 1)) AS target FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT target) AS n_targets FROM l GROUP BY 1""")
def q47b(spark, d):
    found = t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']/([^"'#\s/]+)"""), F.lit(1))).alias("target"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("target").alias("n_targets"))


@query("q23b_bm25_scan", f"WITH {POSTINGS_SQL}, k AS (SELECT * FROM h WHERE tf > 0), n AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM p), df AS (SELECT term, count(*) AS df FROM k GROUP BY 1) SELECT doc_id AS id, round(sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM k JOIN df USING (term), n GROUP BY 1")
def q23b(spark, d):
    return retrieval.bm25(t(spark, d, "documents"), QUESTION, id_col="doc_id", text_col="text")


@query("q24b_tfidf_scan", f"WITH {TFIDF_SQL} SELECT * FROM s")
def q24b(spark, d):
    return retrieval.tfidf_scores(t(spark, d, "documents"), QUESTION, id_col="doc_id", text_col="text")


# Plans and recall


METRICS_SQL = "m AS (SELECT s_suppkey::VARCHAR AS school_id, s_name AS name, s_acctbal AS max_tuition, count(l_orderkey) AS n_comments, round(count(*) FILTER (l_returnflag = 'R') / nullif(count(l_orderkey), 0)::DOUBLE, 6) AS pos_frac FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)"


def metrics(spark, d):
    """Suppliers as schools: a price, and how many lines speak of them, which share of these well."""
    spoken = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_comments"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("well"))
    joined = t(spark, d, "supplier").join(spoken, "s_suppkey", "left")
    return joined.select(F.col("s_suppkey").cast("string").alias("school_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("max_tuition"), F.coalesce("n_comments", F.lit(0).cast("long")).alias("n_comments"), F.round(F.col("well") / F.col("n_comments"), 6).alias("pos_frac"))


TUITION_SQL = "(SELECT * FROM m WHERE max_tuition IS NOT NULL ORDER BY max_tuition ASC, school_id LIMIT 30)"
REGARD_SQL = "(SELECT * FROM m WHERE pos_frac IS NOT NULL AND n_comments >= 50 ORDER BY pos_frac DESC, school_id LIMIT 50)"


@query("q79_plan_intersect", f"WITH {METRICS_SQL}, a AS {TUITION_SQL}, b AS {REGARD_SQL}, k AS (SELECT a.* FROM a SEMI JOIN b USING (school_id)) SELECT row_number() OVER (ORDER BY max_tuition, school_id) AS place, * FROM k QUALIFY place <= 15")
def q79(spark, d):
    from tiergraph.plans.planner import execute_plan, plan_query

    return execute_plan(plan_query("cheapest schools that applicants also like"), metrics(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("q79b_plan_lone", f"WITH {METRICS_SQL}, b AS (SELECT * FROM m WHERE pos_frac IS NOT NULL AND n_comments >= 50 ORDER BY pos_frac, school_id LIMIT 15) SELECT row_number() OVER (ORDER BY pos_frac, school_id) AS place, * FROM b")
def q79b(spark, d):
    from tiergraph.plans.planner import execute_plan, plan_query

    return execute_plan(plan_query("worst reviewed schools"), metrics(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("q79c_plan_union", f"WITH {METRICS_SQL}, a AS (SELECT * FROM m ORDER BY max_tuition DESC, school_id LIMIT 7), b AS (SELECT * FROM m WHERE n_comments >= 50 ORDER BY pos_frac, school_id LIMIT 9), k AS (SELECT * FROM a UNION SELECT * FROM b) SELECT row_number() OVER (ORDER BY max_tuition DESC, school_id) AS place, * FROM k QUALIFY place <= 15")
def q79c(spark, d):
    from tiergraph.plans.planner import execute_plan, parsed_plan

    plan = parsed_plan('so: {"ops": [{"op": "rank_tuition", "order": "desc", "k": 7}, {"op": "rank_sentiment", "order": "asc", "k": 9}, {"op": "none"}], "combine": "union", "sort_by": "tuition"}')
    return execute_plan(plan, metrics(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("q80_canonical_subjects", "WITH said AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'school:' || o_custkey WHEN 1 THEN c_name WHEN 2 THEN ' ' || upper(c_name) || ' ' ELSE 'nobody ' || o_custkey END AS subject_id FROM orders JOIN customer ON c_custkey = o_custkey), a AS (SELECT c_name, min('customer|' || c_custkey) AS id FROM customer GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN id ELSE subject_id END AS subject_id FROM said LEFT JOIN a ON lower(trim(subject_id)) = lower(c_name)")
def q80(spark, d):
    customers = t(spark, d, "customer")
    n = F.col("o_orderkey") % 4
    subject = F.when(n == 0, F.concat(F.lit("school:"), F.col("o_custkey").cast("string"))).when(n == 1, F.col("c_name")).when(n == 2, F.concat(F.lit(" "), F.upper("c_name"), F.lit(" "))).otherwise(F.concat(F.lit("nobody "), F.col("o_custkey").cast("string")))
    said = t(spark, d, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", subject.alias("subject_id"))
    aliases = customers.select(F.col("c_name").alias("alias"), F.concat(F.lit("customer|"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return recall.canonical_subjects(said, aliases)


@query("q81_node_texts", "SELECT 'part:' || p_partkey AS id, concat_ws(' ', 'part:' || p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_type END) AS text FROM part")
def q81(spark, d):
    made = make_nodes(t(spark, d, "part"), "Part", "L2", key("part", "p_partkey"), F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("description"), F.col("p_name").alias("name"), "p_brand"))
    return recall.node_texts(made)


@query("q82_sheet_headers", "WITH r AS (SELECT s_nationkey::VARCHAR AS sheet, s_suppkey, s_name, s_acctbal FROM supplier) SELECT sheet, s_name AS school, 'Balance' AS metric_name, s_acctbal AS metric_value FROM r")
def q82(spark, d):
    from tiergraph.sources.official import sheet_headers, sheet_values

    body = t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sheet"), (F.col("s_suppkey") + 3).cast("int").alias("row"), F.array(F.col("s_name"), F.lit(""), F.format_string("$%.2f", "s_acctbal")).alias("cells"))
    sheets = body.select("sheet").distinct()
    title = sheets.select("sheet", F.lit(0).alias("row"), F.array(F.lit("Table 1"), F.lit(None).cast("string")).alias("cells"))
    head = sheets.select("sheet", F.lit(2).alias("row"), F.array(F.lit("Dental School"), F.lit(" State "), F.lit(" Balance ")).alias("cells"))
    rows = body.unionByName(title).unionByName(head)
    return sheet_values(rows, sheet_headers(rows)).select("sheet", "school", "metric_name", "metric_value")


@query("q83_tag_pages", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, source FROM documents), c AS (SELECT CASE WHEN len(w) > 512 THEN CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 WHEN len(w) > 0 THEN 1 ELSE 0 END AS n FROM w) SELECT 'HAS_CHUNK' AS label, CAST(sum(n) AS BIGINT) AS n FROM c UNION ALL SELECT 'MENTIONS', count(*) FROM documents WHERE source IS NOT NULL AND doc_id % 3 <> 0 UNION ALL SELECT 'review', count(*) FROM documents WHERE source IS NOT NULL AND doc_id % 3 = 1 UNION ALL SELECT 'Entity', count(DISTINCT source) FROM documents WHERE source <> 'src0' AND doc_id % 3 <> 0")
def q83(spark, d):
    from tiergraph.sources.web import tag_pages

    pages = t(spark, d, "documents").select(F.concat(F.lit("page:"), F.col("doc_id").cast("string")).alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("body"), "source", (F.col("doc_id") % 3).alias("k"))
    mentions = pages.where("source is not null").select("page_id", F.col("source").alias("entity_id"), F.col("source").alias("name"), F.when(F.col("k") == 0, 50.0).when(F.col("k") == 1, 80.0).otherwise(97.0).alias("score"))
    made, links, reviews = tag_pages(pages, mentions, spark.createDataFrame([("src0",)], "id string"), tier="L2", now=NOW)
    counted = links.groupBy("label").agg(F.count("*").alias("n"))
    counted = counted.unionByName(reviews.agg(F.lit("review").alias("label"), F.count("*").alias("n")))
    return counted.unionByName(made.where("label = 'Entity'").agg(F.lit("Entity").alias("label"), F.count("*").alias("n")))


@query("q84_resonance", "WITH a AS (SELECT count(DISTINCT user_id) AS every FROM events) SELECT event_type, count(DISTINCT user_id) AS distinct_authors, count(DISTINCT user_id % 50) AS n_threads, count(*) AS n_docs, round(coalesce(quantile_cont(value, 0.5), 0), 2) AS median_score, round(count(DISTINCT user_id) / any_value(every), 4) AS author_share FROM events, a GROUP BY 1")
def q84(spark, d):
    items = t(spark, d, "events").withColumn("thread", F.col("user_id") % 50)
    return stats.resonance(items, ["event_type"], author="user_id", thread="thread", score="value")


@query("q85_media_and_tables", r"""SELECT 'EMBEDS' AS label, CAST(coalesce(sum(len(list_distinct(regexp_extract_all(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1)))), 0) AS BIGINT) AS n FROM pages UNION ALL SELECT 'TABLE_OF', CAST(coalesce(sum(len(regexp_extract_all(html, '(?i)<table[ >]'))), 0) AS BIGINT) FROM pages""")
def q85(spark, d):
    from tiergraph.sources.web import media_assets, page_tables

    pages = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("page_id"), "html")
    count = lambda made, label: made[1].agg(F.lit(label).alias("label"), F.count("*").alias("n"))
    return count(media_assets(pages, tier="L2", now=NOW), "EMBEDS").unionByName(count(page_tables(pages, tier="L2", now=NOW), "TABLE_OF"))


@query("q86_recall", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'tier' AS kind, count(*) AS n FROM nodes WHERE label IN ('Post', 'Comment') UNION ALL SELECT 'cluster', count(DISTINCT from_id) FROM edges WHERE label = 'POSTED_IN_FORUM' UNION ALL SELECT 'named', count(*) FROM supplier WHERE contains(lower(s_name), 'supplier#00000000')")
def q86(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    count = lambda rows, kind: rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    found = count(recall.post_tiers(n), "tier").unionByName(count(recall.post_clusters(e, member="POSTED_IN_FORUM"), "cluster"))
    return found.unionByName(count(recall.schools_named(n, "the Supplier#00000000", label="Supplier", limit=None), "named"))


@query("q48_chunks", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) > 512 THEN CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) ELSE 0 END AS last FROM w WHERE len(w) > 0) SELECT doc_id, unnest(range(0, last + 1)) * 448 AS at FROM c")
def q48(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.at").cast("long").alias("at"))


@query("q49_content_ids", "SELECT doc_id, substr(sha256(source || '|' || text), 1, 16) AS content_id FROM documents")
def q49(spark, d):
    return t(spark, d, "documents").select("doc_id", text.content_id(F.col("source"), F.col("text")).alias("content_id"))


@query("q50_delta_pull", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01'")
def q50(spark, d):
    from tiergraph.sources.connectors import delta

    return delta(t(spark, d, "orders"), "o_orderdate", datetime(1997, 6, 1)).select("o_orderkey")


@query("q51_dangling", f"WITH {EDGES_SQL}, e AS (SELECT DISTINCT label, from_id, to_id FROM edges WHERE label IN ('PLACED', 'IN_NATION')), n AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0 UNION SELECT 'order:' || o_orderkey FROM orders UNION SELECT 'nation:' || n_nationkey FROM nation) SELECT label, count(*) AS n FROM e WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n) GROUP BY 1")
def q51(spark, d):
    kept = nodes(spark, d).where(F.col("label").isin("Customer", "Order", "Nation")).where(~((F.col("label") == "Customer") & (F.split_part("id", F.lit(":"), F.lit(2)).try_cast("long") % 4 == 0)))
    return graph.drop_dangling(edges(spark, d).where(F.col("label").isin("PLACED", "IN_NATION")), kept).groupBy("label").agg(F.count("*").alias("n"))


@query("q51b_checkpoint", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q51b(spark, d):
    return graph.not_done(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("q52_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q52(spark, d):
    from tiergraph.model import properties

    return t(spark, d, "events").select("event_id", properties(F.col("props"), "k").alias("k"))


PRICE_SQL = r"regexp_extract_all(x, '\$\s?(\d{1,3}(?:,\d{3})+|\d{1,6})(?:\.(\d{1,2}))?\s?([kK])?', "


@query("q53_prices", f"WITH x AS (SELECT c_custkey, 'paid $' || (c_custkey % 90)::VARCHAR || 'k then $' || (c_custkey % 7 + 1)::VARCHAR || ',' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || ' and $5' AS x FROM customer), p AS (SELECT c_custkey, unnest(list_transform(list_zip({PRICE_SQL}1), {PRICE_SQL}3)), lambda z: replace(z[1], ',', '')::DOUBLE * CASE WHEN z[2] <> '' THEN 1000 ELSE 1 END)) AS v FROM x) SELECT c_custkey, count(*) AS n, sum(v) AS total FROM p WHERE v BETWEEN 20 AND 100000 GROUP BY 1")
def q53(spark, d):
    k = F.col("c_custkey")
    said = F.concat(F.lit("paid $"), (k % 90).cast("string"), F.lit("k then $"), (k % 7 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" and $5"))
    return t(spark, d, "customer").select(k, F.explode(text.prices(said)).alias("v")).groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("q54_quantiles", "WITH g AS (SELECT event_type, list_sort(list(value)) AS v, quantile_cont(value, 0.9) AS inc FROM events GROUP BY 1), a AS (SELECT *, 0.9 * (len(v) + 1) AS k FROM g) SELECT event_type, round(inc, 4) AS p90_inclusive, round(v[floor(k)::BIGINT] + (v[floor(k)::BIGINT + 1] - v[floor(k)::BIGINT]) * (k - floor(k)), 4) AS p90_exclusive FROM a")
def q54(spark, d):
    g = t(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.9).alias("i"), stats.quantile_exclusive(F.collect_list("value"), 0.9).alias("e"))
    return g.select("event_type", F.round("i", 4).alias("p90_inclusive"), F.round("e", 4).alias("p90_exclusive"))


@query("q55_slugs", "SELECT slug, min(p_type) AS label, count(*) AS n FROM (SELECT p_type, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part) GROUP BY 1")
def q55(spark, d):
    return t(spark, d, "part").select("p_type", text.slug(F.col("p_type")).alias("slug")).groupBy("slug").agg(F.min("p_type").alias("label"), F.count("*").alias("n"))


@query("q56_best_sentence")
def q56(spark, d):
    return t(spark, d, "documents").select("doc_id", text.best_sentence(QUESTION, F.col("text")).alias("sentence"))


@query("q57_guard_narration")
def q57(spark, d):
    said = F.concat(F.lit("Of all "), F.col("n_chars").cast("string"), F.lit(" hold. In 2024 nothing else. About 37% agree. "), "text")
    kept, dropped = text.guard_narration(said, F.array(F.col("n_chars").cast("double")))
    return t(spark, d, "documents").select("doc_id", kept.alias("kept"), F.size(dropped).alias("n_dropped"))


# Entity resolution


@query("q58_alias_match")
def q58(spark, d):
    from tiergraph.operators.resolution import match_aliases

    part = t(spark, d, "part")
    mentions = part.select(F.col("p_partkey").alias("mention_id"), F.concat(F.lower("p_name"), F.lit(" the")).alias("mention"))
    aliases = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("alias"))
    return match_aliases(mentions, aliases, threshold=85.0)


@query("q59_mention_scan", "WITH a AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents WHERE doc_id % 50 = 0) WHERE length(w) BETWEEN 4 AND 5), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS w FROM documents) SELECT w AS alias, count(*) AS n FROM d JOIN a USING (w) GROUP BY 1")
def q59(spark, d):
    from tiergraph.operators.resolution import scan_short_aliases

    docs = t(spark, d, "documents")
    words = lambda rows: rows.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("alias")).distinct()
    aliases = words(docs.where("doc_id % 50 = 0")).where(F.length("alias").between(4, 5))
    return scan_short_aliases(docs, aliases, id_col="doc_id", text_col="text").groupBy("alias").agg(F.count("*").alias("n"))


@query("q60_linker")
def q60(spark, d):
    from tiergraph.operators.resolution import link_entities

    a = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("org").alias("kind"), F.col("s_name").alias("name"))
    b = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("org").alias("kind"), F.regexp_replace("c_name", "Customer", "Supplier").alias("name"))
    return link_entities(a, b)


@query("q61_latest_state", "SELECT user_id, event_type AS state, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q61(spark, d):
    return graph.latest(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_type").alias("state"), "event_id")


@query("q62_blocklist", "SELECT item_id FROM benchmark WHERE lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM documents WHERE text IS NOT NULL)")
def q62(spark, d):
    return filters.blocklist(t(spark, d, "benchmark"), "text", t(spark, d, "documents").withColumnRenamed("text", "pattern"), "pattern").select("item_id")


@query("q63_due_jobs", "WITH n AS (SELECT date_trunc('day', max(ts)) AS now FROM events), s AS (SELECT user_id, round(sum(value), 4) AS spent FROM events, n WHERE ts >= date_trunc('month', now) AND ts <= now GROUP BY 1), j AS (SELECT user_id, max(ts) - INTERVAL 2 day AS due FROM events GROUP BY 1) SELECT j.user_id, coalesce(spent, 0.0) AS spent FROM j LEFT JOIN s USING (user_id), n WHERE due <= now AND coalesce(spent, 0.0) < 3200 ORDER BY due, j.user_id LIMIT 50")
def q63(spark, d):
    ev = t(spark, d, "events")
    now = ev.agg(F.date_trunc("day", F.max("ts"))).first()[0]
    jobs = ev.groupBy("user_id").agg((F.max("ts") - F.expr("interval 2 days")).alias("due")).withColumns({"status": F.lit("active"), "budget": F.lit(3200.0)})
    found = dashboards.due_jobs(jobs, dashboards.month_spend(ev, "user_id", "ts", "value", now), "user_id", due="due", budget="budget", now=now)
    return found.select("user_id", F.coalesce("spent", F.lit(0.0)).alias("spent"))


ROBOTS = "User-agent: x\nDisallow: /\n\nUser-agent: *\nDisallow: /de # all\nAllow: /de/1\nDisallow: /en/2\nCrawl-delay: 90\nSitemap: http://s/x.xml\n"


@query("q64_robots", r"WITH r AS (SELECT * FROM (VALUES ('/de', false), ('/de/1', true), ('/en/2', false)) v(rule, allow)), p AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1) END AS path FROM pages) SELECT page_id, coalesce((SELECT max({'n': length(rule), 'a': allow}).a FROM r WHERE starts_with(path, rule)), true) AS allowed FROM p")
def q64(spark, d):
    rules = url.parse_robots(spark.createDataFrame([("h", ROBOTS)], "site string, body string"), "body", ["site"])
    pages = t(spark, d, "pages").select("page_id", F.lit("h").alias("site"), url.path(F.col("url")).alias("path"))
    return url.robots_allowed(pages, rules, ["site"], "path").select("page_id", "allowed")


@query("q65_clusters")
def q65(spark, d):
    return vectors.cluster(t(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id", "embedding", k=4)


@query("q66_stream", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def q66(spark, d):
    from tiergraph.streaming.pulls import pull_available

    return pull_available(spark, f"{d}/events.parquet", keys=["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))




# Plans


@query("q67_thread_graph", "WITH t AS (SELECT 'BELONGS_TO_THREAD' AS label, count(*) AS n FROM conversations UNION ALL SELECT 'REPLIED_TO', count(*) FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS root FROM conversations) WHERE turn <> root UNION ALL SELECT 'POSTED_IN_FORUM', count(*) FROM conversations UNION ALL SELECT 'AUTHORED', count(*) FROM conversations UNION ALL SELECT 'REFERENCES_TOPIC', count(*) FROM conversations) SELECT * FROM t")
def q67(spark, d):
    from tiergraph.sources import community

    turns = t(spark, d, "conversations")
    threads = turns.select(F.col("conv_id").cast("string").alias("thread_id"), F.lit("t").alias("title"), F.lit("chat").alias("category"), F.lit("").alias("thread_url"), F.lit(0).cast("long").alias("reply_count"), F.lit(0).cast("long").alias("view_count")).distinct()
    posts = turns.select(F.lpad(F.col("turn").cast("string"), 6, "0").alias("post_id"), F.col("conv_id").cast("string").alias("thread_id"), F.col("role").alias("author"), F.col("text").alias("content_text"), F.lit(None).cast("string").alias("timestamp_iso"), F.lit("1600000000").alias("created_utc"), F.lit(1).cast("long").alias("page_number"))
    _, found = community.assemble_board(*community.normalise_threads(threads, posts), NOW)
    return found.groupBy("label").agg(F.count("*").alias("n"))


@query("q68_fact_claims", "SELECT 'claim:part:' || p_partkey || ':' || k AS claim_id, v AS object_value FROM (SELECT p_partkey, 'p_brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part) WHERE v IS NOT NULL")
def q68(spark, d):
    from tiergraph.sources.official import fact_claims

    return fact_claims(t(spark, d, "part").withColumn("id", key("part", "p_partkey")), "id", ["p_brand", "p_size"], "2025-26").select("claim_id", "object_value")


@query("q69_changed_versions", "WITH v AS (SELECT *, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS t_to FROM v WHERE was IS NULL OR was <> event_type")
def q69(spark, d):
    from tiergraph.sources.official import supersede_changed

    return supersede_changed(t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", "event_id")


@query("q70_first_annotation", "SELECT user_id AS doc_id, arg_min(event_type, event_id) AS verdict FROM events GROUP BY 1")
def q70(spark, d):
    from tiergraph.plans.extraction import sentiment_of

    return sentiment_of(t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("annotation_id"), F.col("event_type").alias("verdict")))


@query("q71_review_state", "WITH e AS (SELECT user_id AS item_id, min(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY 1), x AS (SELECT user_id AS item_id, arg_min(event_type, ts) AS event FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) SELECT item_id, CASE event WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status FROM e LEFT JOIN x USING (item_id)")
def q71(spark, d):
    from tiergraph.plans.extraction import review_state

    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "reject")
    log = t(spark, d, "events").select(F.col("user_id").alias("item_id"), F.lit("k").alias("kind"), F.col("ts").alias("at"), kind.alias("event"), F.lit("a").alias("actor"))
    return review_state(log).select("item_id", "status")


@query("q72_evaluate", "WITH p AS (SELECT doc_id FROM labels WHERE quality = 1), g AS (SELECT doc_id FROM labels WHERE toxic = 0), c AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g USING (doc_id)) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def q72(spark, d):
    from tiergraph.plans.extraction import evaluate

    labels = t(spark, d, "labels")
    found = evaluate(labels.where("quality = 1"), labels.where("toxic = 0"), keys=["doc_id"])
    return found.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("q73_popular_versus_correct", "WITH c AS (SELECT source AS subject, lang AS stance, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT subject, max({'n': n, 's': stance}).s AS popular FROM c GROUP BY 1), o AS (SELECT subject, CASE WHEN right(subject, 1) IN ('1', '3') THEN 'en' WHEN right(subject, 1) = '5' THEN 'fr' END AS official FROM p) SELECT subject, popular, official, CASE WHEN official IS NULL THEN 'no_anchor' WHEN popular = official THEN 'popular_is_correct' ELSE 'popular_is_wrong' END AS verdict FROM p JOIN o USING (subject)")
def q73(spark, d):
    from tiergraph.plans.protocol import popular_versus_correct

    docs = t(spark, d, "documents").select(F.col("source").alias("subject"), F.col("lang").alias("stance"))
    value = F.when(F.right("subject", F.lit(1)).isin("1", "3"), "en").when(F.right("subject", F.lit(1)) == "5", "fr")
    return popular_versus_correct(docs, docs.select("subject").distinct().withColumn("value", value).where("value is not null"))


@query("q74_provenance", "WITH g AS (SELECT lang AS label, count(*) AS numerator FROM documents GROUP BY 1), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents), s AS (SELECT lang, string_agg(doc_id, ',' ORDER BY doc_id) AS sample_ids FROM r WHERE place <= 10 GROUP BY 1) SELECT substr(sha1('langs|' || label), 1, 12) AS stat_id, label, numerator, CAST(sum(numerator) OVER () AS BIGINT) AS denominator, round(numerator / sum(numerator) OVER (), 4) AS value, sample_ids FROM g JOIN s ON s.lang = g.label")
def q74(spark, d):
    from tiergraph.plans.protocol import provenance

    rows = provenance(t(spark, d, "documents").select("doc_id", F.col("lang").alias("bucket")), "langs")
    return rows.withColumn("sample_ids", F.array_join(F.transform("sample_ids", lambda x: x.cast("string")), ","))


@query("q75_protocol")
def q75(spark, d):
    from tiergraph.plans.protocol import analyse

    turns = t(spark, d, "events")
    items = turns.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("bucket"), F.col("user_id").alias("thread_id"), F.col("user_id").cast("string").alias("author"), (F.lit(2018) + F.col("event_id") % 5).cast("int").alias("year"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cohort"), F.col("value").alias("score"))
    return analyse(items)["buckets"]


@query("q76_extraction_cache", "WITH k AS (SELECT doc_id, sha256('sentiment|v1|' || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0) SELECT k.key IN (SELECT key FROM c) AS from_cache, count(*) AS n FROM k GROUP BY 1")
def q76(spark, d):
    from tiergraph.plans.extraction import cache_key, offline_sentiment, run_task

    docs = t(spark, d, "documents")
    cached = docs.where("doc_id % 2 = 0").select(cache_key("sentiment", "v1", "text").alias("key"), F.lit("{}").alias("output")).distinct()
    results, _ = run_task(docs, cached, offline_sentiment, id_col="doc_id", text_col="text", task="sentiment", version="v1")
    return results.groupBy("from_cache").agg(F.count("*").alias("n"))


@query("q77_find_symbol", "SELECT p_partkey, CASE WHEN lower(p_name) = 'small bolt' THEN 1 WHEN starts_with(lower(p_name), 'small bolt') THEN 2 ELSE 3 END AS match_tier FROM part WHERE contains(lower(p_name), 'small bolt') ORDER BY match_tier, length(p_name), p_name, p_partkey LIMIT 1000000")
def q77(spark, d):
    return retrieval.find_symbol(t(spark, d, "part").select("p_partkey", "p_name"), "p_name", "small bolt", limit=1_000_000).select("p_partkey", "match_tier")


@query("q78_topic_filter", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(reed|blehe)($|[^a-z0-9])')")
def q78(spark, d):
    return retrieval.topic_filter(t(spark, d, "documents"), "text", ["reed", "Blehe"]).select("doc_id")
