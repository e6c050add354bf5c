import json
from datetime import datetime

from pyspark.sql import functions as F

from tiergraph.plans import flows
from tiergraph.plans.extraction import cache_key
from tiergraph.sources import connectors

NOW = datetime(2024, 5, 1)
POST = "post_id string, forum string, author string, title string, body string, created timestamp, score long, ups long, downs long, num_comments long, flair string, url string, over_18 boolean, user_id string"
COMMENT = "comment_id string, forum string, post_id string, parent_id string, author string, body string, created timestamp, score long, ups long, downs long, controversiality long, user_id string"


def test_pulls_from_each_cursor(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "id long, v string")

    def away(after):
        raise OSError("away")

    sources = [flows.Source("a", lambda _: rows, "id", int), flows.Source("bad", away, "id")]
    none = spark.createDataFrame([], connectors.RECEIPT_SCHEMA)
    receipts, landed = flows.pull_all(sources, none)
    assert {r.source_id: (r.status, r.rows, r.cursor_value) for r in receipts.collect()} == {"a": ("ok", 10, "9"), "bad": ("errored", 0, None)}
    assert set(landed) == {"a"} and landed["a"].count() == 10
    again, nothing = flows.pull_all(sources[:1], receipts)
    assert again.first().rows == 0 and again.first().cursor_value == "9" and nothing["a"].count() == 0
    assert connectors.cursors(receipts.unionByName(connectors.reset_receipt("a", datetime(2999, 1, 1)))).where("source_id = 'a'").first().cursor_value is None
    assert flows.pull_all([], none)[0].count() == 0


def test_increments_do_what_is_left(spark):
    posts = spark.createDataFrame([(f"p{i}", "f", "u", "t", "b", NOW, 1, 1, 0, 0, None, "u", False, "reddit:f:u") for i in range(3)], POST)
    comments = spark.createDataFrame([("c1", "f", "p0", "p0", "w", "b", NOW, 1, 1, 0, 0, "reddit:f:w")], COMMENT)
    done = spark.createDataFrame([("p0",)], "id string")
    nodes, edges, more = flows.structural_increment(posts, comments, done, NOW)
    assert sorted(r.id for r in more.collect()) == ["c1", "p1", "p2"] and sorted(r.id for r in nodes.where("label in ('Post', 'Comment')").collect()) == ["c1", "p1", "p2"]
    assert flows.structural_increment(posts, comments, done.union(more), NOW)[2].count() == 0
    docs = spark.createDataFrame([(1, "I went to UCLA"), (2, "the ohio state university it is"), (3, "UCLA again"), (4, None)], "id long, text string")
    aliases = spark.createDataFrame([("UCLA", "e1"), ("Ohio State University", "e2")], "alias string, entity_id string")
    found, seen = flows.mention_increment(docs, aliases, spark.createDataFrame([(3,)], "id long"))
    assert {(r.id, r.entity_id) for r in found.collect()} == {(1, "e1"), (2, "e2")} and seen.count() == 3


def test_extraction_within_a_budget(spark):
    docs = spark.createDataFrame([(i, f"text {i % 6}") for i in range(12)], "id long, text string")
    known = docs.where("text = 'text 0'").select(cache_key("sentiment", "v1", "text").alias("key"), F.lit('{"verdict": "neutral", "confidence": 1.0}').alias("output")).distinct()
    provider = lambda texts: [json.dumps({"verdict": "positive", "confidence": 0.5}) for _ in texts]
    nodes, edges, fresh = flows.daily_extraction(docs, known, provider, budget=3.0, each=1.0)
    assert fresh.count() == 3 and nodes.count() == 2 + 6 == edges.count()
    rest = flows.daily_extraction(docs, known.unionByName(fresh), provider, budget=99.0, each=1.0)
    assert rest[2].count() == 2 and rest[0].count() == 12
    assert flows.daily_extraction(docs, known, provider, budget=0.0, each=1.0)[0].count() == 2


def test_clusters_and_index(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i % 2 == j) for j in range(2)]) for i in range(12)], "id long, v array<double>")
    members, sizes = flows.weekly_clusters(vectors, id_col="id", vec_col="v", k=2, samples=3)
    assert members.groupBy(F.col("id") % 2).agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0 and sorted(r.n for r in sizes.collect()) == [6, 6]
    nodes = spark.createDataFrame([("n1", '{"title": "red stone"}'), ("n2", "bad")], "id string, properties_json string")
    assert [r.id for r in flows.refresh_index(nodes, str(tmp_path / "i")).bm25("stone").collect()] == ["n1"]
