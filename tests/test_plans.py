import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tiergraph.plans import extraction, protocol


@pytest.mark.parametrize(
    ("question", "estimand"),
    [("How much do people pay for advising?", "price"), ("What do applicants praise and criticize?", "contrast"), ("Which schools are cheapest?", "ranking"), ("What do people get wrong about the DAT? Any myth?", "belief"), ("What are the biggest pain points?", "pain"), ("Which topics come up most?", "topic"), ("How do students feel about online exams?", "sentiment"), ("Should one retake the DAT?", "stance"), ("", "stance")],
)
def test_estimands(question, estimand):
    assert protocol.classify_estimand(question)[0] == estimand


def test_enrich_inherits_the_parents_forum(spark):
    docs = spark.createDataFrame([("reddit_post:1", None, "u", "2021-03-04", 5, "https://x/r/predental/1"), ("reddit_comment:2", "reddit_post:1", "[deleted]", "bad", None, None), ("sdn_post:3", None, "v", "1999", 1, None)], "doc_id string, thread_id string, author string, created_iso string, score long, url string")
    buckets = docs.select("doc_id", F.lit("b").alias("bucket"))
    got = {r.doc_id: r for r in protocol.enrich(docs, buckets).collect()}
    assert got["reddit_comment:2"].cohort == got["reddit_post:1"].cohort == "pre-dental applicant" and got["sdn_post:3"].cohort == "sdn"
    assert got["reddit_comment:2"].author is None and got["reddit_comment:2"].score == 0 and got["reddit_post:1"].year == 2021 and got["sdn_post:3"].year is None


def items(spark, n=120):
    return spark.createDataFrame([(i, "yes" if i % 3 else "no", i % 17, f"a{i % 9}", 2019 + i % 4, "c" if i % 5 else "d", i) for i in range(n)], "doc_id long, bucket string, thread_id long, author string, year int, cohort string, score long")


def test_protocol(spark):
    found = protocol.analyse(items(spark), b=100)
    buckets = {r.bucket: r for r in found["buckets"].collect()}
    assert buckets["yes"].n_docs == 80 and buckets["yes"].lo <= buckets["yes"].point <= buckets["yes"].hi and buckets["no"].distinct_authors == 3
    assert found["consensus"].first().denominator == 120
    assert {r.direction for r in found["trend"].collect()} <= {"no_trend", "increasing", "decreasing"}
    assert sum(r.fraction for r in found["cohorts"].where("cohort = 'c'").collect()) == pytest.approx(1, abs=1e-3)
    stats = protocol.provenance(items(spark), "p").collect()
    assert {(r.label, r.numerator, r.denominator) for r in stats} == {("yes", 80, 120), ("no", 40, 120)}
    drill = protocol.drill_down(items(spark), items(spark).select("doc_id", "author"), "p", next(r.stat_id for r in stats if r.label == "no"), offset=2, limit=3).collect()
    assert [r.doc_id for r in drill] == [6, 9, 12]
    assert protocol.abstains(items(spark).limit(0)).first().reason == "no_evidence" and protocol.abstains(items(spark)).first().reason is None


def test_pool_prices_and_signals(spark):
    docs = spark.createDataFrame([(1, "[removed]", "a"), (2, "I paid $300 and it was good advice", "b"), (3, "They charge $2k for that, try to ask", "c")], "doc_id long, text string, author string")
    assert [r.doc_id for r in protocol.clean_pool(docs.select("doc_id", F.col("doc_id").alias("rank")), docs, cap=1).collect()] == [2]
    p = protocol.estimand_prices(docs, "text").first()
    assert (p.n, p.median) == (2, 1150.0)
    rows = docs.withColumns({"bucket": F.lit("b"), "score": F.col("doc_id"), "year": F.lit(2021)})
    s = protocol.signals(rows, {"advice": ("advice", "try")}).first()
    assert (s.advice, s.engagement, s.recency, s.n_signal) == (0.6667, 3.0, 1.0, 3)


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "I love it, great"), (2, "awful, avoid"), (3, "I love it, great"), (4, None)], "id long, text string")
    none = spark.createDataFrame([], "key string, output string")
    results, fresh = extraction.run_task(docs, none, extraction.offline_sentiment, id_col="id", text_col="text", task="t", version="1")
    assert fresh.count() == 3
    assert {r.id: json.loads(r.output)["verdict"] for r in results.collect()} == {1: "positive", 2: "negative", 3: "positive", 4: "neutral"}
    again, fresh = extraction.run_task(docs, fresh.checkpoint() if spark.sparkContext.getCheckpointDir() else fresh, extraction.offline_sentiment, id_col="id", text_col="text", task="t", version="1")
    assert fresh.count() == 0 and again.where("from_cache").count() == 4
    nodes, edges = extraction.sentiment_artefacts(results.union(spark.createDataFrame([(9, "k", "broken", False)], results.schema)), "2026-01-01")
    assert nodes.count() == edges.count() == 4
    sure = lambda prompts: [json.dumps({"verdict": "x", "confidence": 0.9 if "love" in p else 0.1}) for p in prompts]
    tiers = {r.id: r.tier for r in extraction.cascade(docs, [(sure, 0.5), (extraction.offline_sentiment, 0.0)], id_col="id", text_col="text").collect()}
    assert tiers == {1: 0, 2: 1, 3: 0, 4: 1}


def test_calibration_review_and_judges(spark):
    gold = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "confidence double, correct boolean")
    out = extraction.calibrate(spark.createDataFrame([(0.05,), (0.95,)], "confidence double"), gold).orderBy("confidence").collect()
    assert out[0].calibrated == 0.0 and out[1].calibrated == 1.0
    votes = spark.createDataFrame([("g", "x", 1), ("g", "y", 1), ("g", "z", 2), ("h", "x", 1), ("h", "y", 2)], "group_id string, judge_family string, claim_id long")
    barred = spark.createDataFrame([("g", "z")], "group_id string, family string")
    got = {r.group_id: (r.winner, r.agreement) for r in extraction.judge_panel(votes, barred).collect()}
    assert got == {"g": (1, 2), "h": (None, 1)}
    log = spark.createDataFrame([("i", "k", 1, "enqueue", "a"), ("i", None, 2, "commit", "b"), ("i", None, 3, "reject", "c"), ("j", "k", 0, "enqueue", "a")], "item_id string, kind string, at int, event string, actor string")
    assert {r.item_id: (r.status, r.decided_by) for r in extraction.review_state(log).collect()} == {"i": ("committed", "b"), "j": ("pending", None)}
    assert [r.item_id for r in extraction.pull_pending(log).collect()] == ["j"]
    feedback = spark.createDataFrame([("p", "good one", 0.9, 1.0, "accept", "2026-01-01"), ("p", "bad one", 0.9, 1.0, "reject", "2026-01-01"), ("p", "old", 0.1, 0.1, "accept", "2020-01-01")], "prompt string, text string, relevance double, trust double, decision string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r.text for r in extraction.feedback_context(feedback, keys=["prompt"], half_life_days=30.0, now=datetime(2026, 1, 2)).orderBy("place").collect()] == ["good one", "old"]
