import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tiergraph.plans import surfaces as S

NOW = datetime(2024, 5, 1)


def test_team_inputs(spark):
    note = lambda **x: json.dumps(x)
    rows = [
        ("a1", "SentimentAnnotation", "L5", note(post_id="reddit_predental:1", target_entities=["", "Case Western!"], verdict="Negative", confidence=0.5, reasoning="r" * 300, ingest_iso="2024-01-02T03:04:05")),
        ("a2", "SentimentAnnotation", "L5", note(post_id="p2", target_entities=["X"], verdict="mixed")),
        ("a3", "SentimentAnnotation", "L5", note(post_id="p3", target_entities=[])),
        ("a4", "SentimentAnnotation", "L5", note(post_id="", target_entities=["X"])),
        ("a5", "SentimentAnnotation", "L5", None),
        ("reddit_predental:1", "Post", "L4", "{}"),
        ("c1", "Cluster", "L5", note(topic_label="cost", member_post_ids=["p2", "reddit_predental:1"])),
        ("c2", "Cluster", "L5", note(member_post_ids=["p2"])),
    ]
    nodes = spark.createDataFrame(rows, "id string, label string, source_tier string, properties_json string")
    got = {r.source_id: r for r in S.pain_inputs(nodes, now=NOW).collect()}
    assert set(got) == {"reddit_predental:1", "p2"}
    one, two = got["reddit_predental:1"], got["p2"]
    assert (one.topic, one.sentiment, len(one.excerpt), one.audience, one.source_tier, one.cluster_id, one.cluster_label) == ("case_western", -0.35, 280, "applicants", "L4", "c1", "cost")
    assert (two.topic, two.sentiment, two.source_tier, two.cluster_id, two.cluster_label, two.at) == ("x", -0.1, None, "c2", "c2", NOW)
    assert len(S.mentions(nodes, page="social", now=NOW).where("source_id like 'reddit%'").first().excerpt) == 240
    assert [r[0] for r in spark.createDataFrame([("dental_residency:1",), ("x_dentist",), (None,)], "i string").select(S.audience(F.col("i"))).collect()] == ["residents", "professionals", "applicants"]


def test_positions_and_labels():
    asked = []

    def provider(prompt, temperature):
        asked.append(temperature)
        return "none" if temperature == 0 else 'so: [{"label": " For "}, {"description": "x"}, {"label": "Against", "description": "d"}]'

    known = {}
    want = [{"label": "For", "description": ""}, {"label": "Against", "description": "d"}]
    assert S.derive_positions(provider, "Q?", ["a"], known=known) == want and asked == [0.0, 0.3]
    assert S.derive_positions(provider, "q? ", ["b"], known=known) == want and len(asked) == 2

    def broken(prompt, temperature):
        raise RuntimeError("away")

    assert S.derive_positions(broken, "Q?", []) == []
    assert [x["label"] for x in S.label_clusters(lambda p, t: '[{"label": "One"}]', [["a"], ["b"]])] == ["One", "Topic 2"]
    assert [x["label"] for x in S.label_clusters(broken, [["a"]])] == ["Topic 1"]


def test_audit(spark):
    events = spark.createDataFrame([("retrieval", {"q": "x"}, None), ("extraction", {"cost": "1"}, 3600)], "kind string, fields map<string,string>, ttl int")
    assert sorted((r.kind, r.fields_json, r.ttl) for r in S.audited(events, at=NOW).collect()) == [("extraction", '{"cost":"1"}', 3600), ("retrieval", '{"q":"x"}', None)]
    for bad in (("extraction", {}, 60), ("extraction", {}, None), ("other", {}, None)):
        with pytest.raises(PySparkException):
            S.audited(spark.createDataFrame([bad], "kind string, fields map<string,string>, ttl int"), at=NOW).collect()


def test_questions_and_misspellings(spark):
    pairs = [("Why dentistry?", "why dentistry", True), ("tell me about a b c", "about a b x", True), ("one", "two three", False), ("", "", True)]
    frame = spark.createDataFrame(pairs, "p string, e string, want boolean")
    assert all(r[0] == r[1] for r in frame.select("want", S.questions_match(F.col("p"), F.col("e"))).collect())
    names = ["University of Iowa", "Ohio State", "abc", "A-b-c-d", "Tufts"]
    for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", S.misspelt(F.col("n")).alias("m")).collect():
        if r.n == "abc":
            assert r.m == r.n
        else:
            i = next((k for k in range(min(len(r.n), len(r.m))) if r.n[k] != r.m[k]), len(r.m))
            edits = {r.n[:i] + r.n[i + 1 :], *(r.n[:k] + r.n[k + 1] + r.n[k] + r.n[k + 2 :] for k in range(len(r.n) - 1)), *(r.n[:k] + r.n[k + 1 :] for k in range(len(r.n)))}
            assert r.m in edits
