from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tiergraph.model import EDGE_SCHEMA, NODE_SCHEMA, tier_ordinal, tier_weight
from tiergraph.operators import filters, graph

DAY = lambda n: datetime(2020, 1, n)


def edge(i, a, b, label="R", tier="L1", **more):
    base = dict(id=i, label=label, from_id=a, to_id=b, source_tier=tier, rank="normal", references=[], qualifiers={}, t_valid_from=None, t_valid_to=None, t_ingest_from=None, t_ingest_to=None, confidence=1.0)
    return tuple({**base, **more}.values())


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(n, "Thing", "L1", f'{{"name": "{n}"}}') for n in "abcdefg"] + [("x", "Post", "L5", None), ("y", "Post", "L5", "{broken")], NODE_SCHEMA)


def test_tiers(spark):
    got = spark.createDataFrame([("L1",), ("L5",), ("?",), (None,)], "t string").select(tier_ordinal(F.col("t")), tier_weight(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (5, 0.4), (99, 0.4), (99, 0.4)]


def test_as_of_is_half_open_and_versions_meet(spark):
    edges = spark.createDataFrame([edge("1", "a", "b", t_ingest_from=DAY(1)), edge("2", "a", "b", t_ingest_from=DAY(5)), edge("3", "a", "c")], EDGE_SCHEMA)
    closed = graph.supersede(edges.where("id <> '3'"), ["from_id", "to_id", "label"]).unionByName(edges.where("id = '3'"))
    at = lambda day: sorted(r.id for r in closed.where(filters.edge_passes(as_of=DAY(day))).collect())
    assert at(4) == ["1", "3"] and at(5) == ["2", "3"] and closed.where("t_ingest_to is null and id <> '3'").count() == 1


def test_time_range_anomaly_and_tier(spark):
    edges = spark.createDataFrame(
        [edge("1", "a", "b", t_valid_from=DAY(10), t_valid_to=DAY(12)), edge("2", "a", "b", t_valid_from=DAY(20)), edge("3", "a", "b", qualifiers={"status": "anomaly"}), edge("4", "a", "b", tier="L4"), edge("5", "a", "b", qualifiers=None)], EDGE_SCHEMA
    )
    ids = lambda **k: sorted(r.id for r in edges.where(filters.edge_passes(**k)).collect())
    assert ids(time_range=(DAY(12), DAY(15))) == ["1", "4", "5"]
    assert ids(include_anomalies=True, tier_min="L2") == ["1", "2", "3", "5"]


def test_neighbours_keep_their_orientation(spark, nodes):
    edges = spark.createDataFrame([edge("1", "a", "b"), edge("2", "c", "a"), edge("3", "a", "zz")], EDGE_SCHEMA)
    got = graph.neighbours(edges, nodes, spark.createDataFrame([("a",)], "id string"), direction="both").select("direction", "from_id", "to_id", "neighbour_id").collect()
    assert sorted(map(tuple, got)) == [("in", "c", "a", "c"), ("out", "a", "b", "b")]


def test_traverse_keeps_the_first_hop(spark, nodes):
    edges = spark.createDataFrame([edge("1", "a", "b"), edge("2", "b", "c"), edge("3", "a", "c"), edge("4", "c", "d"), edge("5", "d", "a"), edge("6", "c", "zz")], EDGE_SCHEMA)
    got = {r.id: (r.hop, r.last_from) for r in graph.traverse(edges, nodes, spark.createDataFrame([("a",)], "id string"), depth=3).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "c")}


def test_upserts_and_dangling_edges(spark, nodes):
    edges = spark.createDataFrame([edge("1", "a", "b"), edge("1", "a", "b"), edge("2", "a", "zz")], EDGE_SCHEMA)
    assert [r.id for r in graph.drop_dangling(edges, nodes).collect()] == ["1"]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("l", 1, None)], "k string, v int, t string")
    assert sorted(map(tuple, graph.latest(rows, ["k"], [F.col("v")]).collect()), key=str) == [("k", 2, "new"), ("l", 1, None)]


def test_closure_and_components(spark):
    edges = spark.createDataFrame([edge(str(i), a, b, label="SAME_AS") for i, (a, b) in enumerate([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "f")])], EDGE_SCHEMA)
    found = {r.id for r in graph.same_as_closure(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert found == {"a", "b", "c", "d", "e"}
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 100)], "a long, b long")
    got = {r.id: r.component for r in graph.components(links).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and got[100] == 100


def test_search_ranks_then_limits_and_tolerates_corrupt_properties(spark, nodes):
    edges = spark.createDataFrame([edge("1", "x", "a"), edge("2", "x", "b", tier="L5")], EDGE_SCHEMA)
    got = graph.query_graph(edges, nodes, "x", depth=1, limit=2, now=DAY(1)).collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].score == 0.5
    assert graph.crosslinks(spark.createDataFrame([edge("s", "a", "b", label="SAME_AS")], EDGE_SCHEMA), nodes, limit=1).count() == 2


def test_components_of_a_long_chain(spark):
    n = 20_000
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [tuple(r) for r in graph.components(links).groupBy("component").count().collect()] == [(0, n + 1)]
