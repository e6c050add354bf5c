"""Index, plans, recall, sheets, pages and files, against brute force or planted rows."""

import hashlib
import random
import re
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tiergraph.operators import filters, mapping, recall, resolution, retrieval, vectors
from tiergraph.operators.lexical_index import build_index
from tiergraph.plans import planner
from tiergraph.sources import connectors, official, web

NOW = datetime(2024, 1, 1)


def test_index_scores_as_a_scan_does(spark, tmp_path):
    rng = random.Random(2)
    words = ["aa", "bb", "cc", "d", "the", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(80)] + [(900, None), (901, ""), (902, "the aa the aa")]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = build_index(docs, str(tmp_path / "index"), id_col="id", text_col="text")
    for question in ("the aa", "d", "x1 bb cc bb", "nothing", ""):
        plain = lambda df: sorted(map(tuple, df.collect()))
        assert plain(index.tfidf(question)) == plain(retrieval.tfidf_scores(docs, question, id_col="id", text_col="text"))
        if question:
            assert plain(index.bm25(question)) == plain(retrieval.bm25(docs, question, id_col="id", text_col="text"))
    plan = index.hits(["the"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term,the)" in plan
    assert build_index(docs.limit(0), str(tmp_path / "none"), id_col="id", text_col="text").bm25("the").count() == 0


def test_plans():
    assert planner.heuristic_plan("how do applicants view NYU") == planner.Plan()
    both = planner.heuristic_plan("Cheapest schools that applicants also like")
    assert [(x.op, x.order, x.k) for x in both.ops] == [("rank_tuition", "asc", 30), ("rank_sentiment", "desc", 50)] and (both.combine, both.sort_by) == ("intersect", "tuition")
    assert [(x.order, x.k) for x in planner.heuristic_plan("worst reviewed schools").ops] == [("asc", 15)]
    assert planner.parsed_plan("no json") is None and planner.parsed_plan('{"ops": 3}') is None and planner.parsed_plan("{bad}") is None
    richer = lambda q: 'here: {"ops": [{"op": "rank_tuition", "order": "asc", "k": 3}, {"op": "rank_sentiment"}]}'
    assert len(planner.plan_query("cheapest schools", richer).ops) == 2 and len(planner.plan_query("cheapest schools").ops) == 1


def test_plan_results(spark):
    rows = [(f"s{i}", f"n{i}", None if i == 3 else float(i), 10 if i == 4 else 60, None if i == 5 else i / 10) for i in range(8)]
    metrics = spark.createDataFrame(rows, "school_id string, name string, max_tuition double, n_comments long, pos_frac double")
    run = lambda q: [(r.place, r.school_id) for r in planner.execute_plan(planner.heuristic_plan(q), metrics).orderBy("place").collect()]
    assert run("cheapest schools") == list(enumerate(["s0", "s1", "s2", "s4", "s5", "s6", "s7"], 1))
    assert run("cheapest schools that people also like") == list(enumerate(["s0", "s1", "s2", "s6", "s7"], 1))
    assert run("best reviewed schools")[0] == (1, "s7") and run("weather") == []


def test_recall(spark):
    nodes = spark.createDataFrame(
        [("c1", "Claim", "L1", '{"school_id": "school:a"}'), ("c2", "Claim", "L5", '{"resolved_school_id": "school:a"}'), ("c3", "Claim", "L1", None), ("school:a", "School", "L1", '{"name": "Alpha Dental"}'), ("p1", "Post", "L5", "bad"), ("p2", "Comment", "L4", '{"title": "t", "body": "b", "name": ""}')],
        "id string, label string, source_tier string, properties_json string",
    )
    edges = spark.createDataFrame([("EXTRACTED_FROM", "c2", "p1"), ("EXTRACTED_FROM", "c3", "p2"), ("IN_CLUSTER", "p1", "k2"), ("IN_CLUSTER", "p1", "k1")], "label string, from_id string, to_id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(recall.official_claims(nodes, ["school:a"])) == ["c1"] and ids(recall.official_claims(nodes, [])) == []
    assert ids(recall.claimed_posts(nodes, edges, ["school:a"])) == ["p1"]
    assert ids(recall.schools_named(nodes, "the ALPHA one")) == ["school:a"] and ids(recall.schools_named(nodes, "a be")) == []
    found = {r.id: r.properties for r in recall.node_properties(nodes, spark.createDataFrame([("p1",), ("c1",), ("none",)], "id string")).collect()}
    assert found["c1"] == {"school_id": "school:a"} and not found["p1"] and not found["none"]
    assert {(r.id, r.cluster_id) for r in recall.post_clusters(edges).collect()} == {("p1", "k1")}
    assert {r.id: r.text for r in recall.node_texts(nodes).collect()}["p2"] == "p2 t b"
    claims = spark.createDataFrame([(i, s) for i, s in enumerate(["school:x", "UCLA", " ucla ", "Penn", "", None, "program of things"])], "claim_id long, subject_id string")
    aliases = spark.createDataFrame([("UCLA", "school:ucla"), ("ucla", "school:other"), ("penn", "school:penn"), (None, "z")], "alias string, entity_id string")
    got = {r.claim_id: r.subject_id for r in recall.canonical_subjects(claims, aliases).collect()}
    assert got == {0: "school:x", 1: "school:ucla", 2: "school:other", 3: "school:penn", 4: "", 5: None, 6: "program of things"}
    closure = spark.createDataFrame([("r", "p1"), ("r", "p2")], "root string, id string")
    assert [(r.root, r.id) for r in recall.canonical_entity(nodes, closure).collect()] == [("r", "p2")]
    rows = spark.createDataFrame([("a", 2), ("b", 1), ("a", 0)], "k string, at long")
    assert sorted((r.k, r.at) for r in recall.ordered_distinct(rows, "k", "at").collect()) == [("a", 0), ("b", 1)]


def test_cluster_ids(spark):
    frame = spark.createDataFrame([([0.5, -1.0], "Label", ["b", "a"])], "c array<double>, l string, s array<string>")
    got = frame.select(vectors.cluster_id(F.col("c"), F.col("l")).alias("i"), vectors.cluster_key(F.col("c"), F.col("s")).alias("k")).first()
    assert got.i == "cluster:" + hashlib.sha256(b"0.500000|-1.000000|label").hexdigest()[:16]
    assert got.k == hashlib.sha256(b"0.5000|-1.0000|ab").hexdigest()


def test_sheets(spark):
    rows = [("one", 0, ["Table 1"]), ("one", 2, ["x", "Dental School", "State", "City", "Tuition (a)", None]), ("one", 3, ["", "Alpha", "IA", "c", "$1,200", "9"]), ("one", 4, ["", "", "IA", "c", "5", "9"]), ("two", 0, ["nothing here"])]
    sheet = spark.createDataFrame(rows, "sheet string, row int, cells array<string>")
    heads = official.sheet_headers(sheet).collect()
    assert [(h.sheet, h.header_row, h.school_at, h.state_at, [(m.at, m.name) for m in h.metrics]) for h in heads] == [("one", 2, 1, 2, [(0, "x"), (4, "Tuition (a)")])]
    values = official.sheet_values(sheet, official.sheet_headers(sheet)).collect()
    assert [(v.school, v.state, v.metric_name, v.metric_value) for v in values] == [("Alpha", "IA", "Tuition (a)", 1200.0)]


def test_tagged_pages(spark):
    pages = spark.createDataFrame([("p1", "u1", "w " * 600), ("p2", "u2", None)], "page_id string, url string, body string")
    mentions = spark.createDataFrame([("p1", "e1", "E", 96.0), ("p1", "e1", "E", 80.0), ("p1", "e2", "F", 80.0), ("p2", "e3", "G", 10.0)], "page_id string, entity_id string, name string, score double")
    nodes, edges, reviews = web.tag_pages(pages, mentions, spark.createDataFrame([("e1",)], "id string"), tier="L3", now=NOW)
    assert sorted((r.label, r.id.split(":")[0]) for r in nodes.collect()) == [("Chunk", "chunk"), ("Chunk", "chunk"), ("Entity", "e2")]
    assert sorted((r.label, r.confidence) for r in edges.collect()) == [("HAS_CHUNK", 1.0), ("HAS_CHUNK", 1.0), ("MENTIONS", 0.8), ("MENTIONS", 0.96)]
    assert [(r.page_id, r.entity_id, r.score) for r in reviews.collect()] == [("p1", "e2", 80.0)]
    many = spark.createDataFrame([(f"u{i}", str(i)) for i in range(25)], "url string, content_hash string")
    groups = web.page_groups(many, 10).collect()
    assert sorted(u for g in groups for u in g.members) == sorted(f"u{i}" for i in range(25)) and max(len(g.members) for g in groups) <= 10
    assert web.within_budget(10, spent=4.995, cap=5.0)[0] is False and web.within_budget(10, spent=0, cap=5.0)[0] is True
    html = spark.createDataFrame([("p", '<img src="a.png"><img src="a.png"><table><tr><td>1</td></tr></table>')], "page_id string, html string")
    assert web.media_assets(html, tier="L3", now=NOW)[1].count() == 1 and web.page_tables(html, tier="L3", now=NOW)[0].count() == 1


def test_files_by_content(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (tmp_path / name).write_text(text)
    none = spark.createDataFrame([], "content_hash string")
    first = connectors.local_files(spark, str(tmp_path), none).select("path", "content_hash").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in first) == ["a.txt", "c.txt"]
    seen = spark.createDataFrame([(r.content_hash,) for r in first], "content_hash string")
    assert connectors.local_files(spark, str(tmp_path), seen).count() == 0
    sizes = connectors.batched(spark.range(0, 25, 1, 2), 10).groupBy("batch").count().collect()
    assert sum(r["count"] for r in sizes) == 25 and max(r["count"] for r in sizes) <= 10


@pytest.mark.parametrize("seed", [1, 2])
def test_aliases_match_as_all_pairs_do(spark, seed):
    """Recall of the blocking against brute force: all of it."""
    from tiergraph.functions.similarity import token_set_ratio

    rng = random.Random(seed)
    words = ["iowa", "ohio", "state", "university", "college", "dental", "of", "medicine", "new"]
    name = lambda: " ".join(rng.sample(words, rng.randrange(1, 5)))
    aliases = [(f"e{i}", name()) for i in range(40)]
    mentions = [(i, name()) for i in range(60)]
    got = {r.mention_id: r.score for r in resolution.match_aliases(spark.createDataFrame(mentions, "mention_id long, mention string"), spark.createDataFrame(aliases, "entity_id string, alias string")).collect()}
    want = {}
    for i, m in mentions:
        best = max(round(token_set_ratio(m, a), 4) for _, a in aliases)
        if best >= 95:
            want[i] = best
    assert got == want


def test_stated_sets_of_any_size_are_held_against_all_rows_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    point = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = spark.createDataFrame([(i, point(), f"t{i}") for i in range(40)], "id long, v array<double>, t string")
    protos = spark.createDataFrame([(f"b{i}", point()) for i in range(11)], "b string, p array<double>")
    run = lambda block: sorted(map(tuple, vectors.classify_counted(rows, "v", "id", protos, "p", "b", block=block).collect()))
    assert run(3) == run(1000) and sum(r[1] for r in run(3)) == 40
    assert [tuple(r) for r in vectors.classify_counted(rows, "v", "id", protos.limit(0), "p", "b").collect()] == [("unclear", 40, 1.0)]
    blocked = protos.select(F.col("b").alias("x"), "p")
    sift = lambda: sorted(r.id for r in filters.blocklist(rows, "t", blocked, "x", vectors=("v", "p"), limit=0.6).collect())
    whole = sift()
    monkeypatch.setattr(filters, "BLOCK", 2)
    assert sift() == whole and 0 < len(whole) < 40
    columns = spark.createDataFrame([("s", c) for c in ("id", "name", "citty")], "table_name string, column_name string")
    dictionary = spark.createDataFrame([(f"N{i}", x, x) for i, x in enumerate(["id", "name", "city", "state", "year"])], "node_type string, property string, text string")
    found = lambda block: sorted(map(tuple, mapping.column_matches(columns, dictionary, block=block).collect()))
    assert found(2) == found(100) and len(found(2)) >= 2


def test_links_are_those_of_all_pairs(spark):
    """Recall of the linker's blocking against brute force: all of it."""
    rng = random.Random(11)
    words = ["iowa", "ohio", "state", "university", "dental", "college", "of", "medicine", "north", "south"]
    name = lambda: " ".join(rng.sample(words, rng.randrange(2, 5)))
    new = spark.createDataFrame([(f"n{i}", rng.choice("ab"), name()) for i in range(25)], "id string, kind string, name string")
    universe = spark.createDataFrame([(f"u{i}", rng.choice("ab"), name()) for i in range(40)], "id string, kind string, name string")
    pairs = new.crossJoin(universe.select(F.col("id").alias("rid"), F.col("kind").alias("rkind"), F.col("name").alias("rname"))).where("kind = rkind and id <> rid")
    scored = pairs.withColumn("like", resolution._likeness("name", "rname")).where("like.lexical >= 0.5")
    scored = scored.withColumn("score", F.round(resolution.link_score(F.col("like.lexical"), F.col("like.cosine"), F.col("name"), F.col("rname")), 4)).where(F.col("score") >= resolution.REVIEW)
    best = {}
    for r in sorted(scored.collect(), key=lambda r: (r.id, -r.score, r.rid)):
        best.setdefault(r.id, []).append((min(r.id, r.rid), max(r.id, r.rid), r.score))
    want = sorted(x for rows in best.values() for x in rows[:3])
    got = sorted((r.low_id, r.high_id, r.score) for r in resolution.link_entities(new, universe, top_k=3).collect())
    assert want and got == want


def test_index_of_many_segments_and_passes_keeps_no_shuffle_files(spark, tmp_path, monkeypatch):
    from tiergraph.operators import lexical_index as L

    monkeypatch.setattr(L, "PASS_POSTINGS", 300)
    rng = random.Random(4)
    rows = [(f"k{i}", " ".join(rng.choice(["aa", "Bb", "cc", "d", "the", "x1", "q,7"]) for _ in range(rng.randrange(0, 30)))) for i in range(120)] + [("k900", None)]
    docs = spark.createDataFrame(rows, "id string, text string")
    blocks = lambda: {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = blocks()
    index = build_index(docs, str(tmp_path / "index"), id_col="id", text_col="text")
    assert len(list((tmp_path / "index" / "squares").glob("pass=*"))) > 3
    #: The row of figures is gathered once; no posting is.
    assert len(blocks() - before) <= 20 and not (tmp_path / "index" / "counts").exists()
    plain = lambda df: sorted(map(tuple, df.collect()))
    lean = build_index(docs, str(tmp_path / "lean"), id_col="id", text_col="text", norms=False)
    assert lean.postings().where("term like '% %'").isEmpty() and not (tmp_path / "lean" / "norms").exists()
    for question in ("the aa", "d q 7", "x1 bb cc bb"):
        assert plain(index.tfidf(question)) == plain(retrieval.tfidf_scores(docs, question, id_col="id", text_col="text"))
        assert plain(index.bm25(question)) == plain(lean.bm25(question)) == plain(retrieval.bm25(docs, question, id_col="id", text_col="text"))


def _links_of_all_pairs(new, universe, top):
    """link_score for each pair by itself, with the cosine."""
    from tiergraph.functions.nearest import round4
    from tiergraph.functions.similarity import token_set_ratio
    from tiergraph.operators.vectors import hash_embed

    def domain(name):
        words = set(re.findall("[a-z0-9]+", name.lower()))
        return next((d for d, known in resolution.DOMAINS.items() if words & set(known)), None)

    found = []
    for i, kind, name in new:
        rows = []
        for j, other_kind, other in universe:
            if kind != other_kind or i == j:
                continue
            lexical, cosine = token_set_ratio(name.lower(), other.lower()) / 100.0, float(hash_embed(name) @ hash_embed(other))
            score = lexical if lexical >= 0.95 else max(0.95 * lexical, 0.7 * lexical + 0.3 * max(0.0, cosine))
            domains = {domain(name), domain(other)} - {None}
            score = float(round4(np.array([score * (resolution.CROSS_DOMAIN if len(domains) == 2 else 1)]))[0])
            if score >= resolution.REVIEW:
                rows.append((-score, j))
        found += [(min(i, j), max(i, j), -s) for s, j in sorted(rows)[:top]]
    return sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_links_in_blocks_are_those_of_all_pairs_of_any_names(spark, monkeypatch, seed):
    """Names of one word, of shared, misspelt and repeated words, of more than 64 characters; small blocks; entities that are on both sides."""
    from tiergraph.functions import nearest

    rng = random.Random(seed)
    words = ["iowa", "Ohio", "state", "university", "universty", "dental", "of", "medicine", "law", "é", "x" * 70, "a", "b"]
    shapes = [
        lambda: f"Supplier#{rng.randrange(300):06d}",
        lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))),
        lambda: "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 9))),
        lambda: "".join(rng.choice("abc  ") for _ in range(rng.randrange(60, 150))),
    ]
    name = lambda: rng.choice(shapes)()
    new = [(f"n{i}", rng.choice("ab"), name()) for i in range(30)]
    universe = [(f"u{i}", rng.choice("abc"), name()) for i in range(150)] + new[:10]
    for module, key, value in ((resolution, "NEW_BLOCK", 20), (resolution, "UNIVERSE_BLOCK", 60)):
        monkeypatch.setattr(module, key, value)
    schema = "id string, kind string, name string"
    frames = [spark.createDataFrame(rows, schema) for rows in (new + [("null", "a", None)], universe + [("null", "a", None)])]
    got = sorted((r.low_id, r.high_id, r.score) for r in resolution.link_entities(*frames, top_k=4).collect())
    want = _links_of_all_pairs(new, universe, 4)
    assert want and got == want
    #: The same in one process, with each bound on what is held at once forced.
    tables = [pd.DataFrame(new, columns=["rid", "kind", "name"])[["kind", "name"]].drop_duplicates(), pd.DataFrame(universe, columns=["rid", "kind", "name"])]
    run = lambda: sorted(resolution._best_of_block(*tables, 5).itertuples(index=False, name=None))
    whole = run()
    for key, value in (("BATCH", 3), ("FRONT", 50), ("GATHERED", 4), ("MOST_WORDS", 2)):
        monkeypatch.setattr(nearest, key, value)
    assert run() == whole


def test_links_between_names_without_a_common_word(spark):
    schema = "id string, kind string, name string"
    links = resolution.link_entities(spark.createDataFrame([("a", "org", "Universiti")], schema), spark.createDataFrame([("b", "org", "University"), ("c", "org", "Hospital")], schema))
    assert [tuple(r) for r in links.collect()] == [("a", "b", 0.855, "hitl")]


def test_names_that_all_share_a_word_are_not_scored_pair_by_pair(monkeypatch):
    from tiergraph.functions import nearest

    scored, add = [], nearest.Search._add
    monkeypatch.setattr(nearest.Search, "_add", lambda self, given, *rest: (scored.append(len(given)), add(self, given, *rest))[1])
    new = pd.DataFrame([("org", f"Supplier#{i:09d}") for i in range(300)], columns=["kind", "name"])
    universe = pd.DataFrame([("org", f"Supplier#{i:09d}", f"c{i}") for i in range(20_000)], columns=["kind", "name", "rid"])
    best = resolution._best_of_block(new, universe, 11)
    assert len(best) == 3_300 and (best[best["score"] == 1.0]["__rid"].str[1:].astype(int) < 300).sum() == 300
    assert sum(scored) < 300 * 20_000 / 20
