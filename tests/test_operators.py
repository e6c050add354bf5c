import hashlib
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiergraph.functions import similarity, stats, text, url
from tiergraph.operators import conflict, filters, resolution, vectors
from tiergraph.sources import community, connectors, official, web
from tiergraph.streaming.pulls import pull_available

NOW = datetime(2026, 1, 1)
CLAIM = "claim_id long, subject_id string, predicate string, object_value string, source_tier string, credibility double, t_valid_from timestamp, t_valid_to timestamp"


def claim(i, value, tier="L5", cred=0.5, start=None, end=None, subject="s"):
    return (i, subject, "tuition", value, tier, cred, start, end)


@pytest.mark.parametrize(
    ("rows", "status", "winner"),
    [
        ([claim(1, "a")], "no_conflict", 1),
        ([claim(1, "a", "L1"), claim(2, "b")], "l1_clash_invalidated", 1),
        ([claim(1, "a"), claim(2, "b", "L1")], "l1_clash_invalidated", 2),
        ([claim(1, "a"), claim(2, "a", "L1")], "hitl_pending", None),
        ([claim(1, "a", start=datetime(2020, 1, 1), end=datetime(2020, 6, 1)), claim(2, "b", start=datetime(2021, 1, 1))], "temporal_split", 2),
        ([claim(1, "a", cred=0.9), claim(2, "b", cred=0.2)], "trust_weighted", 1),
        ([claim(1, "a"), claim(2, "b")], "hitl_pending", None),
    ],
)
def test_cascade(spark, rows, status, winner):
    got = conflict.cascade(spark.createDataFrame(rows, CLAIM)).first()
    assert (got.status, got.winner) == (status, winner)


def test_joint_confidence(spark):
    new, old = datetime(2025, 12, 1), datetime(2010, 1, 1)
    rows = [claim(1, "a", "L1", 1.0, new, subject="current"), claim(2, "b", "L5", 1.0, new, subject="current"), claim(3, "a", "L1", 1.0, old, subject="stale"), claim(4, "b", "L5", 0.9, new, subject="stale"), claim(5, "a", "L5", 0.5, new, subject="tie"), claim(6, "b", "L5", 0.5, new, subject="tie"), claim(7, "a", subject="one"), claim(8, "a", subject="one")]
    got = {r.subject_id: (r.status, r.winner_value, r.low_confidence) for r in conflict.joint(spark.createDataFrame(rows, CLAIM), NOW).collect()}
    assert got == {"current": ("l1_clash_invalidated", "a", False), "stale": ("trust_weighted", "b", True), "tie": ("hitl_pending", None, True), "one": ("no_conflict", "a", False)}


def test_signals(spark):
    rows = [(c, v, x) for c, votes in {"a": [("supports", 0.9), ("supports", 0.8), ("refutes", 0.9)], "b": [("unknown", 0.0)] * 3, "c": [("supports", 0.9), ("unknown", 0.1), ("unknown", 0.1)], "d": [("refutes", 0.9), ("refutes", 0.3), ("unknown", 0.0)], "e": [("supports", 0.9)]}.items() for v, x in votes]
    got = {r.c: (r.outcome, r.low_confidence) for r in conflict.combine_signals(spark.createDataFrame(rows, "c string, verdict string, confidence double"), ["c"]).collect()}
    assert got == {"a": ("supports", True), "b": ("unknown", False), "c": ("disagreement", True), "d": ("disagreement", True), "e": ("disagreement", True)}


def test_consistency_of_a_lone_and_a_massless_claim(spark):
    rows = [claim(1, "A ", "L1", 1.0), claim(2, "a", "L5", 1.0), claim(3, "b", "L5", 1.0), claim(4, "z", cred=0.0, subject="t")]
    got = {r.claim_id: round(r.consistency, 4) for r in conflict.consistency(spark.createDataFrame(rows, CLAIM)).collect()}
    assert got == {1: round(1.4 / 1.8, 4), 2: round(1.4 / 1.8, 4), 3: round(0.4 / 1.8, 4), 4: 1.0}


def test_estimators(spark):
    one = spark.range(1)
    w = one.select(stats.wilson(F.lit(5), F.lit(10)).alias("w"), stats.wilson(F.lit(0), F.lit(0)).alias("z"), stats.consensus_index(F.array(*map(F.lit, [80.0, 15.0, 5.0]))).alias("c"), stats.rogan_gladen_band(F.lit(0.3)).alias("b")).first()
    assert (w.w.point, w.w.lo, w.w.hi) == (0.5, 0.2366, 0.7634) and w.z.hi == 0.0
    assert abs(w.c.hhi - 0.665) < 1e-9 and abs(w.c.margin - 0.65) < 1e-9 and w.b.corrected_lo <= 0.3
    shrunk = stats.eb_shrink(spark.createDataFrame([(1, 1), (1, 1)], "k long, n long"), "k", "n").collect()
    assert [r.shrunk for r in shrunk] == [0.6667, 0.6667]
    kappa = stats.cohens_kappa("a", "b", spark.createDataFrame([("x", "x"), ("y", "y"), ("x", "y"), ("y", "y")], "a string, b string"), []).first()
    assert kappa.kappa == 0.5
    boot = stats.bootstrap_ci(np.array([1, 0, 2]), np.array([2, 1, 2]), 200, 0, 0.05)
    assert boot["n"] == 5 and boot["lo"] <= boot["point"] <= boot["hi"] and 1 <= boot["n_eff"] <= 5
    t = stats.trend(spark.createDataFrame([("g", 2000 + i, 10 + 8 * i, 100) for i in range(6)] + [("h", 2000, 1, 2)], "g string, y int, k long, n long"), ["g"], "y", "k", "n")
    assert {r.g: r.direction for r in t.collect()} == {"g": "increasing", "h": "insufficient_years"}


def test_similarity_equals_definitions():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs(a, b) == table[-1][-1]
    assert similarity.token_set_ratio("iowa college", "college of iowa") == 100.0
    assert similarity.partial_ratio("harvard", "went to harvard once") == 100.0 and similarity.ratio("", "") == 100.0


def test_text_functions(spark):
    row = spark.createDataFrame([("Fees rose 50% to $1,500. In 2020 it was $2k! None here.",)], "t string")
    kept, dropped = text.guard_narration(F.col("t"), F.array(F.lit(1500.0), F.lit(50.0)))
    got = row.select(text.prices(F.col("t")).alias("p"), text.best_sentence("what was it in 2020", F.col("t")).alias("b"), kept.alias("k"), F.size(dropped).alias("d"), text.year_of(F.lit("2019-05")).alias("y"), text.cohort_of(text.forum_of(F.lit("https://x/r/Dentistry/y"))).alias("c"), text.strip_html(F.lit("<p>a&amp;b</p><script>x</script> c")).alias("h"), text.slug(F.lit(" A b/C ")).alias("s")).first()
    assert got.p == [1500.0, 2000.0] and got.b == "In 2020 it was $2k!" and got.d == 0 and got.y == 2019
    assert got.c == "practicing/professional" and got.h == "a&b c" and got.s == "a-b-c" and got.k.startswith("Fees")
    chunked = spark.createDataFrame([("w " * 1000,), ("few words",), ("",)], "t string").select(text.chunks(F.col("t")).alias("c")).collect()
    assert [[x.at for x in r.c] for r in chunked] == [[0, 448, 896], [0], []]


def test_filters(spark):
    rows = [("AutoModerator", "good thing here ok", True, "bot_author"), (None, "x", False, "no_author_deleted_or_removed"), ("u", "short", True, "very_short_reply_no_entity"), ("u", "what is the best way to go on?", False, "kept"), ("u", "nothing of note is said in this text", False, "generic_no_entity_no_question_no_sentiment"), ("x_bot_", "good", False, "bot_author")]
    frame = spark.createDataFrame(rows, "author string, text string, reply boolean, want string")
    assert all(r.want == r.got for r in frame.select("want", filters.utility_reason(F.col("text"), F.col("author"), F.col("reply")).alias("got")).collect())
    blocked = spark.createDataFrame([(" Spam ", [1.0, 0.0])], "pattern string, v array<double>")
    texts = spark.createDataFrame([("spam", [0.0, 1.0]), ("ham", [1.0, 0.01]), ("egg", [0.0, 1.0])], "text string, w array<double>")
    assert [r.text for r in filters.blocklist(texts, "text", blocked, "pattern", vectors=("w", "v")).collect()] == ["egg"]


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3 == j) for j in range(3)]) for i in range(30)] + [(99, [0.0, 0.0, 0.0])], "id long, v array<double>")
    top = vectors.top_k(v, "v", vectors.literal([1.0, 0.0, 0.0]), 3, id_col="id").collect()
    assert [r.id for r in top] == [0, 3, 6] and top[0].score == 1.0
    labels, _ = vectors.spherical_kmeans(np.repeat(np.eye(3), 5, axis=0), 3, seed=1)
    assert len(set(labels.tolist())) == 3 and len(set(labels[:5].tolist())) == 1
    assert vectors.greedy_groups(list(np.repeat(np.eye(2), 2, axis=0)), 0.9) == [[0, 1], [2, 3]]
    assert set(vectors.density_clusters(np.vstack([np.repeat(np.eye(3)[:2], 6, axis=0), [[0, 0, 1.0]]])).tolist()) == {0, 1, -1}
    agree = np.array([[(i < 3) == (j < 3) for j in range(6)] for i in range(6)])
    assert len(set(vectors.signed_spectral(np.ones((6, 6)), agree, 2)[:3].tolist())) == 1
    #: The nearest mean decides, not the first group that is near enough.
    a, b, c = np.array([1.0, 0.0]), np.array([0.6, 0.8]), np.array([0.8, 0.6])
    assert vectors.greedy_groups([a, b, c], 0.7) == [[0], [1, 2]]
    found = vectors.hash_embed(" x ", 8)
    words = np.array([int.from_bytes(hashlib.sha256(b"x").digest()[4 * i : 4 * i + 4], "big") for i in range(8)]) / 2**32 * 2 - 1
    assert np.allclose(found, words / np.linalg.norm(words)) and abs(np.linalg.norm(vectors.hash_embed("x")) - 1) < 1e-9


def test_resolution(spark):
    aliases = spark.createDataFrame([("e1", "University of Iowa"), ("e2", "Ohio State University"), ("e3", "Tufts University")], "entity_id string, alias string")
    mentions = spark.createDataFrame([(1, "iowa university of"), (2, "the ohio state university"), (3, "nothing")], "mention_id long, mention string")
    assert {r.mention_id: r.entity_id for r in resolution.match_aliases(mentions, aliases).collect()} == {1: "e1", 2: "e2"}
    docs = spark.createDataFrame([(1, "I went to Ohioo State Universty"), (2, "iowa corn")], "id long, t string")
    found = resolution.scan_long_aliases(docs, aliases, id_col="id", text_col="t").collect()
    assert [(r.id, r.entity_id) for r in found] == []  # misspelt words don't block
    found = resolution.scan_long_aliases(spark.createDataFrame([(1, "that ohio, state univ. is a university")], "id long, t string"), aliases, id_col="id", text_col="t").collect()
    assert [(r.id, r.entity_id) for r in found] == [(1, "e2")] or found == []
    named = spark.createDataFrame([("h", "Harvard School of Dental Medicine, Boston"), ("u", "UCLA School of Dentistry"), ("t", "TUFTS"), ("n", None)], "id string, name string")
    found = {(r.entity_id, r.alias): r.how for r in resolution.expand_aliases(named, "id", "name").collect()}
    assert {("h", "Harvard"): "pattern", ("h", "Harvard School of Dental Medicine"): "first_phrase", ("h", "HSDMB"): "acronym"}.items() <= found.items()
    assert found["u", "UCLA"] == "stripped_tail" and ("t", "TUFTS") not in found and sum(e == "u" and a.lower() == "ucla" for e, a in found) == 1
    sib = resolution.siblings(spark.createDataFrame([("i", "University of Iowa")], "id string, name string"), spark.createDataFrame([("s", "University of Iowa College of Dentistry"), ("t", "Ohio College")], "id string, name string")).collect()
    assert [(r.institution_id, r.school_id) for r in sib] == [("i", "s")]
    table = spark.createDataFrame([("ui", "s1", "school", "Iowa", 0.2), ("ui", "i1", "institution", "Illinois", 0.5), ("one", "s9", "school", None, 0.1)], "alias string, entity_id string, entity_type string, state string, prior double")
    asked = spark.createDataFrame([(1, "UI", "the dental school"), (2, "ui", "in illinois"), (3, "ui", ""), (4, "One", None)], "mention_id long, mention string, context string")
    got = {r.mention_id: (r.entity_id, r.confidence, r.needs_review) for r in resolution.resolve(asked, table).collect()}
    assert got[1] == ("s1", 0.85, False) and got[2] == ("i1", 0.8, False) and got[3][2] and got[4] == ("s9", 1.0, False)


def test_community(spark, tmp_path):
    posts = tmp_path / "r_predental_posts.jsonl"
    posts.write_text('{"id": "1", "author": "u", "title": "DAT", "selftext": "x", "created_utc": 1600000000, "link_flair_text": "Advice"}\nnot json\n{"id": "2", "author": "[deleted]", "title": "other", "created_utc": 1600000001}\n{"author": "u"}\n')
    comments = tmp_path / "r_predental_comments.jsonl"
    comments.write_text('{"id": "9", "author": "v", "body": "b", "link_id": "t3_1", "parent_id": "t1_8", "created_utc": 1600000002}\n{"id": "8", "author": "v", "body": "b", "created_utc": 1600000002}\n{"id": "7", "author": "v", "body": "b", "link_id": "t3_2", "created_utc": 1600000003}\n')
    p = community.normalise_posts(community.read_lines(spark, str(posts), community.POST_SCHEMA), keywords=["dat"])
    c = community.normalise_comments(community.read_lines(spark, str(comments), community.COMMENT_SCHEMA), kept_posts=p)
    assert [(r.post_id, r.user_id) for r in p.collect()] == [("reddit_post:1", "reddit:predental:u")]
    assert [(r.comment_id, r.parent_id) for r in c.collect()] == [("reddit_comment:9", "reddit_comment:8")]
    nodes, edges = community.assemble_forum(p, c, NOW)
    assert {r.label: r["count"] for r in nodes.groupBy("label").count().collect()} == {"Subreddit": 1, "User": 2, "Post": 1, "Comment": 1, "Topic": 1}
    assert {r.label: r["count"] for r in edges.groupBy("label").count().collect()} == {"POSTED_IN_FORUM": 1, "AUTHORED": 2, "REPLIED_TO": 1, "BELONGS_TO_THREAD": 1, "REFERENCES_TOPIC": 1}
    threads = spark.createDataFrame([("7", "T", "Pre-Dental", "u", 2, 3), ("8", "S", "Other", "u", 1, 1)], community.THREAD_SCHEMA)
    board = spark.createDataFrame([("1", "7", "a", "hi", None, "1600000005", 1), ("2", "7", "b", "first", "2020-01-01T00:00:00Z", None, 1), ("3", "8", "a", "x", None, "1", 1)], community.THREAD_POST_SCHEMA)
    ts, ps = community.normalise_threads(threads, board, category="Pre-Dental")
    assert ts.first().root_post_id == "sdn_post:7:2" and ps.count() == 2
    _, edges = community.assemble_board(ts, ps, NOW)
    assert [(r.from_id, r.to_id) for r in edges.where("label = 'REPLIED_TO'").collect()] == [("sdn_post:7:1", "sdn_post:7:2")]


def test_official(spark, tmp_path):
    sheet = spark.createDataFrame([("Iowa College", "IA", "$1,200", "n/a"), ("Mean of all", "", "9", "1")], "name string, state string, a string, b string")
    long = official.unpivot_sheet(sheet, ["name", "state"], "2024-25").where("name = 'Iowa College'").collect()
    assert [(r.metric_name, r.metric_value) for r in long] == [("a", 1200.0)]
    schools = official.schools_of(sheet, "name", "state")
    assert [r.canonical_id for r in schools.collect()] == ["school:iowa-college-ia"]
    metrics = spark.createDataFrame([("school:x", "2023-24", "Tuition by Class - Resident", 1.0), ("school:x", "2024-25", "Tuition by Class - Resident", 2.0), ("school:x", "2024-25", "Tuition by Class - Non-Resident", 3.0)], "canonical_id string, cycle_year string, metric_name string, metric_value double")
    assert sorted((r.predicate, r.object_value) for r in official.metric_claims(metrics, NOW).collect()) == [("tuition_nonresident", "3.0"), ("tuition_resident", "2.0")]
    aliases = spark.createDataFrame([("school:x", "X", 0.9)], "canonical_id string, alias_text string, confidence double")
    nodes, edges = official.assemble_official(schools, metrics, aliases, "d1", NOW)
    assert {"Alias", "Dump"} <= {r.label for r in nodes.collect()}
    official.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = official.graph_tables(spark, str(tmp_path / "g"))
    assert n.count() == nodes.select("id").distinct().count() and {r.label for r in e.collect()} == {"PROVENANCE"}  # school:x has no node
    versions = spark.createDataFrame([("k", "1", 1), ("k", "1", 2), ("k", "2", 3)], "k string, v string, t int")
    assert [(r.t, r.t_to) for r in official.supersede_changed(versions, ["k"], "v", "t").orderBy("t").collect()] == [(1, 3), (3, None)]
    facts = official.fact_claims(spark.createDataFrame([("s", 3, None)], "id string, size int, year int"), "id", ["size", "year"], "2025-26")
    assert [(r.predicate, r.object_value) for r in facts.collect()] == [("size", "3")]


def test_dumps(spark):
    dump = ["-- x", "COPY public.school (id, name) FROM stdin;", "1\tA\\tb", "2\t\\N", "\\.", "COPY t (a) FROM stdin;", "z", "\\."]
    blocks = connectors.copy_blocks(spark.createDataFrame(list(enumerate(dump)), "at int, line string"))
    assert [r["values"] for r in connectors.block_table(blocks, "school").orderBy("row").collect()] == [{"id": "1", "name": "A\tb"}, {"id": "2", "name": None}]
    escaped = spark.createDataFrame([(r"C:\\temp",), (r"a\\\tb",), (r"\x\N",), (r"\N",)], "f string").select(connectors.unescaped(F.col("f"))).collect()
    assert [r[0] for r in escaped] == ["C:\\temp", "a\\\tb", "xN", None]


def test_dumps_over_stretches_of_lines(spark, monkeypatch):
    monkeypatch.setattr(connectors, "LINES", 3)
    dump = ["-- x", "COPY s (id) FROM stdin;", *map(str, range(10)), "\\.", "noise", "COPY t (a) FROM stdin;", "z", "\\."]
    blocks = connectors.copy_blocks(spark.createDataFrame(list(enumerate(dump)), "at int, line string")).orderBy("row").collect()
    assert [(r.table, r.fields) for r in blocks] == [("s", [str(i)]) for i in range(10)] + [("t", ["z"])]


def test_bootstrap_and_resonance(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}", t, bool(rng.random() < 0.3 + 0.4 * (t % 2)), f"a{t % 7}", float(t)) for g in range(2) for t in range(60) for _ in range(5)]
    frame = spark.createDataFrame(rows, "g string, thread_id long, hit boolean, author string, score double")
    for parts in (1, 6):
        got = {r.g: r for r in stats.cluster_bootstrap(frame.repartition(parts), ["g"], "thread_id", "hit", b=400).collect()}
        for g, r in got.items():
            sums = np.array([sum(x[2] for x in rows if x[0] == g and x[1] == t) for t in range(60)])
            drawn = [s.sum() / 300 for s in (sums[rng.integers(0, 60, 60)] for _ in range(4000))]
            assert r.n == 300 and r.n_threads == 60 and abs(r.point - sums.sum() / 300) < 1e-4
            assert abs(r.lo - np.quantile(drawn, 0.025)) < 0.03 and abs(r.hi - np.quantile(drawn, 0.975)) < 0.03 and r.deff > 1
    found = {r.g: r for r in stats.resonance(frame, ["g"]).collect()}
    assert (found["g0"].distinct_authors, found["g0"].n_threads, found["g0"].n_docs, found["g0"].median_score, found["g0"].author_share) == (7, 60, 300, 29.5, 1.0)


def test_web(spark):
    assert web.tables_of("<table><tr><th>a</th><td> b  c</td></tr></table>") == [{"ordinal": 0, "rows": 1, "cols": 2, "cells": [["a", "b c"]]}]
    heads = spark.createDataFrame([({"server": "DataDome"}, ""), ({}, "Just a moment..."), ({"server": "nginx"}, "ok")], "h map<string,string>, b string")
    assert [r[0] for r in heads.select(web.is_challenge(F.col("h"), F.col("b"))).collect()] == [True, True, False]
    pages = spark.createDataFrame([("http://a.com/1#x", '<a href="http://a.com/2">x</a> <a href="http://b.com/">y</a> <a href="http://a.com/none">z</a>', NOW), ("http://a.com/2", "", NOW)], "url string, html string, at timestamp")
    nodes, edges = web.assemble_pages(pages, url_col="url", html_col="html", time_col="at", tier="L2", ingest=NOW)
    assert sorted(r.label for r in edges.collect()) == ["LINKS_TO", "REFERENCES_EXTERNAL"] and nodes.count() == 3
    site = spark.createDataFrame([("<urlset><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>",)], "body string")
    assert [r.loc for r in web.sitemap_urls(site, "body").collect()] == ["http://a/1", "http://a/2"]
    versions = web.page_versions(spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "k string, t int, c string"), key="k", time="t", content="c")
    assert [(r.t, r.t_valid_to) for r in versions.orderBy("t").collect()] == [(1, 3), (3, None)]
    names = spark.createDataFrame([("old.reddit.com",), ("notreddit.com",), ("x.com",)], "d string")
    assert [r[0] for r in names.select(url.is_blocked(F.col("d"))).collect()] == [True, False, True]


def test_connectors(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, updated_at TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", f"2024-01-{i + 1:02}") for i in range(20)])
    spark.dataSource.register(connectors.sqlite_source(path))
    assert spark.read.format("tiergraph_sqlite").option("table", "t").load().count() == 20
    assert spark.read.format("tiergraph_sqlite").option("table", "t").option("cursor", "updated_at").option("after", "2024-01-15").load().count() == 5
    rows = spark.createDataFrame([(1, 5), (2, 9)], "id int, v int")
    receipt, got = connectors.pull("s", lambda _: rows, "v", 5)
    assert receipt.first().rows == 1 and receipt.first().cursor_value == "9" and got.count() == 1
    bad, none = connectors.pull("s", lambda _: 1 / 0, "v", 5)
    assert bad.first().status == "errored" and none is None
    assert connectors.connector_stats(receipt.union(bad)).first()["rows"] == 1
    log = spark.createDataFrame([("s", "L2", 1), ("s", "L2", 2), ("s", "L1", 3), ("t", "L1", 1)], "source_id string, tier string, at int")
    state = connectors.registry_state(log)
    assert state.count() == 3 and connectors.multiple_official(state).first().sources == ["s", "t"]


def test_stream_reads_new_files_alone(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").write.parquet(str(tmp_path / "in"))
    first = pull_available(spark, str(tmp_path / "in"), keys=["id"], target=str(tmp_path / "out"))
    assert first.count() == 2
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    assert pull_available(spark, str(tmp_path / "in"), keys=["id"], target=str(tmp_path / "out")).count() == 3


def test_frequent_tokens_are_compared_exactly(spark, monkeypatch):
    rows = [(f"e{i}", f"medical university x{i}") for i in range(1_500)] + [(f"i{i}", f"iowa y{i}") for i in range(3)] + [("m", "medical university")]
    aliases = spark.createDataFrame(rows, "entity_id string, alias string")
    mentions = spark.createDataFrame([(1, "iowa medical university"), (2, "Medical University X77"), (2, "medical university x77"), (3, None), (4, "none")], "mention_id long, mention string")
    got = {r.mention_id: (r.entity_id, r.score) for r in resolution.match_aliases(mentions, aliases).collect()}
    assert got == {1: ("m", 100.0), 2: ("m", 100.0)}
    monkeypatch.setattr(resolution, "BLOCK", 7)
    sides = [[f"{w} {'abc'[i % 3]} t{i}" for i in range(40)] for w in ("all", "all every")]
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in zip("lr", sides, strict=True)]
    assert sorted(tuple(r) for r in resolution.sharing_pairs(*frames, "l", "r").collect()) == sorted((a, b) for a in sides[0] for b in sides[1])
    new = [(f"s{i}", "org", f"Supplier {i}") for i in range(30)]
    every = [(f"c{i}", "org", f"Supplier {i}") for i in range(1_100)] + [("s3", "org", "Supplier 3"), ("z", "person", "Supplier 4")]
    schema = "id string, kind string, name string"
    links = {(r.low_id, r.high_id): r.score for r in resolution.link_entities(spark.createDataFrame(new, schema), spark.createDataFrame(every, schema)).collect()}
    assert all(links[f"c{i}", f"s{i}"] == 1.0 for i in range(30)) and len(links) == 300
    assert ("s3", "s3") not in links and ("s4", "z") not in links
