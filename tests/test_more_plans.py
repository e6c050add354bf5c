from pyspark.sql import functions as F

from tiergraph.operators import mapping
from tiergraph.plans import repository, verification


def test_verification(spark):
    rows = spark.createDataFrame([("the fee is ten dollars.", "ten dollars is the fee they said"), ("a b c d", "x"), ("", "y")], "claim string, evidence string")
    got = rows.select(verification.verify_overlap(F.col("claim"), F.col("evidence")).alias("v"), verification.make_question(F.col("claim")).alias("q")).collect()
    assert [r.v.verdict for r in got] == ["supports", "unknown", "unknown"] and got[0].q == "Is the following claim accurate: the fee is ten dollars?"
    votes = spark.createDataFrame([("supports", 0.8, None, "supports", 0.6, None), ("supports", 0.8, None, "refutes", 0.6, None), ("supports", 0.8, None, None, None, "timeout"), (None, None, "x", None, None, "y")], "a_verdict string, a_confidence double, a_error string, b_verdict string, b_confidence double, b_error string")
    assert [(r.verdict, round(r.confidence, 2), r.degraded) for r in verification.two_vendors(votes).collect()] == [("supports", 0.7, False), ("disagreement", 0.0, False), ("supports", 0.4, True), ("unknown", 0.0, False)]
    truth = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, None, False)], "case_id int, ground_truth string, minority_correct boolean")
    score = verification.score_resolver(spark.createDataFrame([(1, "a"), (2, "x")], "case_id int, picked string"), truth).first()
    assert (score.accuracy, score.minority_recall, score.abstained) == (0.6667, 0.0, 1)
    ranked = spark.createDataFrame([("q", "x", 2), ("r", "y", 1)], "query string, candidate string, place int")
    recall = {r.k: r.recall for r in verification.recall_at(ranked, spark.createDataFrame([("q", "x"), ("r", "y"), ("s", "z")], "query string, candidate string")).collect()}
    assert recall == {1: 0.3333, 5: 0.6667, 10: 0.6667}
    spans = spark.createDataFrame([("iowa dental", "dental school of iowa"), ("a", "b")], "a string, b string").select(verification.span_overlap(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 2) for r in spans] == [0.8, 0.0]
    assert verification.spend(spark.createDataFrame([("c", 1.5), ("d", 2.0)], "corpus_id string, cost double"), "c").first().total == 1.5


def test_mapping(spark):
    columns = spark.createDataFrame([("schools", c) for c in ("id", "name", "city")] + [("misc", "zzz")], "table_name string, column_name string")
    dictionary = spark.createDataFrame([("School", "name", "a name"), ("School", "city", "a city"), ("School", "id", "an id"), ("Topic", "name", "a label")], "node_type string, property string, text string")
    priors = spark.createDataFrame([("schools", "School")], "table_name string, node_type string")
    got = {r.table_name: r for r in mapping.suggest(columns, dictionary, priors, priors).collect()}
    assert got["schools"].target_type == "School" and got["schools"].routing == "auto" and "misc" not in got


def test_repository(spark):
    files = spark.createDataFrame(
        [
            ("docs/features/pull/requirements.md", "# Pull\n## Needs\nFR-1.2 pulls rows with `pull_rows()`.\nAC-1.2 holds.\n## Other\nnothing"),
            ("src/pull.py", "class Puller:\n    pass\n\ndef pull_rows(x):\n    return x\n"),
            ("tests/test_pull.py", "def test_it():\n    # FR-1.2, AC-1.2\n    assert True\n"),
        ],
        "path string, content string",
    )
    nodes = repository.parse_files(files)
    edges = repository.derive_edges(nodes)
    assert {r.kind for r in edges.collect()} == {"FEATURE_HAS_REQUIREMENT", "FEATURE_DOCUMENTED_BY", "REQUIREMENT_HAS_CRITERION", "TEST_COVERS_REQUIREMENT", "TEST_COVERS_CRITERION", "SECTION_REFERENCES_CODE"}
    assert [r.name for r in repository.docs_for_code(edges, nodes, "src/pull.py").collect()] == ["Needs"]
    changed = spark.createDataFrame([("src/pull.py",)], "path string")
    assert [r.path for r in repository.stale_docs(edges, nodes, changed).collect()] == ["docs/features/pull/requirements.md"]
    assert repository.plan_change(nodes, "how are rows pulled: needs").first().feature == "pull"
    assert tuple(repository.coverage(edges, nodes).first()) == ("pull", 1, 1)
