from tiergraph.operators.lexical_index import build_index
from tiergraph.plans import dossier as D


def corpus(spark, path):
    rows = [(f"d{i}", f"The dental tuition question number {i} is long enough. Other words here.", f"a{i % 7}", f"t{i % 5}", f"http://x/{i}", i) for i in range(12)]
    rows += [("junk", "removed tuition", "a1", "t1", "u", 1), ("far", "Nothing of that kind stands in this text at all.", "a2", "t2", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, author string, thread_id string, url string, score long")
    notes = [(f"n{i}", "SentimentAnnotation", "L5", '{"verdict": "%s"}' % ("positive" if i % 3 else "negative")) for i in range(12)]
    nodes = spark.createDataFrame(notes, "id string, label string, source_tier string, properties_json string")
    edges = spark.createDataFrame([("ANNOTATES", f"n{i}", f"d{i}") for i in range(12)], "label string, from_id string, to_id string")
    facts = spark.createDataFrame([("school:a", "tuition_resident", "100", "sheet"), ("school:b", "seats", "9", "sheet")], "subject string, predicate string, value string, source string")
    metrics = spark.createDataFrame([("s1", "Alpha", 10.0, 60, 0.5), ("s2", "Beta", 5.0, 60, None)], "school_id string, name string, max_tuition double, n_comments long, pos_frac double")
    return D.Corpus(docs, build_index(docs, str(path / "index"), id_col="doc_id", text_col="text"), nodes, edges, facts, metrics)


def test_answers(spark, tmp_path):
    c = corpus(spark, tmp_path)
    ranking = D.answer(c, "cheapest schools")
    assert ranking.kind == "ranking" and [r.school_id for r in ranking.tables["ranking"].orderBy("place").collect()] == ["s2", "s1"]
    assert "| 1 | Beta | $5 | — | 60 |" in D.rendered(ranking)
    found = D.answer(c, "what do people say on dental tuition", subjects=["school:a"])
    assert found.reason is None and {r.doc_id for r in found.tables["sources"].collect()} == {f"d{i}" for i in range(12)}
    assert {r.label: (r.numerator, r.denominator) for r in found.tables["sentiment"].collect()} == {"positive": (8, 12), "negative": (4, 12)}
    shown = D.rendered(found)
    assert "tuition resident: 100" in shown and "positive: 67% (8)" in shown and "seats" not in shown
    few = D.answer(c, "kind stands")
    assert few.kind == "abstained" and few.reason == "too_few_documents" and "too few documents" in D.rendered(few)
    anchored = D.answer(c, "kind stands", subjects=["school:b"])
    assert anchored.reason == "too_few_documents" and "sentiment" not in anchored.tables and "seats: 9" in D.rendered(anchored)
    named = D.evidence(c, "kind stands", named=spark.createDataFrame([("d3",)], "doc_id string"))
    assert {r.doc_id: (r.rank, r.sources) for r in named.collect()} == {"d3": (0, ["entity"]), "far": (1, ["lexical"])}
