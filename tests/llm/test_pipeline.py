"""The pipeline on planted cases, and its stages against what each is for."""

import random
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as C
from tiergraph.llm import queries as Q

WORDS = "the river runs under old stone bridges while children from a small town watch boats drift past every quiet winter morning and count them".split()


def prose(rng, n):
    out = [rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(n)]
    return ". ".join(" ".join(out[i : i + 11]).capitalize() for i in range(0, n, 11)) + "."


def corpus(tmp_path, spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 120), f"s{i % 4}") for i in range(200)]
    item = prose(rng, 25)
    near = rows[5][1].split()
    near[3] = "changed"
    rows += [(300, rows[5][1], "s1"), (301, " ".join(near), "s1"), (302, f"{prose(rng, 60)} {item} {prose(rng, 40)}", "s2"), (303, "junk### " * 80, "s0"), (304, f"{prose(rng, 80)} mail joe@corp.example.com or +1 212 555 0100 now. {prose(rng, 20)}", None), (305, None, "s0"), (306, "", "s0"), (5, rows[5][1], "s1"), (307, "too short", "s3")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return {i: t for i, t, _ in rows}


def test_stages_on_planted_cases(spark, tmp_path):
    texts = corpus(tmp_path, spark)
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name and (out.columns == columns or k == len(C.STAGES) - 1)
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = sorted(r.doc_id for r in docs.collect())
        if name == "pii":
            left = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert not {303, 305, 306, 307} & set(seen["quality_rules"]) and set(range(200)) <= set(seen["quality_rules"])
    assert set(seen["quality_rules"]) - set(seen["jaccard_join"]) == {300, 301} and seen["jaccard_join"].count(5) == 1
    assert set(seen["jaccard_join"]) - set(seen["decontaminate"]) == {302}
    assert "<EMAIL>" in left[304][0] and "<PHONE>" in left[304][0] and "joe@" not in left[304][0] and left[304][1] == len(left[304][0])
    assert all(left[i][0] == texts[i] for i in range(200))
    assert seen["mix_sources"] == seen["pii"]
    run = C.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_every_query_is_registered(spark):
    found = Q.queries()
    assert {int(n[2:].split("_")[0]) for n in found} == set(range(1, 11)) and set(Q.oracle_sql()) <= set(found)


def test_toxicity_query_learns_from_rows_that_are_not_held_out(spark, tmp_path):
    import zlib

    rng = random.Random(3)
    rows = [(i, prose(rng, 60) + (" vile nasty" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(800)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in Q.op8_toxicity(spark, str(tmp_path)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    right = [got[i].predicted == y for i, _, y in rows if got[i].held_out]  # held-out labels are wrong, and not learnt
    assert sum(right) / len(right) > 0.9


def test_stages_on_null_ids_repeats_and_odd_columns(spark, tmp_path):
    """Null ids and texts, repeated rows, a map, and columns named like the operators' own."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 90), f"s{i % 3}", 1, {"k": "v"}, "x", 3) for i in range(40)]
    rows += [(None, prose(rng, 90), None, 1, None, "x", 3), (None, None, "s0", None, {}, None, None), (3, rows[3][1], "s0", 2, {"a": "b"}, "y", 4), rows[5], (90, "", "s1", 0, {}, "z", 0), (91, ". ".join(" ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(11)) for _ in range(3000)) + ".", "s1", 0, {}, "z", 0)]
    schema = "doc_id long, text string, source string, n_chars long, meta map<string,string>, key string, n_words int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    kept = sorted(str(r.doc_id) for r in docs.collect())
    assert kept == sorted([*map(str, range(40)), "None", "91"])
    assert {r.doc_id: r.meta for r in docs.collect()}[7] == {"k": "v"}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "an item of some words to look for")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in C.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def kept_blocks(spark):
    """Shuffle files that are still on disk."""
    return {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}


def test_near_duplicates_keep_no_shuffle_files_and_no_passing_tables(spark, tmp_path):
    from tiergraph.llm._common import shared_dir, write_scratch

    corpus(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).where("doc_id <> 5")
    before = kept_blocks(spark)
    assert write_scratch(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    names = {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("tiergraph-*/*")}
    out = C.near_duplicates(spark, docs, str(tmp_path))
    made = kept_blocks(spark) - before
    #: What actions have shuffled (counts, a row a task) is all that may be left.
    assert len(made) <= 20, made
    left = {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("tiergraph-*/*")} - names
    assert not left & {"signed", "classes", "shared", "marks", "rows", "parts", "compared"}
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in out.collect()) == sorted({r.doc_id for r in docs.collect()} - {301})
