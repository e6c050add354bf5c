import hashlib
import math
import re
from collections import defaultdict

import duckdb
import pytest

from tiergraph.llm import mixing as M

WORD = re.compile(r"[^ \t-\r]+")


def brute(rows):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, (_, _, s) in zip(size, rows, strict=True):
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    rest = sum(total.values())
    while free:
        each = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * each >= 3 * total[s] - 1e-9]
        if not over:
            target |= {s: weight[s] * each for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= 3 * total[s]
            free.discard(s)
    return size, total, target


def rows_of(n, sources):
    return [(i, " ".join(["w"] * (1 + i * 7919 % 120)), sources[i % len(sources) if i % 3 else 0]) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["b", "a", None, "é", "z"], [f"s{i}" for i in range(40)]])
def test_targets_and_takes(spark, sources):
    rows = rows_of(400, sources)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in M.mix_sources(docs).collect()}
    size, total, target = brute(rows)
    taken = defaultdict(int)
    for n, (i, _, s) in zip(size, rows, strict=True):
        r = got[i]
        assert (r.size, r.source_size) == (n, total[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken <= 3 * n and r.taken % n == 0
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 120
    assert sorted(M.mix_sources(docs).collect()) == sorted(got.values())


def test_thresholds_are_those_of_a_sort(spark):
    rows = rows_of(300, ["x", "y"])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(con.sql(M.MIX_SQL.format(documents="documents")).fetchall())
    got = sorted(tuple(r) for r in M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, None, "a", 1, 2), (2, "", "a", 1, 2), (3, "x y", None, 1, 2), (3, "x y", None, 1, 2), (None, "z", "b", 1, 2), (None, "z z", "b", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int")
    got = M.mix_sources(docs).collect()
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 2, 2]
    assert {r.source_size for r in got if r.source == "a"} == {0} and {r.target for r in got if r.source == "a"} == {0.0}
    assert len({r.taken for r in got if r.doc_id == 3}) == 1
    assert M.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_hash_is_the_first_sixty_bits_of_md5(spark):
    want = int(hashlib.md5(b"17 x y").hexdigest()[:15], 16)
    frame = spark.createDataFrame([(17, "x y")], "id long, t string")
    assert frame.select(M.row_hash(frame.id, frame.t)).first()[0] == want


def test_rows_that_share_an_id_are_told_apart_by_their_texts(spark):
    rows = [(7, f"w{i} " + "w " * (i % 40), "a" if i % 4 else "b") for i in range(400)]
    got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, total, target = brute(rows)
    for s in total:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 41


def test_very_long_texts(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "x" * 500_000, "a"), (3, "y " * 10, "b")]
    got = {r.doc_id: r for r in M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i: r.size for i, r in got.items()} == {1: 300_000, 2: 1, 3: 10} and all(r.taken <= 3 * r.size for r in got.values())
