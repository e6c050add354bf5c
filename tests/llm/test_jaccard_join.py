import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiergraph.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, node string, component string, sig long"
WORD = re.compile(r"[^ \t-\r]+")


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return set()
    size = min(width, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both * den >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts)[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(words) or 1)
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            words = words or ["w0"]
        else:
            words = rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 9, 14, 30, 70, 160]))
        texts.append(words)
    return [(i, rng.choice([" ", "\n", "\t "]).join(w if rng.random() < 0.9 else w.upper() for w in words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize(("width", "num", "den", "block", "most"), [(3, 9, 10, 512, 4096), (5, 4, 5, 512, 4), (3, 4, 5, 3, 2), (5, 4, 5, 2, 0)])
def test_components_equal_brute_force(spark, width, num, den, block, most):
    rows = corpus(width * den + block)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, width=width, num=num, den=den, block=block, most=most).collect()}
    assert got == brute(rows, width, num, den)


def test_nulls_empties_copies_and_other_columns(spark):
    long = " ".join(f"v{i % 977}" for i in range(60_000))
    rows = [(5, None, "x", "y", 1), (4, "", "x", "y", 1), (3, " \n", "x", "y", 1), (2, "A b", "x", "y", 1), (1, "a B", "x", "y", 1), (9, "solo", "x", "y", 1), (9, "solo", "x", "y", 1), (None, "a b", "x", "y", 1), (11, long, None, None, None), (10, long + " end", None, None, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, SCHEMA), width=3, num=9, den=10).collect() if r.doc_id is not None)
    assert [g[::2] for g in got] == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (9, 9), (9, 9), (10, 10), (11, 10)]
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (4, 5)):
        for _ in range(300):
            n = int(rng.integers(2, 400))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            most = (den - num) * 2 * n // (den + num)
            drop = int(rng.integers(0, most + 1)) // 2
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if both * den >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                mine, theirs = J.signatures(a, num, den), J.signatures(b, num, den)
                shared = max(len(np.intersect1d(x, y)) - max(m, n) for x, m in mine for y, n in theirs)
                assert shared >= 0


def test_lone_members_are_left_out_in_passing():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for _ in range(200):
        rows = sorted((int(a), int(b)) for a, b in rng.integers(0, 6, (int(rng.integers(0, 25)), 2)))
        cuts = sorted(rng.integers(0, len(rows) + 1, 3).tolist())
        batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        found = J._shared(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in b], pa.int64()), pa.array([r[1] for r in b], pa.int64())], ["sig", "c"]) for b in batches]))
        got = [tuple(r.values()) for b in found for r in b.to_pylist()]
        assert got == [r for r in sorted(set(rows)) if len({c for s, c in rows if s == r[0]}) > 1]


@pytest.mark.parametrize(("block", "most"), [(512, 4096), (3, 2)])
def test_classes_that_share_their_signature_bits_lose_no_link(spark, monkeypatch, block, most):
    """Signatures carry 63 bits of a set; here only five, so that many different sets share them."""
    whole = J._class
    monkeypatch.setattr(J, "_class", lambda s: whole(s) & 0x3E)
    rows = corpus(77, n=120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=4, den=5, block=block, most=most).collect()}
    assert got == brute(rows, 3, 4, 5)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_links_are_joined_up_by_one_task_or_in_rounds(spark, kind, monkeypatch):
    from tiergraph.llm import _components as K

    rng = random.Random(5)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long").select(*[F.col(c).cast(kind) for c in "ab"])
    rounds, star = [], K._small_star
    monkeypatch.setattr(K, "_small_star", lambda e: rounds.append(1) or star(e))
    alone = {tuple(r) for r in K.connected_components(edges).collect()}
    assert not rounds
    assert alone == {tuple(r) for r in K.connected_components(edges, alone=0).collect()} and rounds
    assert len(alone) == len({i for p in pairs if p[0] != p[1] for i in p}) and {c for n, c in alone if int(n) >= 200} == {type(next(iter(alone))[0])(200)}
