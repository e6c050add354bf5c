import hashlib
import random
from collections import Counter

import pytest

from tiergraph.llm import suffix_dedup as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120, alphabet="abé "):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [make(rng.choice([60, 180, 210, 260, 700])) for _ in range(12)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.35 and texts and (old := rng.choice(texts)):
            at = rng.randrange(len(old))
            texts.append(old[:at] + rng.choice(["", "#", "x y"]) + old[at + rng.choice([0, 1]) :])
        elif kind < 0.4:
            texts.append(rng.choice(["a", "ab", "abc"]) * rng.choice([90, 100, 201, 400]))
        else:
            texts.append("".join(rng.choice([make(rng.choice([1, 9, 150])), rng.choice(passages)]) for _ in range(rng.choice([1, 2, 4]))))
    return texts


@pytest.mark.parametrize(("seed", "length", "hot"), [(1, 200, 50_000), (2, 40, 50_000), (3, 200, 3), (4, 64, 4)])
def test_equals_brute_force(spark, seed, length, hot):
    texts = corpus(seed)
    got = S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), length=length, hot=hot).collect()
    want = brute(texts, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_nulls_empties_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 512)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, None, 0), (2, "", 0), (None, "x" * 150, 0), (7, long, 0), (7, long, 0), (8, "z" + long[1000:1199] + "y", 0), (9, "z" + long[2000:2200] + "y", 0)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key long")).collect())
    assert got == Counter((i, *x) for (i, _, _), x in zip(rows, brute([r[1] for r in rows], 200), strict=True))
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_shallow_sort_orders_and_measures():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 3, 20, 21]))) + rng.choice([b"", b"tail" * 6]) for _ in range(rng.choice([1, 2, 30]))]
        order, common = S.deep_shallow_sort(strings, 16)
        assert [strings[i] for i in order] == sorted(strings)
        assert all(c == len(__import__("os").path.commonprefix([strings[a], strings[b]])) for a, b, c in zip(order, order[1:], common[1:], strict=False))


def test_rows_that_repeat_are_sorted_once(spark, monkeypatch):
    """Equal rows, ids and all, send one of them to the sorting tasks, however many there are."""
    import pyarrow as pa

    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(900))
    rows = [(7, long)] * 60 + [(8, "q" + long[:450] + "w" + long[451:])]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute([r[1] for r in rows], 200), strict=True))
    data = S.zstandard.ZstdCompressor().compress(long.encode())
    segs = [{"h": 1, "first": 0, "count": 3, "back": 1}]
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 60), pa.array([data] * 60), pa.array([segs] * 60)], ["key", "packed", "open"])
    assert sum(b.num_rows for b in S._contexts(200)(iter([batch, batch]))) == 1
