import random

import public_tokenizers
import pytest

from tiergraph.llm import token_counts as T

TEXTS = ["Hello world", "", None, "naïve — 漢字 \n\n  spaces", "<|endoftext|> inside", "Hello world", "x" * 70_000, "a b " * 20_000]


def brute(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        return lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    import sentencepiece

    return lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    rows = [(i, t, 3) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 3), (None, "no id", 3), (None, "no id", 3)]
    count = brute(name)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = T.count_tokens(docs, public_tokenizers.path(name), limit=100).collect()
    want = sorted((str(i), len((t or "").encode()), n := count(t or ""), n > 100) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path(name)).count() == 0


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    T.count_tokens(first, path, cache_path=cache).collect()
    assert spark.read.parquet(cache).count() == 2
    second = first.union(spark.createDataFrame([(4, "four"), (5, "three")], "doc_id long, text string"))
    assert T.count_tokens(second, path, cache_path=cache).count() == 5
    stored = spark.read.parquet(cache)
    assert stored.count() == 3 == stored.select("digest").distinct().count()
    T.count_tokens(first, public_tokenizers.path("word_bpe_49k.json"), cache_path=cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_pieces_add_up_to_the_librarys_counts():
    """Every character but surrogates, in every company: what the library classes otherwise goes to it whole."""
    counter = T.load_counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert isinstance(counter, T.PieceCounter)
    draw = random.Random(3)
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    common = list("abzßéДж漢字अ12٣½²Ⅷ _'\u2019.,!?-\t\n\r\x0b\x1c\x85\u00a0\u2003\u200b\u3000\ufeff") + ["'s", "'ll", "  ", "\n\n"]
    texts = ["".join(draw.choice(every if draw.random() < 0.1 else common) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["".join(every[i : i + 500]) for i in range(0, len(every), 500)] + ["a<|endoftext|>b", " <|endoftext|>"]
    assert counter(texts) == counter.encoded(texts)
    assert counter(texts[::-1]) == counter.encoded(texts[::-1])


def test_pieces_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(T, "PIECES", 50)
    counter = T.load_counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"word{i} {'y' * i}" for i in range(100)]
    assert [counter([t])[0] for t in texts] == counter.encoded(texts)
    assert len(counter.known) <= 50 + 4 and max(map(len, counter.known)) <= T.LONGEST
