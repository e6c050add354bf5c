"""Token counts with a digest cache.

A count depends on nothing but a text and a tokenizer version, so counts are kept
in a table under the pair of their digests. A run joins its texts' digests to the
stored counts, encodes each distinct missing text once, and appends what it learnt;
a later run over grown data encodes only what is new.

Normalised content is the text with null as the empty text, encoded as UTF-8:
nothing else may change, as the counts must be those of the text itself.

Defined results: null and empty texts count 0 bytes and 0 tokens; equal texts share
one encoding; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import bounded_batches, scratch_path, write_scratch

CACHE_SCHEMA = "tokenizer string, digest string, n_bytes long, n_tokens long"
#: Characters that are encoded in one call, to bound a worker's memory.
BATCH_CHARS = 1 << 20
#: Pieces whose counts a worker remembers, and the longest of them.
PIECES, LONGEST = 1 << 20, 64
#: Fixed value: how a byte-level vocabulary cuts a text into pieces, which it then encodes one by one.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_version(path: str) -> str:
    """The digest of the vocabulary file and of the library's version."""
    name = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{name} {__import__(name).__version__}\n".encode() + f.read()).hexdigest()


class PieceCounter:
    """texts -> token counts, as the sum of their pieces' counts, each of which the library gives once.

    Holds for vocabularies that cut a text into pieces and encode these apart
    (``fits``). The library's own cut is taken as reference: each character that comes up is
    asked for once, and a text with one that it classes otherwise, or with an added
    token's string, is left to the library as a whole.
    """

    def __init__(self, tokenizer, added: list[str]) -> None:
        self.tokenizer = tokenizer
        self.added = added
        self.cut = regex.compile(PIECE).findall
        self.known: dict[str, int] = {}
        self.classed: set[str] = set()
        self.odd: set[str] = set()

    @staticmethod
    def fits(config: dict) -> bool:
        before, model = config["pre_tokenizer"] or {}, config["model"]
        plain = config["normalizer"] is None and config["post_processor"] is None and model["type"] == "BPE" and not model.get("dropout")
        return plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", False)

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def agrees(self, text: str) -> bool:
        """Whether the library cuts the text as PIECE does: after a letter, a digit and a sign, each character shows its class."""
        found = set(text)
        for c in found - self.classed:
            self.classed.add(c)
            if any(len(self.cut(x + c)) != len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + c)) for x in "a1!"):
                self.odd.add(c)
        return not (self.odd and self.odd & found) and not any(x in text for x in self.added)

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.cut(x) if self.agrees(x) else None for x in texts]
        new = list({p for found in cut if found for p in found if p not in self.known})
        now = dict(zip(new, self.encoded(new), strict=True))
        known = self.known
        whole = iter(self.encoded([x for x, found in zip(texts, cut, strict=True) if found is None]))
        counts = [next(whole) if found is None else sum(known[p] if p in known else now[p] for p in found) for found in cut]
        if len(known) + len(now) > PIECES:
            known.clear()
        known.update((p, n) for p, n in now.items() if len(p) <= LONGEST)
        return counts


def load_counter(path: str):
    """texts -> token counts, without added special tokens, as the file's library gives them."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        counter = PieceCounter(tokenizer, [x["content"] for x in config["added_tokens"]])
        return counter if counter.fits(config) else counter.encoded
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        seen: set[str] = set()  # rows that repeat, id and all, meet in one task
        for batch in batches:
            digests, n_bytes, sizes, held, size = [], [], [], [], 0
            for digest, text, n in zip(*(batch.column(c) for c in ("digest", "text", "n_bytes")), strict=True):
                if (key := digest.as_py()) in seen:
                    continue
                seen.add(key)
                digests.append(key)
                n_bytes.append(n.as_py())
                held.append(text.as_py())
                size += len(held[-1])
                if size >= BATCH_CHARS:
                    sizes += count(held)
                    held, size = [], 0
            sizes += count(held) if held else []
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(n_bytes, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: id, digest, n_bytes, n_tokens, over_limit.

    ``cache_path`` names the cache table (Parquet, appended to); without one the run
    starts an empty cache of its own in the shared folder. The vocabulary file must
    be at ``tokenizer_path`` on every executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokenizer_version(tokenizer_path)
    path = cache_path or scratch_path(spark, "token_cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)

    def cache() -> DataFrame:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version)
        return stored.groupBy("digest").agg(F.min("n_bytes").alias("n_bytes"), F.min("n_tokens").alias("n_tokens"))  # two runs may have stored the same digest

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    ids = texts.select("doc_id", "digest")
    #: Of equal texts the one with the least row key is encoded; only keys are grouped, never texts.
    keyed = texts.withColumn("row", F.xxhash64(F.col("doc_id").cast("string")))
    keys = keyed.select("digest", "row")
    misses = keys.join(cache().select("digest"), "digest", "left_anti") if cache_path else keys
    chosen = misses.groupBy("digest").agg(F.min("row").alias("row"))
    todo = keyed.join(chosen.hint("shuffle_hash"), ["digest", "row"], "left_semi").select("digest", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    todo.mapInArrow(_counts(tokenizer_path), "digest string, n_bytes long, n_tokens long").select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(path)
    #: Written, so that the join may split a digest that copies make frequent.
    return ids.join(write_scratch(cache(), "counts"), "digest").select("doc_id", "digest", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
