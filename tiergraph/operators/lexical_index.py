"""A lexical index over a corpus: built once as tables, read by a query for its own terms alone.

Layout: ``postings`` has segments, one a stretch of documents. In a segment a term is one row,
with the documents that have it and how often; rows are dealt into slices by term and sorted
by it, so that files and row groups of other terms are skipped by their statistics, and a
frequent term spans all segments. ``documents`` has lengths, ``norms`` the lengths of TF-IDF
vectors, ``corpus`` one row of figures. Ids are to be unique.

Segments are written where their texts are read: no posting is shuffled to build them. Norms need
every term's frequency, so the slices are shuffled once for them, some at a time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiergraph.operators.retrieval import query_terms
from tiergraph.runtime import write_lean

#: Slices of the postings, by term; DOCUMENTS is the slice of the documents themselves.
SLICES = DOCUMENTS = 16
#: A segment is closed when it has so many words or documents.
SEGMENT_WORDS, SEGMENT_DOCS = 1 << 21, 1 << 16
#: Postings whose norms are added up at a time, until every slice has a pass of its own.
PASS_POSTINGS = 1 << 23


@dataclass(frozen=True)
class LexicalIndex:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(_schema(self.table("documents").schema["id"].dataType.simpleString())).parquet(f"{self.path}/postings")

    def frequencies(self, terms: list[str]) -> DataFrame:
        """(term, df) of a query's terms."""
        return self.postings().where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("df"))

    def found(self, terms: list[str]) -> DataFrame:
        """(term, id, tf, length) of a query's terms; pairs have no length."""
        rows = self.postings().where(F.col("term").isin(terms))
        zipped = F.arrays_zip(F.col("ids"), F.col("tfs"), F.coalesce("lengths", F.array().cast("array<long>")).alias("lengths"))
        return rows.select("term", F.explode(zipped).alias("h")).select("term", F.col("h.ids").alias("id"), F.col("h.tfs").alias("tf"), F.col("h.lengths").alias("length"))

    def hits(self, terms: list[str]) -> DataFrame:
        """(term, id, tf, length, df, docs, mean) of a query's terms: two pushed-down reads and two broadcasts of a few rows."""
        return self.found(terms).join(F.broadcast(self.frequencies(terms)), "term").join(F.broadcast(self.table("corpus")))

    def bm25(self, query: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) by BM25."""
        found = self.hits(query_terms(query))
        idf = F.greatest(F.lit(1e-6), F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        return found.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))

    def tfidf(self, query: str) -> DataFrame:
        """(id, score): cosine of the TF-IDF vectors of words of two characters and more, and of their pairs; scores above 0."""
        words = re.findall(r"[a-z0-9]{2,}", query.lower())
        wanted = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        counts = [(t, 1 + math.log(wanted.count(t))) for t in dict.fromkeys(wanted)]
        asked = self.spark.createDataFrame(counts or [("", 0.0)], "term string, qtf double")
        weight = F.ln((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0
        terms = self.frequencies([t for t, _ in counts]).join(F.broadcast(asked), "term").join(F.broadcast(self.table("corpus")))
        weighed = terms.select("term", weight.alias("idf"), (F.col("qtf") * weight).alias("qw"))
        #: The query's terms, a handful.
        weighed = weighed.withColumn("qnorm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy(F.lit(1)))))
        found = self.found([t for t, _ in counts]).join(F.broadcast(weighed), "term")
        part = (1 + F.ln(F.col("tf").cast("double"))) * F.col("idf") * F.col("qw")
        scored = found.groupBy("id").agg(F.sum(part).alias("dot"), F.max("qnorm").alias("qnorm"))
        return scored.where("dot > 0").join(self.table("norms"), "id").select("id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))


def _schema(kind: str) -> str:
    return f"slice int, term string, n long, ids array<{kind}>, tfs array<int>, lengths array<long>"


def _segment(ids: list, known: dict[str, int], codes: list[np.ndarray], kind: pa.DataType, pairs: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a segment: of its documents, of their words and, if asked for, of pairs of neighbours among words of two characters and more."""
    own, lengths = pa.array(ids, kind), np.array([len(c) for c in codes], np.int64)
    n, size, words, doc = len(ids), len(known), np.concatenate(codes).astype(np.int64), np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
    names = ["slice", "term", "n", "ids", "tfs", "lengths"]

    def lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    yield pa.RecordBatch.from_arrays([pa.array([DOCUMENTS], pa.int32()), pa.nulls(1, pa.string()), pa.array([n], pa.int64()), lists(own, [0, n]), pa.nulls(1, pa.list_(pa.int32())), lists(pa.array(lengths), [0, n])], names)
    vocabulary, digest = pa.array(list(known), pa.string()), np.array([zlib.crc32(w.encode()) for w in known], np.int64)

    def rows(keys: np.ndarray, terms, digests, with_lengths: bool) -> Iterator[pa.RecordBatch]:
        held, tf = np.unique(keys, return_counts=True)
        term, at = held // n, held % n
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        ends = np.append(first, len(term))
        for i in range(0, len(first), 1 << 14):
            e = ends[i : i + (1 << 14) + 1]
            which, inside = term[e[:-1]], slice(e[0], e[-1])
            sizes = pa.array(lengths[at[inside]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests(which) % SLICES, pa.int32()), terms(which), pa.array(np.diff(e), pa.int64()), lists(own.take(pa.array(at[inside])), e - e[0]), lists(pa.array(tf[inside], pa.int32()), e - e[0])]
                + [lists(sizes, e - e[0]) if with_lengths else pa.nulls(len(which), pa.list_(pa.int64()))],
                names,
            )

    yield from rows(words * n + doc, lambda x: vocabulary.take(pa.array(x)), lambda x: digest[x], True)
    if pairs:
        long = np.array([len(w) > 1 for w in known], bool)[words]
        words, doc = words[long], doc[long]
        beside = doc[1:] == doc[:-1]
        keys = (words[:-1][beside] * size + words[1:][beside]) * n + doc[1:][beside]
        yield from rows(keys, lambda x: pc.binary_join_element_wise(vocabulary.take(pa.array(x // size)), vocabulary.take(pa.array(x % size)), " "), lambda x: digest[x // size] * 31 + digest[x % size], False)


def _segments(pairs: bool):
    """(id, text) -> rows of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, codes, held, kind = [], {}, [], 0, None
        for batch in batches:
            kind = batch.column("id").type
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                said = re.findall("[a-z0-9]+", text.as_py())
                codes.append(np.array([known.setdefault(w, len(known)) for w in said], np.int32))
                ids.append(key)
                held += len(said)
                if held >= SEGMENT_WORDS or len(ids) >= SEGMENT_DOCS:
                    yield from _segment(ids, known, codes, kind, pairs)
                    ids, known, codes, held = [], {}, [], 0
        if ids:
            yield from _segment(ids, known, codes, kind, pairs)

    return run


def build_index(docs: DataFrame, path: str, *, id_col: str, text_col: str, norms: bool = True) -> LexicalIndex:
    """Writes the index of whole texts below ``path``. Null and empty texts count as documents without terms.

    Without norms it has words alone, which is what BM25 reads.
    """
    spark, index = docs.sparkSession, LexicalIndex(docs.sparkSession, path)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    schema = _schema(texts.schema["id"].dataType.simpleString())
    rows = texts.mapInArrow(_segments(norms), schema).sortWithinPartitions("slice", "term")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("slice").parquet(f"{path}/postings")
    own = spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("slice") == DOCUMENTS)
    own.select(F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select(F.col("d.ids").alias("id"), F.col("d.lengths").alias("length")).write.mode("overwrite").parquet(f"{path}/documents")
    index.table("documents").agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/corpus")
    if not norms:
        return index
    corpus = index.table("corpus").first()
    passes = int(min(SLICES, max(1, 2 * corpus.docs * (corpus.mean or 0) // PASS_POSTINGS)))
    for i in range(passes):
        #: Pairs and words of two characters and more have a part in the norm.
        some = index.postings().where((F.col("slice") < SLICES) & (F.col("slice") % passes == i) & (F.length("term") >= 2))
        idf = F.ln((1.0 + corpus.docs) / (1.0 + F.col("df"))) + 1.0
        weighed = some.select("term", "ids", "tfs").join(some.groupBy("term").agg(F.sum("n").alias("df")), "term")
        each = weighed.select(idf.alias("idf"), F.explode(F.arrays_zip("ids", "tfs")).alias("h"))
        square = F.pow((1 + F.ln(F.col("h.tfs").cast("double"))) * F.col("idf"), 2)
        write_lean(each.groupBy(F.col("h.ids").alias("id")).agg(F.sum(square).alias("square")), f"{path}/squares/pass={i}")
    added = spark.read.parquet(f"{path}/squares").groupBy("id").agg(F.sqrt(F.sum("square")).alias("norm"))
    write_lean(added, f"{path}/norms")
    return index
