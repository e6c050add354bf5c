"""Vectors: cosine, top-k, floors, prototypes, clustering."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.runtime import in_blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(vectors: DataFrame, vec_col: str, query: Column, k: int, *, id_col: str) -> DataFrame:
    """The k best by cosine, ties by id; every partition keeps its k best, and those meet."""
    return vectors.withColumn("score", cosine(F.col(vec_col), query)).orderBy(F.desc("score"), id_col).limit(k)


def bands(scored: DataFrame, score: str, *, floor: float = 0.35, band: float = 0.05) -> Column:
    """keep, borderline, drop or no_vector."""
    s = F.col(score)
    return F.when(s.isNull(), "no_vector").when(s >= floor, "keep").when(s >= floor - band, "borderline").otherwise("drop")


def classify_counted(vectors: DataFrame, vec_col: str, id_col: str, prototypes: DataFrame, proto_col: str, name_col: str, *, min_sim: float = 0.15, block: int = 1000) -> DataFrame:
    """A row a bucket: n and fraction; what is below ``min_sim`` for all prototypes is unclear.

    Prototypes are a stated set that all vectors are held against, in blocks of about ``block``; a vector stays one row, with the best so far.
    """
    named = prototypes.select(F.col(proto_col).alias("p"), F.col(name_col).alias("b"))
    best = vectors.select(id_col, vec_col).withColumn("__best", F.lit(None).cast(f"struct<s:double,b:{named.schema['b'].dataType.simpleString()}>"))
    for part in in_blocks(named, block):
        packed = part.agg(F.collect_list(F.struct("p", "b")).alias("__protos"))  # one row
        here = F.array_max(F.transform("__protos", lambda x: F.struct(F.round(cosine(F.col(vec_col), x["p"]), 6).alias("s"), x["b"].alias("b"))))
        best = best.join(F.broadcast(packed)).withColumn("__best", F.greatest("__best", here)).drop("__protos")
    known = F.col("__best.s") >= min_sim
    return share(best.select(F.when(known, F.col("__best.b").cast("string")).otherwise("unclear").alias("bucket")), "bucket", digits=3)


def share(rows: DataFrame, by: str, *, digits: int = 4) -> DataFrame:
    """(by, n, fraction) of all rows."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), digits))


def hash_embed(text: str, dims: int = 384) -> np.ndarray:
    """A deterministic unit vector: 32-bit words of a chain of SHA-256 digests of the trimmed text, scaled to [-1, 1)."""
    chain = [hashlib.sha256((text or "").strip().encode()).digest()]
    while len(chain) * 8 < dims:
        chain.append(hashlib.sha256(chain[-1]).digest())
    v = np.frombuffer(b"".join(chain), ">u4")[:dims] / 2.0**31 - 1.0
    return v / (np.linalg.norm(v) or 1.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hash_embed(t or "").tolist())


def _spread(mat: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows to start from: each drawn by its distance to the nearest one drawn before."""
    chosen, nearest = [int(rng.integers(len(mat)))], np.full(len(mat), -np.inf)
    while len(chosen) < k:
        nearest = np.maximum(nearest, mat @ mat[chosen[-1]])
        odds = np.maximum(1 - nearest, 0)
        chosen.append(int(rng.choice(len(mat), p=odds / odds.sum() if odds.any() else None)))
    return mat[chosen]


def spherical_kmeans(mat: np.ndarray, k: int, seed: int = 0, iters: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of unit rows by cosine: rows go to the nearest centre, centres to the direction of their rows' sum, until no row moves."""
    centres, labels = _spread(mat, k, np.random.default_rng(seed)), None
    for _ in range(iters):
        nearest = (mat @ centres.T).argmax(axis=1)
        if labels is not None and np.array_equal(nearest, labels):
            break
        labels = nearest
        sums = (labels == np.arange(k)[:, None]).astype(float) @ mat
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1.0), centres)  # an empty cluster keeps its centre
    return labels, centres


def cluster(vectors: DataFrame, by: list[str], id_col: str, vec_col: str, *, k: int = 12, seed: int = 0) -> DataFrame:
    """(by, id, cluster) within groups that are bounded by what a question recalled."""
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in [*by, id_col])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        mat = np.stack(pdf[vec_col].map(lambda v: np.asarray(v, float)).to_list())
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)
        labels, _ = spherical_kmeans(mat, max(1, min(k, len(mat) // 5)), seed)
        return pdf[[*by, id_col]].assign(cluster=labels)

    return vectors.select(*by, id_col, vec_col).groupBy(*by).applyInPandas(run, f"{kinds}, cluster long")


def kmeans_scale(vectors: DataFrame, vec_col: str, *, k: int = 12, seed: int = 42) -> DataFrame:
    """Adds cluster: the distributed k-means by cosine, for whole corpora."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("__features", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster", distanceMeasure="cosine").fit(data)
    return model.transform(data).drop("__features")


def greedy_groups(vectors: list[np.ndarray], sim: float) -> list[list[int]]:
    """One pass: each unit vector joins the group whose mean direction is nearest, if that is similar enough, or opens one. Of equals the latest group wins."""
    groups: list[list[int]] = []
    sums = np.empty((0, len(vectors[0]) if len(vectors) else 0))
    for i, v in enumerate(vectors):
        near = (sums @ v) / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)
        if len(near) and near.max() >= sim:
            own = int(np.flatnonzero(near == near.max())[-1])
            groups[own].append(i)
            sums[own] += v
        else:
            groups.append([i])
            sums = np.vstack([sums, v])
    return groups


def signed_spectral(similar: np.ndarray, agree: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Labels from the signed Laplacian: similarity pulls together where verdicts agree, and pushes apart where they don't."""
    signed = similar * np.where(agree, 1.0, -1.0)
    np.fill_diagonal(signed, 0.0)
    laplacian = np.diag(np.abs(signed).sum(axis=1)) - signed
    _, vectors = np.linalg.eigh(laplacian)
    rows = vectors[:, :k]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return spherical_kmeans(rows, k, seed)[0]


def density_clusters(mat: np.ndarray, min_size: int = 5, radius: float = 0.35) -> np.ndarray:
    """Labels by density over cosine distance, -1 for noise: cores have ``min_size`` neighbours within ``radius``."""
    near = (1 - mat @ mat.T) <= radius
    core, labels, now = near.sum(axis=1) >= min_size, np.full(len(mat), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if labels[j] < 0:
                labels[j] = now
                if core[j]:
                    todo += np.flatnonzero(near[j] & (labels < 0)).tolist()
        now += 1
    return labels


def _signature(centroid: Column, dims: int, digits: int) -> Column:
    return F.array_join(F.transform(F.slice(centroid, 1, dims), lambda v: F.concat(F.format_string(f"%.{digits}f", v), F.lit("|"))), "")


def cluster_id(centroid: Column, label: Column) -> Column:
    """A cluster's lasting id: the digest of its centroid's first eight numbers and its label, whatever the case."""
    return F.concat(F.lit("cluster:"), F.substring(F.sha2(F.concat(_signature(centroid, 8, 6), F.lower(label)), 256), 1, 16))


def cluster_key(centroid: Column, samples: Column) -> Column:
    """What a cluster's label is cached under: the digest of its centroid and its sample texts, in any order."""
    return F.sha2(F.concat(_signature(centroid, 16, 4), F.array_join(F.array_sort(samples), "")), 256)
