"""Verification of claims against evidence, and evaluation of resolvers. Search itself is left to a provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least overlap that supports a claim, and the most confidence it gives.
LEAST_OVERLAP, MOST_CONFIDENCE, EXCERPT = 0.30, 0.95, 200


def make_question(claim: Column) -> Column:
    """A claim as a question."""
    clean = F.rtrim(F.trim(claim), F.lit(".?!"))
    asks = F.lower(clean).rlike(r"^(is|are|was|were|does|did|do) ")
    return F.when(asks, F.concat(clean, F.lit("?"))).otherwise(F.concat(F.lit("Is the following claim accurate: "), clean, F.lit("?")))


def verify_overlap(claim: Column, evidence: Column) -> Column:
    """struct(verdict, confidence, excerpt): supports if the evidence has enough of the claim's words, else unknown."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    own = words(claim)
    overlap = F.when(F.size(own) > 0, F.size(F.array_intersect(own, words(evidence))) / F.size(own)).otherwise(0.0)
    supports = overlap >= LEAST_OVERLAP
    return F.struct(F.when(supports, "supports").otherwise("unknown").alias("verdict"), F.when(supports, F.least(overlap, F.lit(MOST_CONFIDENCE))).otherwise(overlap).alias("confidence"), F.substring(F.coalesce(evidence, F.lit("")), 1, EXCERPT).alias("excerpt"))


def two_vendors(rows: DataFrame) -> DataFrame:
    """Adds verdict, confidence, degraded from a_verdict, a_confidence, a_error and the same of b.

    Agreement averages, one failure halves the other's confidence, disagreement and two failures give none.
    """
    a, b = F.col("a_error").isNull(), F.col("b_error").isNull()
    same = F.col("a_verdict") == F.col("b_verdict")
    verdict = F.when(~a & ~b, "unknown").when(a & ~b, F.col("a_verdict")).when(~a & b, F.col("b_verdict")).when(same, F.col("a_verdict")).otherwise("disagreement")
    confidence = F.when(~a & ~b, 0.0).when(a & ~b, F.col("a_confidence") * 0.5).when(~a & b, F.col("b_confidence") * 0.5).when(same, (F.col("a_confidence") + F.col("b_confidence")) / 2).otherwise(0.0)
    return rows.withColumns({"verdict": verdict, "confidence": confidence, "degraded": a != b})


def spend(costs: DataFrame, corpus: str | None = None) -> DataFrame:
    """(total) of what searches have cost, of one corpus or of all."""
    kept = costs if corpus is None else costs.where(F.col("corpus_id") == corpus)
    return kept.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total"))


def score_resolver(picked: DataFrame, truth: DataFrame) -> DataFrame:
    """(accuracy, minority_recall, abstained) of a resolver's picks (case_id, picked) against cases (case_id, ground_truth, minority_correct)."""
    joined = truth.join(picked, "case_id", "left").withColumn("hit", F.col("picked").eqNullSafe(F.col("ground_truth")))
    minority = F.avg(F.when(F.col("minority_correct"), F.col("hit").cast("double")))
    return joined.agg(F.round(F.avg(F.col("hit").cast("double")), 4).alias("accuracy"), F.round(F.coalesce(minority, F.lit(0.0)), 4).alias("minority_recall"), F.sum(F.col("picked").isNull().cast("long")).alias("abstained"))


def recall_at(ranked: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, recall): how often the right candidate is among the first k. ranked: query, candidate, place; positives: query, candidate."""
    hits = positives.join(ranked, ["query", "candidate"], "left").select(F.coalesce("place", F.lit(1 << 30)).alias("place"))
    return hits.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "place").groupBy("k").agg(F.round(F.avg((F.col("place") <= F.col("k")).cast("double")), 4).alias("recall"))


def span_overlap(a: Column, b: Column) -> Column:
    """The larger of the Jaccard index of two spans' words and 0.8 of how much of the shorter one the other holds."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    both = F.size(F.array_intersect(words(a), words(b)))
    return F.when(both == 0, 0.0).otherwise(F.greatest(both / F.size(F.array_union(words(a), words(b))), 0.8 * both / F.least(F.size(words(a)), F.size(words(b)))))
