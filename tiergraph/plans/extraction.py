"""Model-backed extraction as plug-in stages: filter, cache, model, artefacts; and the review around it.

A provider is any function from a list of prompts to a list of JSON strings; it runs in
Arrow batches on the executors. The default one is a deterministic offline rule.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.operators.filters import SENTIMENT_MARKERS
from tiergraph.runtime import scratch_path

Provider = Callable[[list[str]], list[str]]
# Which markers speak well.
POSITIVE = ("good", "great", "love", "best", "recommend", "amazing")


def offline_sentiment(prompts: list[str]) -> list[str]:
    """Counts opinion markers: verdict, and how one-sided they are."""
    out = []
    for p in prompts:
        words = p.lower().split()
        good = sum(w.strip(".,!?") in POSITIVE for w in words)
        bad = sum(w.strip(".,!?") in SENTIMENT_MARKERS for w in words) - good
        verdict = "neutral" if good == bad else "positive" if good > bad else "negative"
        out.append(json.dumps({"verdict": verdict, "confidence": round(abs(good - bad) / max(1, good + bad), 2)}))
    return out


def cache_key(task: str, version: str, text_col: str):
    return F.sha2(F.concat_ws("|", F.lit(task), F.lit(version), F.coalesce(text_col, F.lit(""))), 256)


def run_task(rows: DataFrame, cache: DataFrame, provider: Provider, *, id_col: str, text_col: str, task: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(results, fresh): results (id, key, output, from_cache); fresh (key, output) is what the model was asked for now, each text once."""
    keyed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", cache_key(task, version, "text"))
    known = cache.select("key", "output")
    missing = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "output": provider(f["text"].fillna("").tolist())})

    #: Written, as a model is to be asked once, and both results read its answers.
    path = scratch_path(rows.sparkSession, "fresh")
    missing.mapInPandas(ask, "key string, output string").write.parquet(path)
    fresh = rows.sparkSession.read.schema("key string, output string").parquet(path)
    every = known.withColumn("from_cache", F.lit(True)).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    return keyed.select("id", "key").join(every, "key").select("id", "key", "output", "from_cache"), fresh


def cascade(rows: DataFrame, tiers: list[tuple[Provider, float]], *, id_col: str, text_col: str) -> DataFrame:
    """(id, output, confidence, tier): each tier takes what the ones before it were not confident of; the last takes all that is left."""
    left, out = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for n, (provider, least) in enumerate(tiers):

        def ask(frames: Iterator[pd.DataFrame], provider=provider) -> Iterator[pd.DataFrame]:
            for f in frames:
                outputs = provider(f["text"].fillna("").tolist())
                yield f.assign(output=outputs, confidence=[float(json.loads(o).get("confidence", 1.0)) for o in outputs])

        answered = left.mapInPandas(ask, f"id {dict(rows.dtypes)[id_col]}, text string, output string, confidence double")
        last = n == len(tiers) - 1
        done = (answered if last else answered.where(F.col("confidence") >= least)).select("id", "output", "confidence", F.lit(n).alias("tier"))
        out = done if out is None else out.unionByName(done)
        left = answered.where(F.col("confidence") < least).select("id", "text")
    return out


def calibrate(scored: DataFrame, gold: DataFrame, *, raw: str = "confidence", correct: str = "correct") -> DataFrame:
    """Adds calibrated: isotonic regression of raw confidence to being right, as Spark ML fits it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    features = VectorAssembler(inputCols=[raw], outputCol="__f")
    model = IsotonicRegression(featuresCol="__f", labelCol="__y", predictionCol="calibrated").fit(features.transform(gold.withColumn("__y", F.col(correct).cast("double"))))
    return model.transform(features.transform(scored)).drop("__f")


def sentiment_artefacts(results: DataFrame, ingest: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): an annotation a result and ANNOTATES to its document; broken JSON gives none."""
    from tiergraph.model import make_edges, make_nodes

    parsed = results.withColumn("o", F.from_json("output", "verdict string, confidence double")).where("o.verdict is not null")
    me = F.concat(F.lit("annotation:"), F.substring("key", 1, 16), F.lit(":"), F.col("id").cast("string"))
    nodes = make_nodes(parsed, "SentimentAnnotation", "L5", me, F.struct("o.verdict", "o.confidence", F.col("id").alias("post_id")))
    return nodes, make_edges(parsed, "ANNOTATES", "L5", me, F.col("id").cast("string"), ingest=(F.lit(ingest), None), confidence=F.col("o.confidence"))


def sentiment_of(annotations: DataFrame) -> DataFrame:
    """(doc_id, verdict): the annotation with the least id of each document."""
    return annotations.groupBy("doc_id").agg(F.min_by("verdict", "annotation_id").alias("verdict"))


def review_state(events: DataFrame) -> DataFrame:
    """(item_id, kind, status, decided_by): review items by their last event; a committed item stays committed."""
    first = events.where("event = 'enqueue'").groupBy("item_id").agg(F.min_by("kind", "at").alias("kind"), F.min("at").alias("since"))
    decided = events.where("event in ('commit', 'reject')").groupBy("item_id").agg(F.min(F.struct("at", "event", "actor")).alias("d"))
    status = F.when(F.col("d.event") == "commit", "committed").when(F.col("d.event") == "reject", "rejected").otherwise("pending")
    return first.join(decided, "item_id", "left").select("item_id", "kind", "since", status.alias("status"), F.col("d.actor").alias("decided_by"))


def pull_pending(events: DataFrame, limit: int = 1) -> DataFrame:
    return review_state(events).where("status = 'pending'").orderBy("since", "item_id").limit(limit)


def feedback_context(log: DataFrame, *, keys: list[str], half_life_days: float, now, top: int = 8) -> DataFrame:
    """The best positive examples of each prompt: 0.4 relevance, 0.2 recency, 0.1 frequency, 0.3 trust; blocked texts are left out."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("at")) / 86400.0
    g = log.groupBy(*keys, "text").agg(F.max("relevance").alias("relevance"), F.min(age).alias("age"), F.count("*").alias("n"), F.max("trust").alias("trust"), F.max(F.col("decision") == "reject").alias("blocked"))
    score = 0.4 * F.col("relevance") + 0.2 * F.pow(F.lit(2.0), -F.col("age") / half_life_days) + 0.1 * F.least(F.lit(1.0), F.col("n") / 10.0) + 0.3 * F.col("trust")
    ranked = g.where("not blocked").withColumn("score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "text"))
    return ranked.withColumn("place", place).where(F.col("place") <= top)


def judge_panel(votes: DataFrame, families: DataFrame) -> DataFrame:
    """(group_id, winner, agreement): the claim that two of three judges choose; a judge of a family that extracted one of the claims has no vote."""
    barred = families.select("group_id", F.col("family").alias("judge_family")).distinct()
    kept = votes.join(barred, ["group_id", "judge_family"], "left_anti")
    counts = kept.groupBy("group_id", "claim_id").agg(F.countDistinct("judge_family").alias("n"))
    best = counts.groupBy("group_id").agg(F.max(F.struct("n", "claim_id")).alias("m"))
    return best.select("group_id", F.when(F.col("m.n") >= 2, F.col("m.claim_id")).alias("winner"), F.col("m.n").alias("agreement"))


def evaluate(predicted: DataFrame, gold: DataFrame, *, keys: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of predicted against gold rows by their keys."""
    p, g = predicted.select(*keys).distinct(), gold.select(*keys).distinct()
    flags = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), keys, "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = flags.agg(n(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), n(F.col("g").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    c = c.withColumns({"precision": precision, "recall": recall})
    return c.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
