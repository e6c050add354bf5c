"""Conflicts between claims: consistency, the cascade, joint confidence, majority of signals.

A claim has claim_id, subject_id, predicate, object_value, source_tier, credibility, t_valid_from, t_valid_to.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.functions.scoring import decay, reliability
from tiergraph.model import tier_weight

KEY = ("subject_id", "predicate")
# The prior of the first tier, when it counts as current, the least credibility, the least margin, and the least confidence of a signal.
ANCHOR, TAU, CRED_FLOOR, MARGIN, CONFIDENCE = 3.0, 0.05, 0.05, 0.10, 0.7
STALE_MONTHS = 6


def consistency(claims: DataFrame, keys: tuple[str, ...] = KEY, value: str = "object_value") -> DataFrame:
    """Adds consistency: the share of the reliability behind a claim's (subject, predicate) that agrees with its value; 1 without any.

    Masses are summed first and joined back, so that a subject with a third of all claims needs no window.
    """
    norm = F.lower(F.trim(F.col(value).cast("string")))
    mass = reliability(F.col("source_tier"), F.coalesce("credibility", F.lit(1.0)))
    rows = claims.withColumn("__value", norm)
    agree = rows.groupBy(*keys, "__value").agg(F.sum(mass).alias("__agree"))
    total = agree.groupBy(*keys).agg(F.sum("__agree").alias("__total"))
    joined = rows.join(agree.join(total, list(keys)), [*keys, "__value"], "left")
    return joined.withColumn("consistency", F.when(F.col("__total") > 0, F.col("__agree") / F.col("__total")).otherwise(1.0)).select(*claims.columns, "consistency")


def temporally_distinct(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Both starts known and the windows strictly apart; an open end never is."""
    return F.coalesce(a_from.isNotNull() & b_from.isNotNull() & (F.coalesce(a_to < b_from, F.lit(False)) | F.coalesce(b_to < a_from, F.lit(False))), F.lit(False))


def cascade(claims: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """A row a (subject, predicate): the newest claim (by claim_id) against all earlier ones.

    (keys, new_claim, status, winner): no_conflict, l1_clash_invalidated, temporal_split, trust_weighted or hitl_pending.
    """
    row = F.struct("claim_id", "object_value", "source_tier", "credibility", "t_valid_from", "t_valid_to")
    newest = claims.groupBy(*keys).agg(F.max_by(row, "claim_id").alias("new"))
    joined = claims.join(newest, list(keys))
    prior = F.col("claim_id") != F.col("new.claim_id")
    l1, same = prior & (F.col("source_tier") == "L1"), prior & (F.col("source_tier") == F.col("new.source_tier"))
    found = joined.groupBy(*keys).agg(
        F.first("new").alias("new"),
        F.sum(prior.cast("int")).alias("n"),
        F.sum(same.cast("int")).alias("n_same"),
        F.min(F.when(l1, F.col("claim_id"))).alias("first_l1"),
        F.min_by(F.when(prior & (F.col("source_tier") != "L1"), F.col("object_value")), F.when(prior & (F.col("source_tier") != "L1"), F.col("claim_id"))).alias("first_other"),
        F.min(F.when(prior, F.struct("claim_id", "t_valid_from", "t_valid_to"))).alias("first"),
        F.max(F.when(prior, F.struct("credibility", (-F.col("claim_id")).alias("minus_id")))).alias("best"),
    )
    new, best, first = F.col("new"), F.col("best"), F.col("first")
    alike = F.col("n_same") == F.col("n")
    apart = temporally_distinct(new["t_valid_from"], new["t_valid_to"], first["t_valid_from"], first["t_valid_to"])
    incoming = new["source_tier"] == "L1"
    clash = F.col("first_l1").isNotNull() & ~incoming
    overrules = incoming & F.coalesce(F.col("first_other") != new["object_value"], F.lit(False))
    weighted = alike & (new["credibility"] != best["credibility"])
    status = F.when(F.col("n") == 0, "no_conflict").when(clash | overrules, "l1_clash_invalidated").when(alike & apart, "temporal_split").when(weighted, "trust_weighted").otherwise("hitl_pending")
    own = new["claim_id"]
    winner = F.when(F.col("n") == 0, own).when(clash, F.col("first_l1")).when(overrules | (alike & apart), own).when(weighted, F.when(new["credibility"] > best["credibility"], own).otherwise(-best["minus_id"]))
    return found.select(*keys, own.alias("new_claim"), status.alias("status"), winner.alias("winner"))


def joint(claims: DataFrame, now: datetime, keys: tuple[str, ...] = KEY) -> DataFrame:
    """A row a (subject, predicate): status, winner_value, mass, margin of the anchored joint confidence.

    A current value of the first tier is immutable; else the value with the largest mass
    wins, unless its lead over the next is below the margin.
    """
    decayed = decay(F.lit(now), F.col("t_valid_from"), F.col("predicate"))
    weight = F.when(F.col("source_tier") == "L1", ANCHOR).otherwise(tier_weight(F.col("source_tier")))
    rows = claims.withColumn("__d", decayed).withColumn("__mass", weight * F.col("__d") * F.greatest("credibility", F.lit(CRED_FLOOR)))
    current = (F.col("source_tier") == "L1") & (F.col("__d") >= TAU)
    values = rows.groupBy(*keys, "object_value").agg(F.sum("__mass").alias("mass"), F.max(current).alias("current"), F.max((F.col("source_tier") == "L1").cast("int")).alias("has_l1"))
    ranked = values.withColumn("mass", F.round("mass", 6))
    #: A group's values, not its claims: few, and no window over claims.
    order = Window.partitionBy(*keys).orderBy(F.desc("mass"), "object_value")
    ranked = ranked.withColumns({"place": F.row_number().over(order), "next_mass": F.lead("mass").over(order)})
    top = F.col("place") == 1
    found = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_values"), F.sum(F.col("current").cast("int")).alias("n_current"), F.max(F.when(F.col("current"), F.col("object_value"))).alias("l1_value"),
        F.max(F.when(top, F.col("object_value"))).alias("top"), F.max(F.when(top, F.col("mass"))).alias("mass"), F.max(F.when(top, F.coalesce("next_mass", F.lit(0.0)))).alias("runner"), F.max(F.when(~top, F.col("has_l1"))).alias("l1_lost"),
    )
    margin = F.when(F.col("mass") > 0, (F.col("mass") - F.col("runner")) / F.col("mass")).otherwise(0.0)
    status = F.when(F.col("n_values") == 1, "no_conflict").when(F.col("n_current") > 1, "hitl_pending").when(F.col("n_current") == 1, "l1_clash_invalidated").when(margin < MARGIN, "hitl_pending").otherwise("trust_weighted")
    return found.withColumn("status", status).select(
        *keys, "status",
        F.when(F.col("status") == "l1_clash_invalidated", F.col("l1_value")).when(F.col("status") != "hitl_pending", F.col("top")).alias("winner_value"),
        F.round(F.when(F.col("status") == "l1_clash_invalidated", 1.0).when((F.col("n_values") == 1) | (F.col("n_current") > 1), 0.0).otherwise(margin), 4).alias("margin"),
        F.when(F.col("status") == "trust_weighted", F.coalesce(F.col("l1_lost") == 1, F.lit(False))).otherwise(F.col("status") == "hitl_pending").alias("low_confidence"),
    )


def combine_signals(signals: DataFrame, by: list[str]) -> DataFrame:
    """A row a claim, from three signals (verdict, confidence): outcome, confidence, low_confidence."""
    verdict, conf = F.col("verdict"), F.col("confidence")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    of = lambda v: (n(verdict == v), F.max(F.when(verdict == v, conf)), F.sum(F.when(verdict == v, conf)), n((verdict == v) & (conf >= CONFIDENCE)))
    s, r = of("supports"), of("refutes")
    g = signals.groupBy(*by).agg(F.count("*").alias("n"), n(verdict == "unknown").alias("unknown"), F.max(conf).alias("most"), *[c.alias(f"s{i}") for i, c in enumerate(s)], *[c.alias(f"r{i}") for i, c in enumerate(r)])
    supports = (F.col("s0") > F.col("r0")) | ((F.col("s0") == F.col("r0")) & (F.coalesce("s1", F.lit(-1.0)) >= F.coalesce("r1", F.lit(-1.0))))
    count, total, above = (F.when(supports, F.col(f"s{i}")).otherwise(F.col(f"r{i}")) for i in (0, 2, 3))
    g = g.withColumns({"count": count, "avg": total / F.greatest(count, F.lit(1)), "above": above, "acting": F.col("s0") + F.col("r0")})
    won = (F.col("count") >= 2) & (F.col("above") >= 2)
    outcome = F.when(F.col("n") != 3, "disagreement").when(F.col("unknown") == 3, "unknown").when(F.col("acting") < 2, "disagreement").when(won, F.when(supports, "supports").otherwise("refutes")).otherwise("disagreement")
    confidence = F.when((F.col("n") != 3) | (F.col("unknown") == 3), 0.0).when(F.col("acting") < 2, F.col("most")).otherwise(F.col("avg"))
    low = F.when(F.col("n") != 3, True).when(F.col("unknown") == 3, False).when((F.col("acting") < 2) | ~won, True).otherwise((F.col("count") < F.col("acting")) | (F.col("avg") < CONFIDENCE))
    return g.select(*by, outcome.alias("outcome"), F.round(confidence, 4).alias("confidence"), low.alias("low_confidence"))


def research_needs(official: DataFrame, others: DataFrame, now: datetime, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Official values that ended over six months ago and that other tiers contradict: (keys, need_id)."""
    months = F.floor((F.unix_seconds(F.lit(now)) - F.unix_seconds(F.col("t_valid_to").cast("timestamp"))) / 86400) / 30
    stale = official.where(F.col("t_valid_to").isNotNull() & (months > STALE_MONTHS)).select(*keys, F.col("object_value").alias("__official"))
    against = stale.join(others.select(*keys, F.col("object_value").alias("__other")), list(keys)).where("__official <> __other")
    return against.select(*keys).distinct().withColumn("need_id", F.concat_ws(":", F.lit("research_need"), *keys, F.lit(str(now.year))))
