"""Decay, reliability, ranking and credibility scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiergraph.model import lookup, rank_weight, tier_weight

# Half-lives in days by edge type or predicate; None never decays.
HALF_LIVES = {
    "tuition": 365.0, "avg_DAT": 730.0, "avg_GPA": 730.0, "interview_format": 1095.0, "interview_question_reported": 1095.0, "program_requirement": 730.0,
    "founding_year": None, "school_attribute": None, "opinion_sentiment": 182.0, "applicant_anecdote": 730.0, "policy_advice": 365.0,
}
DEFAULT_HALF_LIFE = 365.0


def half_life_days(kind: Column) -> Column:
    """Days; null where nothing decays."""
    forever = [k for k, v in HALF_LIVES.items() if v is None]
    return F.when(~F.coalesce(kind.isin(*forever), F.lit(False)), lookup({k: v for k, v in HALF_LIVES.items() if v is not None}, kind, DEFAULT_HALF_LIFE))


def age_days(now: Column, since: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(since)) / F.lit(86_400_000_000.0)


def decay(now: Column, valid_from: Column, kind: Column) -> Column:
    """2^(-age / half-life); 1 where the start is unknown or not past, or nothing decays."""
    half, age = half_life_days(kind), age_days(now.cast("timestamp"), valid_from.cast("timestamp"))
    return F.when(half.isNull() | age.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -age / half))


def reliability(tier: Column, credibility: Column) -> Column:
    return tier_weight(tier) * F.greatest(F.lit(0.0), credibility)


def ranking_score(tier: Column, rank: Column, decayed: Column, credibility: Column, consistency: Column) -> Column:
    """The product of tier and rank weight, decay, credibility and consistency, none below 0."""
    positive = lambda c: F.greatest(F.lit(0.0), c)
    return tier_weight(tier) * rank_weight(rank) * positive(decayed) * positive(credibility) * positive(consistency)


def log_norm(value: Column, cap: float) -> Column:
    """ln(1 + value) as a share of ln(1 + cap), with value kept in [0, cap]."""
    return F.log1p(F.greatest(F.lit(0.0), F.least(value.cast("double"), F.lit(float(cap))))) / F.log1p(F.lit(float(cap)))


def linear_norm(value: Column, cap: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double") / float(cap)))


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


# Fixed values: (feature, weight, how, cap) of the two rubrics.
FORUM_RUBRIC = (
    ("post_count", 0.10, "log", 1000), ("comment_count", 0.10, "log", 5000), ("upvote_total", 0.15, "log", 50_000), ("account_age_years", 0.10, "linear", 2.0), ("comment_to_post_ratio", 0.05, "clip", 1),
    ("on_topic_ratio", 0.20, "clip", 1), ("sockpuppet_penalty", -0.10, "clip", 1), ("gilded_count", 0.05, "linear", 50), ("prescient_correct_count", 0.15, "linear", 20),
)
BOARD_RUBRIC = (
    ("post_count", 0.15, "log", 1000), ("account_age_proxy_years", 0.10, "linear", 2.0), ("comment_to_post_ratio", 0.05, "clip", 1), ("on_topic_ratio", 0.25, "clip", 1),
    ("megathread_participation", 0.15, "linear", 50), ("longevity_months", 0.15, "linear", 60.0), ("prescient_correct_count", 0.15, "linear", 20),
)
INACTIVITY_HALF_LIFE_MONTHS = 12.0


def credibility(rubric: tuple, months_inactive: Column) -> tuple[Column, Column]:
    """(raw score, credibility) of a rubric over columns named as its features; null features count 0."""
    raw = F.lit(0.0)
    for name, weight, how, cap in rubric:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        part = {"log": lambda v=value, c=cap: log_norm(v, c), "linear": lambda v=value, c=cap: linear_norm(v, c), "clip": lambda v=value: clip01(v)}[how]()
        raw = raw + F.lit(weight) * part
    idle = F.greatest(F.lit(0.0), F.coalesce(months_inactive.cast("double"), F.lit(0.0)))
    return raw, clip01(raw) * F.pow(F.lit(2.0), -idle / INACTIVITY_HALF_LIFE_MONTHS)
