"""Questions that compare entities, as typed plans over a table of metrics.

A plan is a list of rankings, how their entities combine, and what sorts the answer. It comes
from the question's cues, or from a provider's JSON if that says more; every number in the
answer comes from the table.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cues of price and of regard, how many rows a lone ranking and each of two takes, and from how many comments regard counts.
CUES = {
    "rank_tuition": {"asc": r"cheap|afford|least expensive|lowest tuition|low tuition", "desc": r"expensive|priciest|highest tuition|most expensive"},
    "rank_sentiment": {
        "desc": r"\b(liked|loved|best[- ]?(reviewed|rated|regarded)|most[- ]?(positive|liked|loved)|highly[- ]?(rated|regarded)|well[- ]?regarded|favou?rite)\b|(applicants?|students?|people|they)\s+(also\s+)?(like|love|prefer|enjoy)",
        "asc": r"\b(worst|least[- ]?liked|most[- ]?negative|hated|lowest[- ]?rated|worst[- ]?reviewed|most[- ]?disliked|least[- ]?favou?rite)\b|(applicants?|students?|people|they)\s+(also\s+)?(dislike|hate|avoid)",
    },
}
LONE = 15
PAIRED = {"rank_tuition": 30, "rank_sentiment": 50}
LEAST_COMMENTS, SHOWN = 50, 15
#: What each ranking orders by.
METRIC = {"rank_tuition": "max_tuition", "rank_sentiment": "pos_frac"}


@dataclass(frozen=True)
class Ranking:
    op: str
    order: str
    k: int = LONE


@dataclass(frozen=True)
class Plan:
    ops: tuple[Ranking, ...] = ()
    combine: str | None = None
    sort_by: str | None = None


def heuristic_plan(question: str) -> Plan:
    """The plan that a question's cues give; without cues one without rankings. Of opposite cues the table's first wins."""
    q = (question or "").lower()
    cued = {op: next((order for order, cue in orders.items() if re.search(cue, q)), None) for op, orders in CUES.items()}
    chosen = {op: order for op, order in cued.items() if order}
    both = len(chosen) == len(CUES)
    ops = tuple(Ranking(op, order, PAIRED[op] if both else LONE) for op, order in chosen.items())
    return Plan(ops, "intersect" if both else None, ops[0].op.removeprefix("rank_") if ops else None)


def parsed_plan(raw: str | None) -> Plan | None:
    """A provider's JSON as a plan, whatever stands around it; None if there is none. Unknown rankings are left out."""
    found = re.search(r"\{.*\}", raw or "", re.DOTALL)
    try:
        data = json.loads(found.group()) if found else None
    except json.JSONDecodeError:
        return None
    if not isinstance(data, dict) or not isinstance(data.get("ops"), list):
        return None
    known = (x for x in data["ops"] if isinstance(x, dict) and x.get("op") in METRIC)
    ops = tuple(Ranking(x["op"], "desc" if x.get("order") == "desc" else "asc", int(x.get("k") or LONE)) for x in known)
    return Plan(ops, data.get("combine"), data.get("sort_by"))


def plan_query(question: str, provider=None) -> Plan:
    """The heuristic plan, or a provider's (a function from the question to text) if that has more rankings."""
    own = heuristic_plan(question)
    theirs = parsed_plan(provider(question)) if provider else None
    return theirs if theirs and len(theirs.ops) > len(own.ops) else own


def ranked(metrics: DataFrame, step: Ranking) -> DataFrame:
    """The best ``k`` entities of one ranking, ties by id: a sort that keeps k rows a task."""
    by = METRIC[step.op]
    eligible = metrics.where(F.col(by).isNotNull())
    if step.op == "rank_sentiment":
        eligible = eligible.where(F.col("n_comments") >= LEAST_COMMENTS)
    return eligible.orderBy(F.col(by).desc() if step.order == "desc" else F.col(by).asc(), "school_id").limit(step.k)


def execute_plan(plan: Plan, metrics: DataFrame, *, shown: int = SHOWN) -> DataFrame:
    """(place, school_id, name, max_tuition, n_comments, pos_frac) in the plan's order. A plan without rankings gives no rows; a ranking without rows has no say."""
    lists = [rows for rows in (ranked(metrics, x) for x in plan.ops) if not rows.isEmpty()]  # each at most k rows
    if not lists:
        return metrics.limit(0).select(F.lit(0).alias("place"), *metrics.columns)
    ids = [rows.select("school_id") for rows in lists]
    if plan.combine == "intersect":
        kept = reduce(DataFrame.intersect, ids)
    elif plan.combine == "union":
        kept = reduce(DataFrame.union, ids).distinct()
    else:
        kept = ids[0]
    sort_by = plan.sort_by or ("tuition" if any(x.op == "rank_tuition" for x in plan.ops) else "sentiment")
    op = f"rank_{sort_by}"
    order = next((x.order for x in plan.ops if x.op == op), "asc" if sort_by == "tuition" else "desc")
    merged = reduce(DataFrame.union, lists).distinct().join(kept, "school_id", "left_semi").where(F.col(METRIC[op]).isNotNull())
    key = F.col(METRIC[op])
    top = merged.orderBy(key.desc() if order == "desc" else key.asc(), "school_id").limit(shown)
    rank = F.array_sort(F.collect_list(F.struct((-key if order == "desc" else key).alias("by"), "school_id", F.struct(*metrics.columns).alias("row"))))
    return top.agg(rank.alias("r")).select(F.posexplode("r").alias("at", "x")).select((F.col("at") + 1).alias("place"), "x.row.*")
