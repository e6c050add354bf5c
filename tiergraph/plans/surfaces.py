"""What teams' pages read from the graph, positions that a provider names, the audit log, and sets to test matching with."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentiments of verdicts, audiences by what a post's id holds, and how much of a reason is shown.
VERDICTS = {"negative": -0.7, "positive": 0.7, "neutral": 0.0, "mixed": -0.1}
AUDIENCES = (("applicants", ("predental", "pre-dental", "applicant")), ("residents", ("dental_residency", "resident")), ("professionals", ("dentistry", "professional", "dentist")))
EXCERPT = {"pm": 280, "social": 240, "marketing": 240}
#: The time that a cached extraction lives, in seconds, as every extraction in the audit log states.
TTL = 3600
ANNOTATION = "post_id string, target_entities array<string>, verdict string, confidence double, reasoning string, ingest_iso string, t_valid_from string"


def underscored(text: Column) -> Column:
    """Lower-case runs of letters and digits, joined by underscores."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "_")


def sentiment(verdict: Column, confidence: Column) -> Column:
    """A verdict as a number, weighed by its confidence (null: in full)."""
    known = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    base = F.coalesce(F.try_element_at(known, F.lower(F.coalesce(verdict, F.lit("neutral")))), F.lit(0.0))
    return base * F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), F.lit(1.0))


def audience(post_id: Column) -> Column:
    low, out = F.lower(F.coalesce(post_id, F.lit(""))), F
    for name, parts in AUDIENCES:
        out = out.when(low.rlike("|".join(map(re.escape, parts))), name)
    return out.otherwise(AUDIENCES[0][0])


def mentions(nodes: DataFrame, *, page: str, now: datetime) -> DataFrame:
    """(topic, sentiment, source_id, excerpt, at) of the sentiment annotations that name a target and a post.

    The topic is the first target that is not blank; a time that is missing or unreadable is ``now``.
    """
    read = nodes.where(F.col("label") == "SentimentAnnotation").select(F.from_json("properties_json", ANNOTATION).alias("p")).select("p.*")
    first = underscored(F.try_element_at(F.filter("target_entities", lambda e: F.trim(e) != ""), F.lit(1)))
    at = F.coalesce(F.try_to_timestamp(F.coalesce("ingest_iso", "t_valid_from")), F.lit(now).cast("timestamp"))
    rows = read.select(first.alias("topic"), sentiment(F.col("verdict"), F.col("confidence")).alias("sentiment"), F.col("post_id").alias("source_id"), F.substring(F.coalesce("reasoning", F.lit("")), 1, EXCERPT[page]).alias("excerpt"), at.alias("at"))
    return rows.where("topic <> '' and source_id <> ''")


def cluster_members(nodes: DataFrame) -> DataFrame:
    """(source_id, cluster_id, cluster_label) from the clusters' members; of several clusters the one with the greatest id."""
    read = nodes.where(F.col("label") == "Cluster").select("id", F.from_json("properties_json", "topic_label string, member_post_ids array<string>").alias("p"))
    rows = read.select("id", F.coalesce(F.nullif("p.topic_label", F.lit("")), "id").alias("label"), F.explode("p.member_post_ids").alias("source_id")).where("source_id <> ''")
    return rows.groupBy("source_id").agg(F.max(F.struct("id", "label")).alias("m")).select("source_id", F.col("m.id").alias("cluster_id"), F.col("m.label").alias("cluster_label"))


def pain_inputs(nodes: DataFrame, *, now: datetime) -> DataFrame:
    """mentions with audience, source_tier and cluster of their posts, null where these are unknown."""
    tiers = nodes.where(F.col("label") == "Post").select(F.col("id").alias("source_id"), "source_tier")
    return mentions(nodes, page="pm", now=now).withColumn("audience", audience(F.col("source_id"))).join(tiers, "source_id", "left").join(cluster_members(nodes), "source_id", "left")


def parsed_positions(raw: str | None, most: int) -> list[dict[str, str]]:
    """A provider's JSON array of labels and descriptions, whatever stands around it; entries without a label are left out."""
    found = re.search(r"\[.*\]", raw or "", re.DOTALL)
    try:
        data = json.loads(found.group()) if found else []
    except json.JSONDecodeError:
        data = []
    named = [x for x in data if isinstance(x, dict) and str(x.get("label") or "").strip()]
    return [{"label": str(x["label"]).strip(), "description": str(x.get("description") or "")} for x in named[:most]]


def derive_positions(provider: Callable[[str, float], str], question: str, excerpts: list[str], *, most: int = 4, known: dict[str, list] | None = None, kind: str = "stance") -> list[dict[str, str]]:
    """The positions that a provider (a function of prompt and temperature) names for a question, asked once more if its first answer can't be read.

    With ``known``, what was named for a question and kind stays named so.
    """
    key = f"{kind}|{question.strip().lower()}"
    if known is not None and key in known:
        return known[key]
    prompt = f"Name up to {most} distinct positions on: {question}\nAnswer with a JSON array of objects with label and description.\n" + "\n".join(f"- {x[:200]}" for x in excerpts[:40])
    for temperature in (0.0, 0.3):
        try:
            found = parsed_positions(provider(prompt, temperature), most)
        except (OSError, RuntimeError, ValueError):  # a provider that fails is asked again, then has no say
            continue
        if found:
            if known is not None:
                known[key] = found
            return found
    return []


def label_clusters(provider: Callable[[str, float], str], excerpts: list[list[str]]) -> list[dict[str, str]]:
    """A label for each cluster, from one prompt that shows all of them; clusters that it leaves out are numbered."""
    shown = "\n".join(f"[{i}] " + " || ".join(x[:120].replace("\n", " ") for x in texts[:5] if x) for i, texts in enumerate(excerpts))
    try:
        found = parsed_positions(provider(f"Give each cluster of excerpts a short, distinct label. Answer with a JSON array of objects with label and description, in order.\n{shown}", 0.0), len(excerpts))
    except (OSError, RuntimeError, ValueError):
        found = []
    return found + [{"label": f"Topic {i + 1}", "description": ""} for i in range(len(found), len(excerpts))]


def audited(events: DataFrame, *, at: datetime) -> DataFrame:
    """(audit_id, kind, at, fields_json, ttl) of events (kind, fields as a struct or map, ttl), to be appended to the audit log.

    An extraction that doesn't state the cache's time to live fails the write.
    """
    kinds = ("extraction", "retrieval", "hitl", "ingestion")
    fields = F.to_json("fields")
    wrong = (F.col("kind") == "extraction") & ~F.col("ttl").eqNullSafe(F.lit(TTL))
    checked = F.when(wrong, F.raise_error(F.lit(f"an extraction must state a ttl of {TTL}"))).when(~F.col("kind").isin(*kinds), F.raise_error(F.lit("unknown kind"))).otherwise(F.col("kind"))
    rows = events.select(checked.alias("kind"), F.lit(at).cast("timestamp").alias("at"), fields.alias("fields_json"), F.col("ttl").cast("int").alias("ttl"))
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "kind", F.col("at").cast("string"), "fields_json"), 256), 1, 16).alias("audit_id"), "*")


def questions_match(predicted: Column, expected: Column, *, least: float = 0.6) -> Column:
    """Whether two questions are about the same: one holds the other, or enough of the expected words are predicted."""
    p, e = F.lower(predicted), F.lower(expected)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    shared = F.size(F.array_intersect(words(p), words(e))) / F.size(words(e))
    return F.contains(p, e) | F.contains(e, p) | F.coalesce(shared >= least, F.lit(False))


def misspelt(text: Column, seed: int = 0) -> Column:
    """A text with one edit that its own hash chooses: two neighbouring letters change places, or a letter goes. Texts of fewer than four letters stay."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    draw = F.xxhash64(F.lit(seed), text)
    at = lambda n: F.pmod(F.shiftright(draw, 1), n).cast("int")
    swapped = F.regexp_replace(text, F.concat(F.lit(r"^((?:[^\p{L}]*\p{L}){"), at(letters - 1), F.lit(r"}[^\p{L}]*)(\p{L})(.)")), F.lit("$1$3$2"))
    dropped = F.regexp_replace(text, F.concat(F.lit(r"^((?:[^\p{L}]*\p{L}){"), at(letters - 2) + 1, F.lit(r"}[^\p{L}]*)\p{L}")), F.lit("$1"))
    return F.when(letters < 4, text).when(F.pmod(draw, F.lit(2)) == 0, swapped).otherwise(dropped)
