"""Answers from evidence: what a question asks for, what is recalled, whether that is enough, and what is counted over it.

An answer is made of tables; text is only laid out from them, so that no number in it comes from elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import text
from tiergraph.model import properties
from tiergraph.operators.lexical_index import LexicalIndex
from tiergraph.operators.retrieval import ranks
from tiergraph.plans import planner, protocol
from tiergraph.plans.extraction import sentiment_of


@dataclass(frozen=True)
class Corpus:
    """What answers are made from.

    docs: doc_id, text, author, thread_id, url, score. nodes and edges: the graph. facts: subject, predicate, value,
    source of the best tier. metrics: what the planner ranks.
    """

    docs: DataFrame
    index: LexicalIndex
    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame
    metrics: DataFrame


@dataclass(frozen=True)
class Answer:
    kind: str
    reason: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def evidence(corpus: Corpus, question: str, *, named: DataFrame | None = None, cap: int = 400) -> DataFrame:
    """(doc_id, rank, sources): the best documents for a question that are no junk, those found for a named entity (doc_id) first.

    The cap is how much evidence an answer shows; counts over a whole corpus are census().
    """
    found = ranks(corpus.index.tfidf(question), best=4 * cap).select(F.col("id").alias("doc_id"), "rank").withColumn("source", F.lit("lexical"))
    if named is not None:
        found = found.unionByName(named.select("doc_id", F.lit(0).alias("rank"), F.lit("entity").alias("source")))
    merged = found.groupBy("doc_id").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("source")).alias("sources"))
    best = protocol.clean_pool(merged.select("doc_id", F.struct("rank", "doc_id").alias("rank")), corpus.docs, cap=cap).select("doc_id")
    return merged.join(best, "doc_id", "left_semi")


def hydrate(ids: DataFrame, docs: DataFrame, question: str, *, most: int = 280) -> DataFrame:
    """ids (doc_id, …) with their documents' author, url and the sentence nearest to the question. Ids without a document are left out."""
    shown = docs.select("doc_id", "author", "url", text.best_sentence(question, F.col("text"), most).alias("snippet"))
    return ids.join(shown, "doc_id")


def facts_about(facts: DataFrame, subjects: list[str]) -> DataFrame:
    """The facts of the handful of ids that mean one entity, in order of predicate and value."""
    return facts.where(F.col("subject").isin(subjects)).select("predicate", "value", "source").distinct().orderBy("predicate", "value", "source")


def sentiment_table(corpus: Corpus, found: DataFrame, prefix: str) -> DataFrame:
    """(stat_id, label, numerator, denominator, value, sample_ids) of the verdicts on the evidence."""
    linked = corpus.edges.where("label = 'ANNOTATES'").select(F.col("from_id").alias("annotation_id"), F.col("to_id").alias("doc_id")).join(found.select("doc_id"), "doc_id", "left_semi")
    said = corpus.nodes.where("label = 'SentimentAnnotation'").select(F.col("id").alias("annotation_id"), properties(F.col("properties_json"), "verdict").alias("verdict"))
    verdicts = sentiment_of(linked.join(said.where("verdict is not null"), "annotation_id"))
    return protocol.provenance(verdicts.select("doc_id", F.col("verdict").alias("bucket")), prefix)


def answer(corpus: Corpus, question: str, *, subjects: list[str] | None = None, named: DataFrame | None = None, provider: Callable[[str], str] | None = None) -> Answer:
    """A ranking where the question compares entities; else official facts, evidence and counted sentiment, or the reason why not."""
    plan = planner.plan_query(question, provider)
    estimand, _ = protocol.classify_estimand(question)
    if plan.ops and not subjects:
        return Answer("ranking", tables={"ranking": planner.execute_plan(plan, corpus.metrics)})
    found = evidence(corpus, question, named=named)
    known = facts_about(corpus.facts, subjects or [])
    why = protocol.abstains(found.join(corpus.docs.select("doc_id", "author"), "doc_id")).first().reason
    if why and known.isEmpty():
        return Answer("abstained", why)
    tables = {"facts": known, "sources": hydrate(found.select("doc_id", "rank"), corpus.docs, question).orderBy("rank", "doc_id")}
    if not why:
        tables["sentiment"] = sentiment_table(corpus, found, question)
    return Answer(estimand, why, tables)


def percent(share: float | None) -> str:
    return "—" if share is None else f"{100 * share:.0f}%"


def rendered(answered: Answer, *, shown: int = 8) -> str:
    """An answer as Markdown: its tables' first rows as they are. Bounded by ``shown`` rows a table."""
    first = lambda name: answered.tables[name].limit(shown).collect() if name in answered.tables else []
    blocks: list[Iterable[str]] = []
    if answered.reason:
        blocks.append([f"_Not enough evidence: {answered.reason.replace('_', ' ')}._"])
    if ranking := first("ranking"):
        rows = [f"| {r.place} | {r.name} | {'—' if r.max_tuition is None else f'${r.max_tuition:,.0f}'} | {percent(r.pos_frac)} | {r.n_comments:,} |" for r in ranking]
        blocks.append(["| # | School | Tuition | Positive | Comments |", "|--:|-|--:|--:|--:|", *rows])
    if facts := first("facts"):
        blocks.append(["**Official facts**", "", *[f"- {r.predicate.replace('_', ' ')}: {r.value} (source: {r.source})" for r in facts]])
    if counted := first("sentiment"):
        blocks.append([f"**Sentiment over {counted[0].denominator:,} documents, counted**", "", *[f"- {r.label}: {percent(r.value)} ({r.numerator:,})" for r in counted]])
    if sources := first("sources"):
        blocks.append(["**Sources**", "", *[f"- {r.snippet} ({r.url or r.doc_id})" for r in sources]])
    return "\n\n".join("\n".join(b) for b in blocks)
