"""The recurring runs: pulls of all sources, structure and mentions of what is new, clusters, extraction within a budget, the index.

A run takes tables and gives tables to append. What was done before is a table as well, so a run that
is repeated, or that lost its driver halfway, does only what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.operators import graph, resolution, vectors
from tiergraph.operators.dashboards import first_ids
from tiergraph.operators.lexical_index import LexicalIndex, build_index
from tiergraph.operators.recall import node_texts
from tiergraph.plans.extraction import Provider, cache_key, run_task, sentiment_artefacts
from tiergraph.sources import community, connectors


@dataclass(frozen=True)
class Source:
    """A registered source: how rows past a cursor are read, by which column, and how a stored cursor is read back."""

    source_id: str
    read: Callable[[object], DataFrame]
    cursor_column: str
    typed: Callable[[str], object] = str


def pull_all(sources: list[Source], receipts: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(receipts to append, landed rows by source): each source from its own cursor; one that fails doesn't stop the others."""
    since = {r.source_id: r.cursor_value for r in connectors.cursors(receipts).collect()}  # a row a source
    made, landed = [], {}
    for s in sources:
        stored = since.get(s.source_id)
        receipt, rows = connectors.pull(s.source_id, s.read, s.cursor_column, None if stored is None else s.typed(stored))
        made.append(receipt)
        if rows is not None:
            landed[s.source_id] = rows
    return reduce(DataFrame.unionByName, made) if made else receipts.limit(0), landed


def structural_increment(posts: DataFrame, comments: DataFrame, done: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, done to append) of the posts and comments that the checkpoint (id) lacks."""
    fresh = [graph.not_done(rows.withColumn("id", F.col(key)), done, "id") for rows, key in ((posts, "post_id"), (comments, "comment_id"))]
    nodes, edges = community.assemble_forum(fresh[0].drop("id"), fresh[1].drop("id"), now)
    return nodes, edges, fresh[0].select("id").union(fresh[1].select("id")).distinct()


def mention_increment(docs: DataFrame, aliases: DataFrame, done: DataFrame, *, threshold: float = 75.0) -> tuple[DataFrame, DataFrame]:
    """(mentions (id, entity_id, alias, score, needs_review), done to append): documents (id, text) that the checkpoint lacks, scanned for aliases (alias, entity_id).

    A word that is an alias, case and all, is a certain mention; aliases of several words are found inexactly.
    """
    fresh = graph.not_done(docs, done, "id")
    long = resolution.scan_long_aliases(fresh, aliases, id_col="id", text_col="text", threshold=threshold)
    words = resolution.scan_short_aliases(fresh, aliases, id_col="id", text_col="text").join(aliases, "alias")
    short = words.select("id", "entity_id", "alias", F.lit(100.0).alias("score"), F.lit(False).alias("needs_review"))
    best = long.unionByName(short).groupBy("id", "entity_id").agg(F.max(F.struct("score", "alias", "needs_review")).alias("m"))
    return best.select("id", "entity_id", "m.alias", "m.score", "m.needs_review"), fresh.select("id").distinct()


def weekly_clusters(embeddings: DataFrame, *, id_col: str, vec_col: str, k: int = 12, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, clusters): a cluster for each vector by distributed k-means, and its size and first members, from which it is labelled."""
    members = vectors.kmeans_scale(embeddings, vec_col, k=k).select(F.col(id_col).alias("id"), "cluster")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    return members, sizes.join(first_ids(members, ["cluster"], "id", samples), "cluster")


def daily_extraction(docs: DataFrame, cache: DataFrame, provider: Provider, *, budget: float, each: float, task: str = "sentiment", version: str = "v1", ingest: str = "1970-01-01") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, cache to append) of documents (id, text): cached answers cost nothing, and of the others as many texts are asked as the budget pays.

    Texts that aren't paid for today are asked on a later day; they come by the hash of their text, so repeated runs agree.
    """
    keyed = docs.withColumn("__key", cache_key(task, version, "text"))
    known = keyed.join(cache.select(F.col("key").alias("__key")), "__key", "left_semi")
    paid = keyed.join(cache.select(F.col("key").alias("__key")), "__key", "left_anti").select("__key").distinct().orderBy("__key").limit(int(budget // each))
    today = known.unionByName(keyed.join(paid, "__key", "left_semi")).drop("__key")
    results, fresh = run_task(today, cache, provider, id_col="id", text_col="text", task=task, version=version)
    nodes, edges = sentiment_artefacts(results, ingest)
    return nodes, edges, fresh


def refresh_index(nodes: DataFrame, path: str) -> LexicalIndex:
    """The lexical index over all nodes' texts, anew below ``path``; readers of an older one keep theirs."""
    return build_index(node_texts(nodes), path, id_col="id", text_col="text")
