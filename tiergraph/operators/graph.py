"""Graph operators: upserts and versions, neighbours, traversal, closures, recall."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.functions.scoring import decay, ranking_score
from tiergraph.model import properties
from tiergraph.runtime import checkpoint
from tiergraph.operators.filters import edge_passes, edges_at_level, nodes_at_level, tier_passes


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert by overwriting. Partial maxima meet, so a key's rows never have to sit together."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(packed, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def supersede(versions: DataFrame, keys: list[str], start: str = "t_ingest_from", *, tie: str = "id") -> DataFrame:
    """An append-only log of versions with t_ingest_to closed where the next one of its key begins."""
    order = Window.partitionBy(*keys).orderBy(start, tie)
    return versions.withColumn("t_ingest_to", F.lead(start).over(order))


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends, once per id."""
    ids = nodes.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return both.dropDuplicates(["id"])


def not_done(pending: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a checkpoint lacks."""
    return pending.join(done.select(key).distinct(), key, "left_anti")


def neighbours(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, *, relation: str | None = None, direction: str = "out") -> DataFrame:
    """(anchor, direction, edge columns, neighbour_id, neighbour_label) with each edge's true orientation. anchors: id."""
    chosen = edges if relation is None else edges.where(F.col("label") == relation)
    ids = anchors.select(F.col("id").alias("anchor"))

    def side(here: str, there: str, name: str) -> DataFrame:
        met = chosen.join(ids, chosen[here] == ids["anchor"])
        named = nodes.select(F.col("id").alias("neighbour_id"), F.col("label").alias("neighbour_label"))
        return met.join(named, F.col(there) == F.col("neighbour_id")).withColumn("direction", F.lit(name))

    out, back = side("from_id", "to_id", "out"), side("to_id", "from_id", "in")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def seed_lookup(nodes: DataFrame, query: str, *, tier_min: str | None = None, level: str = "C") -> DataFrame:
    """Nodes whose id or properties contain the query."""
    q = F.lit(query.lower())
    found = nodes.where(F.contains(F.lower("id"), q) | F.contains(F.lower(F.coalesce("properties_json", F.lit(""))), q))
    return nodes_at_level(found, level).where(tier_passes(F.col("source_tier"), tier_min))


def traverse(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, *, depth: int = 2, **filters) -> DataFrame:
    """(id, hop, last_from, last_label): nodes within ``depth`` outbound hops, at their first hop; the least last hop for ties.

    Each hop is one join of the frontier to the filtered edges; nodes seen before are dropped. A hop's
    frontier is checkpointed, as the hops after it and the result read it again.
    """
    kept = edges.where(edge_passes(**filters)).select("from_id", "to_id", F.col("label").alias("last_label"))
    seen = checkpoint(seeds.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("last_from"), F.lit(None).cast("string").alias("last_label")))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("from_id")).join(kept, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min(F.struct("from_id", "last_label")).alias("m"))
        frontier = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), F.col("m.from_id").alias("last_from"), F.col("m.last_label").alias("last_label"))
        frontier = checkpoint(frontier.join(nodes.select("id"), "id", "left_semi"))
        seen = seen.unionByName(frontier)
    return seen


def score_nodes(found: DataFrame, nodes: DataFrame, now: datetime) -> DataFrame:
    """Adds label, source_tier and score: tier, rank, decay by predicate or label, credibility, and neutral consistency."""
    props = F.col("properties_json")
    joined = found.join(nodes.select("id", "label", "source_tier", "properties_json"), "id")
    kind = F.coalesce(properties(props, "predicate"), properties(props, "metric"), properties(props, "metric_name"), F.col("label"))
    since = F.to_timestamp(properties(props, "t_valid_from"))
    cred = F.coalesce(properties(props, "user_credibility"), properties(props, "credibility"), properties(props, "author_credibility")).cast("double")
    score = ranking_score(F.col("source_tier"), F.coalesce(properties(props, "rank"), F.lit("normal")), decay(F.lit(now), since, kind), F.coalesce(cred, F.lit(1.0)), F.lit(1.0))
    return joined.withColumn("score", F.round(score, 6))


def query_graph(edges: DataFrame, nodes: DataFrame, query: str, *, level: str = "C", tier_min: str | None = None, as_of: datetime | None = None, time_range=None, include_anomalies: bool = False, depth: int = 2, limit: int = 50, now: datetime) -> DataFrame:
    """Seeds, expansion, ranking over all that was reached, then the limit: (id, label, source_tier, hop, last_from, last_label, score)."""
    seeds = seed_lookup(nodes, query, tier_min=tier_min, level=level)
    inside = nodes_at_level(nodes, level)
    reached = traverse(edges_at_level(edges, level), inside.where(tier_passes(F.col("source_tier"), tier_min)), seeds, depth=depth, tier_min=tier_min, as_of=as_of, time_range=time_range, include_anomalies=include_anomalies)
    scored = score_nodes(reached, nodes, now)
    return scored.orderBy(F.desc("score"), "hop", "id").limit(limit).select("id", "label", "source_tier", "hop", "last_from", "last_label", "score")


def crosslinks(edges: DataFrame, nodes: DataFrame, *, limit: int | None = None, **filters) -> DataFrame:
    """Two rows for each SAME_AS pair, one an end; the limit counts pairs."""
    pairs = edges.where((F.col("label") == "SAME_AS") & edge_passes(**filters)).select("id", "from_id", "to_id", "confidence")
    ends = nodes.select("id", "label", "source_tier")
    both = pairs.join(ends.select(F.col("id").alias("from_id"), F.struct("label", "source_tier").alias("f")), "from_id").join(ends.select(F.col("id").alias("to_id"), F.struct("label", "source_tier").alias("t")), "to_id")
    both = both if limit is None else both.orderBy("id").limit(limit)
    rows = F.explode(F.array(F.struct(F.col("from_id").alias("node_id"), F.col("to_id").alias("other_id"), F.col("f.label").alias("label"), F.col("f.source_tier").alias("source_tier")), F.struct(F.col("to_id").alias("node_id"), F.col("from_id").alias("other_id"), F.col("t.label").alias("label"), F.col("t.source_tier").alias("source_tier"))))
    return both.select(F.col("id").alias("edge_id"), "confidence", rows.alias("r")).select("edge_id", "confidence", "r.*")


def other_side(edges: DataFrame, label: str, ids: DataFrame, *, given: str = "to_id") -> DataFrame:
    """The distinct other ends of a label's edges at the given ids (id)."""
    other = "from_id" if given == "to_id" else "to_id"
    return edges.where(F.col("label") == label).join(ids.select(F.col("id").alias(given)), given, "left_semi").select(F.col(other).alias("id")).distinct()


def same_as_closure(edges: DataFrame, ids: DataFrame, *, max_iter: int = 4) -> DataFrame:
    """(id, root): what SAME_AS reaches from each root in either direction within ``max_iter`` steps."""
    same = edges.where(F.col("label") == "SAME_AS")
    both = same.select("from_id", "to_id").union(same.select("to_id", "from_id")).distinct()
    found = ids.select("id", F.col("id").alias("root")).distinct()
    frontier = found
    for _ in range(max_iter):
        step = frontier.join(both, frontier["id"] == both["from_id"]).select(F.col("to_id").alias("id"), "root").distinct()
        frontier = step.join(found, ["id", "root"], "left_anti")
        found = found.unionByName(frontier)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for links (a, b), by least labels; each round also jumps to the label's label, until no label changes."""
    both = checkpoint(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")))
    changed = True
    while changed:
        spread = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        after = labels.join(spread, "id").join(jump, "component", "left").select("id", F.least("component", "near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("changed"))
        after = checkpoint(after)
        changed = not after.where("changed").isEmpty()
        labels = after.select("id", "component")
    return labels


def anchored_recall(edges: DataFrame, root: DataFrame, *, mention: str = "MENTIONS_SCHOOL", thread: str = "BELONGS_TO_THREAD") -> DataFrame:
    """(stage, id) of the funnel: the entity with what is the same, posts that mention it, their threads, and all members of those."""
    entities = same_as_closure(edges, root).select("id").distinct()
    posts = other_side(edges, mention, entities)
    threads = other_side(edges, thread, posts, given="from_id")
    members = other_side(edges, thread, threads)
    stages = (("entities", entities), ("mentions", posts), ("threads", threads), ("members", members))
    out = None
    for name, ids in stages:
        rows = ids.select(F.lit(name).alias("stage"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, sources): the union of recalls with the set of those that found each document."""
    out = None
    for name, rows in sources.items():
        tagged = rows.select("doc_id", F.lit(name).alias("source"))
        out = tagged if out is None else out.unionByName(tagged)
    return out.groupBy("doc_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
