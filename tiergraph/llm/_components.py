"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import drop_scratch, write_scratch

#: Links that one task joins up; more take rounds over all tasks, which cost the same for a few links.
ALONE = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return linked.where("v <> m").select(F.col("m").alias("u"), "v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) -> (node, component), by union-find: the lesser root is the root of both."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            if (a := root(u)) != (b := root(v)):
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array(map(root, list(parent)), kind)], ["node", "component"])


def connected_components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, component) for every node with a link; component is its least reachable node.

    ``edges`` has two columns of one sortable type. Each round is written to the
    shared folder; the number of rounds is logarithmic in the longest chain. Up to
    ``alone`` links, at first or after a round, are joined up by one task.
    Self-links and repeated links are allowed; no links give an empty table.
    """
    a, b = edges.columns
    now = write_scratch(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        if mark[0] <= alone:
            kind = now.schema["u"].dataType.simpleString()
            found = write_scratch(now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"), "joined")
            drop_scratch(now)
            return found
        seen, before = mark, now
        now = write_scratch(_small_star(_large_star(before)), "edges")
        drop_scratch(before)
    return now.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component").unionByName(now.groupBy("u").agg(F.min("u").alias("component")).select(F.col("u").alias("node"), "component"))
