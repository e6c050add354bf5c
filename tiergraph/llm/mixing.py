"""Mixing sources to target weights: hash-threshold histograms.

Every document gets a 60-bit hash of its id and text. A source whose target is a part
of its size takes the documents below a hash threshold; whole multiples are
taken as whole passes. The threshold comes from nested histograms: words are
summed by source and hash bucket, the bucket in which the budget runs out is
found per source, and only that bucket is summed again in finer buckets. No
document is sorted, and nothing but per-source rows leaves the executors.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows that share id and text share their hash, so they are taken or
left together; an empty table gives an empty result; columns beyond those named
by the parameters are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.llm._common import n_words, write_scratch

HASH_BITS = 60
LEVEL_BITS = 12


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text, a space, and the text (null: nothing)."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))), 1, HASH_BITS // 4)
    return F.conv(hexed, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Water-filling over (source, source_size): adds target, budget (the words of the last, partial pass) and passes.

    One row per source, so the single-partition windows here hold as many rows as
    there are sources, never documents.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    every = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(names)).withColumn("weight", F.element_at(every, (F.col("rank") - 1) % len(weights) + 1))
    by_fill = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1))
    filled = (
        ranked.withColumn("cap", F.col("source_size") * max_repeat)
        .withColumns({"all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole)})
        .withColumns({"left": F.col("all_size") - F.sum("cap").over(by_fill) + F.col("cap"), "left_weight": F.col("all_weight") - F.sum("weight").over(by_fill) + F.col("weight")})
        .withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left"))
    )
    free = filled.withColumns({"free_size": F.col("all_size") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0)), "free_weight": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("free_size")).cast("double") / F.col("free_weight").cast("double"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return free.withColumn("target", target).withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")).select("source", "source_size", "target", "passes", "budget")


def hash_thresholds(skinny: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, threshold): the part of a source with a hash below threshold is as near its budget as whole documents allow."""
    found = targets.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        bucketed = skinny.select("source", "size", F.shiftright("hash", shift).alias("bucket"), F.shiftright("hash", shift + LEVEL_BITS).alias("parent"))
        sums = bucketed.groupBy("source", "parent", "bucket").agg(F.sum("size").alias("in_bucket")) if level == 1 else (
            bucketed.join(found.select("s", "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.col("parent") == F.col("prefix")), "left_semi")
            .groupBy("source", "parent", "bucket").agg(F.sum("size").alias("in_bucket"))
        )
        #: At most 2^12 buckets of each source meet here.
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("in_bucket").over(running))
        over = sums.join(found, F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("rest"))
        found = over.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("in_bucket")).alias("rest"), "in_bucket"), "bucket").alias("b")).select(F.col("source").alias("s"), F.col("b.bucket").alias("prefix"), F.col("b.rest").alias("rest"), F.col("b.in_bucket").alias("last"))
        found = write_scratch(found, f"level{level}")  # a row a source; else each level would be planned and run again by the next
    #: What is left is one hash value a source; it counts when more than half of it fits.
    return found.select(F.col("s").alias("source"), (F.col("prefix") + F.when(F.col("rest") * 2 >= F.col("last"), 1).otherwise(0)).alias("threshold"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), copies, taken = size * copies.

    Sources, in code-point order with null last, weigh as ``weights`` repeats and
    share the total size; a source's target stops at ``max_repeat`` times its size
    and the excess is shared again by weight.
    """
    skinny = write_scratch(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("hash")), "sizes")
    targets = write_scratch(source_targets(skinny.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat), "targets")
    plan = targets.select("source", "source_size", "target", "passes").alias("t").join(hash_thresholds(skinny, targets).alias("h"), F.col("t.source").eqNullSafe(F.col("h.source")), "left")
    plan = write_scratch(plan.select(F.col("t.source").alias("s"), "source_size", "target", "passes", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")), "plan")
    copies = F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return skinny.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


#: The same rows as op4's query in DuckDB's SQL; {documents} is a table or subquery.
MIX_SQL = r"""
WITH skinny AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM {documents}),
ranked AS (
  SELECT source, source_size, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 3 * source_size AS cap, rank
  FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM skinny GROUP BY source)),
filled AS (
  SELECT *, cap * (sum(weight) OVER () - sum(weight) OVER fill + weight) <= weight * (sum(source_size) OVER () - sum(cap) OVER fill + cap) AS capped
  FROM ranked WINDOW fill AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) AS DOUBLE)
         / CAST(sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target
  FROM filled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget
  FROM targets),
upto AS (
  SELECT source, hash, sum(size) AS last, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto FROM skinny GROUP BY source, hash),
thresholds AS (
  SELECT u.source, arg_min(CASE WHEN (b.budget - u.upto + u.last) * 2 >= u.last THEN u.hash + 1 ELSE u.hash END, u.hash) AS threshold
  FROM upto u JOIN budgets b ON u.source IS NOT DISTINCT FROM b.source WHERE u.upto > b.budget GROUP BY u.source)
SELECT s.doc_id, s.size, CAST(b.source_size AS BIGINT) AS source_size, b.target,
       CAST(s.size * (b.passes + CASE WHEN s.hash < coalesce(t.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM skinny s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN thresholds t ON s.source IS NOT DISTINCT FROM t.source
"""
