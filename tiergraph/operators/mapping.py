"""Which node type a foreign table holds, from its columns and its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions.similarity import token_set_ratio_udf
from tiergraph.operators.vectors import cosine, hash_embedding
from tiergraph.runtime import in_blocks

# From when a name alone decides, when vectors count, when a weak name does, and the routes.
LEXICAL, SEMANTIC, WEAK = 0.85, 0.50, 0.60
AUTO, REVIEW = 0.90, 0.60


def column_matches(columns: DataFrame, dictionary: DataFrame, *, block: int = 10_000) -> DataFrame:
    """(table_name, column_name, node_type, score): the best entry of a property dictionary (node_type, property, text) for each column.

    The dictionary is a stated set that all columns are held against, in blocks of about ``block`` entries.
    """
    words = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ _]+", "_")
    lexical = token_set_ratio_udf(words(F.col("column_name")), words(F.col("property"))) / 100.0
    tops = []
    for part in in_blocks(dictionary, block):
        pairs = columns.join(F.broadcast(part))
        scored = pairs.withColumns({"lex": lexical, "sem": cosine(hash_embedding(F.col("column_name")), hash_embedding(F.col("text")))})
        tops.append(scored.groupBy("table_name", "column_name").agg(F.max(F.struct("lex", "node_type")).alias("l"), F.max(F.struct("sem", "node_type")).alias("s")))
    best = reduce(DataFrame.unionByName, tops).groupBy("table_name", "column_name").agg(F.max("l").alias("l"), F.max("s").alias("s"))
    score = F.when(F.col("l.lex") >= LEXICAL, F.col("l.lex")).when(F.col("s.sem") >= SEMANTIC, 0.6 * F.col("s.sem") + 0.4 * F.col("l.lex")).when(F.col("l.lex") >= WEAK, F.col("l.lex") * 0.7)
    kind = F.when((F.col("l.lex") < LEXICAL) & (F.col("s.sem") >= SEMANTIC), F.col("s.node_type")).otherwise(F.col("l.node_type"))
    return best.select("table_name", "column_name", kind.alias("node_type"), score.alias("score")).where("score is not null")


def suggest(columns: DataFrame, dictionary: DataFrame, priors: DataFrame, decisions: DataFrame) -> DataFrame:
    """(table_name, target_type, confidence, routing): node types by their columns' scores.

    priors: table_name, node_type by the table's name, which wins against less than twice its score.
    decisions: table_name, node_type that people committed before, worth 0.05.
    """
    matched = column_matches(columns, dictionary)
    sizes = columns.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    totals = matched.groupBy("table_name", "node_type").agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, 5).alias("best"))
    top = totals.groupBy("table_name").agg(F.max("total").alias("most"))
    named = priors.select("table_name", "node_type", F.lit(True).alias("named"))
    ranked = totals.join(top, "table_name").join(named, ["table_name", "node_type"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    wins = F.struct((F.col("named") & (F.col("total") >= 0.5 * F.col("most"))).alias("named"), "total", "node_type", "n", "best")
    chosen = ranked.groupBy("table_name").agg(F.max(wins).alias("w")).select("table_name", "w.*").join(sizes, "table_name")
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")
    base = 0.5 * mean + 0.5 * F.least(F.lit(1.0), F.col("n") / F.col("n_columns"))
    base = F.when(F.col("named") & (mean >= 0.85) & (F.col("n") >= 2), F.greatest(base, F.lit(0.92))).when(F.col("named"), F.greatest(base, F.lit(0.85))).otherwise(base)
    known = decisions.select("table_name", "node_type", F.lit(0.05).alias("boost")).distinct()
    out = chosen.join(known, ["table_name", "node_type"], "left").withColumn("confidence", F.round(F.least(F.lit(1.0), base + F.coalesce("boost", F.lit(0.0))), 4))
    routing = F.when(F.col("confidence") >= AUTO, "auto").when(F.col("confidence") >= REVIEW, "hitl").otherwise("reject")
    return out.select("table_name", F.col("node_type").alias("target_type"), "confidence", routing.alias("routing"))
