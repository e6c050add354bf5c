"""A repository's documents, code and tests as a graph, and questions about it.

files: path, content. Nodes have id, kind, name, feature, text; edges kind, from_id, to_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIREMENT = r"\b((?:FR|NFR)-[0-9]+(?:\.[0-9a-z]+)*(?:-[0-9]+)*)\b"
CRITERION = r"\b(AC-[0-9]+(?:\.[0-9a-z]+)*(?:-[0-9]+)*)\b"


def _feature(path: Column) -> Column:
    """The folder below a features folder."""
    return F.nullif(F.regexp_extract(path, r"features/([^/]+)/", 1), F.lit(""))


def parse_files(files: DataFrame) -> DataFrame:
    """Nodes: features, documents and their sections, requirements and criteria, code files, functions, classes, tests."""
    f = files.withColumn("feature", _feature(F.col("path")))
    docs, code = f.where(F.col("path").endswith(".md")), f.where(F.col("path").endswith(".py"))
    none = F.lit(None).cast("string")

    def node(rows: DataFrame, kind: str, ident: Column, name: Column, text: Column) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{kind}:"), ident).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), "feature", text.alias("text"), "path")

    out = node(f.where("feature is not null").groupBy("feature").agg(F.min("path").alias("path")), "feature", F.col("feature"), F.col("feature"), none)
    out = out.unionByName(node(docs, "doc", F.col("path"), F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1), none))
    sections = docs.select("path", "feature", F.posexplode(F.split("content", r"(?m)^(?=##+ )")).alias("at", "text")).where("at > 0")
    out = out.unionByName(node(sections, "section", F.concat_ws("#", "path", F.col("at").cast("string")), F.regexp_extract("text", r"^##+ +([^\n]*)", 1), F.col("text")))
    for kind, pattern in (("requirement", REQUIREMENT), ("criterion", CRITERION)):
        found = docs.where("feature is not null").select("path", "feature", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("ref"))
        found = found.groupBy("feature", "ref").agg(F.min("path").alias("path"))
        out = out.unionByName(node(found, kind, F.concat_ws("/", "feature", "ref"), F.col("ref"), none))
    out = out.unionByName(node(code, "code", F.col("path"), F.element_at(F.split("path", "/"), -1), none))
    defs = code.select("path", "feature", F.explode(F.split("content", r"(?m)^(?=[ \t]*(?:async )?def |class )")).alias("text")).withColumn("name", F.regexp_extract("text", r"^[ \t]*(?:async )?(?:def|class) +(\w+)", 1)).where("name <> ''")
    kind = F.when(F.col("name").startswith("test_"), "test").when(F.col("text").rlike(r"^class "), "class").otherwise("function")
    named = defs.withColumn("k", kind)
    return out.unionByName(named.select(F.concat(F.col("k"), F.lit(":"), F.concat_ws("::", "path", "name")).alias("id"), F.col("k").alias("kind"), "name", "feature", "text", "path").dropDuplicates(["id"]))


def derive_edges(nodes: DataFrame) -> DataFrame:
    """All derived edges, once each."""
    by = lambda k: nodes.where(F.col("kind") == k)
    edge = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "from_id", "to_id")
    feature = by("feature").select("feature", F.col("id").alias("from_id"))
    out = edge(feature.join(by("requirement").select("feature", F.col("id").alias("to_id")), "feature"), "FEATURE_HAS_REQUIREMENT")
    out = out.unionByName(edge(feature.join(by("doc").select("feature", F.col("id").alias("to_id")), "feature"), "FEATURE_DOCUMENTED_BY"))
    number = lambda c: F.regexp_replace(c, r"^[A-Z]+-", "")
    reqs = by("requirement").select("feature", number(F.col("name")).alias("n"), F.col("id").alias("from_id"))
    out = out.unionByName(edge(reqs.join(by("criterion").select("feature", number(F.col("name")).alias("n"), F.col("id").alias("to_id")), ["feature", "n"]), "REQUIREMENT_HAS_CRITERION"))
    for kind, pattern in (("requirement", REQUIREMENT), ("criterion", CRITERION)):
        cited = by("test").select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("name"))
        out = out.unionByName(edge(cited.join(by(kind).select("name", F.col("id").alias("to_id")), "name"), f"TEST_COVERS_{kind.upper()}"))
    ticks = by("section").select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"`([^`\n]+?)`"), F.lit(1)))).alias("token"))
    token = F.regexp_replace(F.regexp_replace("token", r"\(.*$", ""), r":[0-9\-]+$", "")
    targets = nodes.where("kind in ('code', 'function', 'class')").select(F.col("id").alias("to_id"), F.explode(F.array("name", "path")).alias("token"), "kind")
    targets = targets.where("kind = 'code' or not contains(token, '/')")
    return out.unionByName(edge(ticks.withColumn("token", token).join(targets, "token"), "SECTION_REFERENCES_CODE")).distinct()


def docs_for_code(edges: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Sections that name a file or what is defined in it."""
    inside = nodes.where((F.col("path") == path) & F.col("kind").isin("code", "function", "class")).select(F.col("id").alias("to_id"))
    return edges.where("kind = 'SECTION_REFERENCES_CODE'").join(inside, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct().join(nodes, "id")


def stale_docs(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc path, n): documents with sections about changed files (path) that did not change themselves."""
    touched = nodes.join(changed, "path", "left_semi").select(F.col("id").alias("to_id"))
    sections = edges.where("kind = 'SECTION_REFERENCES_CODE'").join(touched, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    return sections.join(nodes.select("id", "path"), "id").join(changed, "path", "left_anti").groupBy("path").agg(F.count("*").alias("n"))


def plan_change(nodes: DataFrame, request: str, *, hits: int = 40, features: int = 3) -> DataFrame:
    """(feature, n_hits, relevance): features by how many of the best hits for a request are theirs."""
    from tiergraph.operators.retrieval import bm25

    texts = nodes.select("id", "feature", F.concat_ws(" ", "name", "text").alias("t"))
    best = bm25(texts, request, id_col="id", text_col="t", limit=hits).join(texts.select("id", "feature"), "id").where("feature is not null")
    ranked = best.groupBy("feature").agg(F.count("*").alias("n_hits"), F.round(F.sum(1 / (F.abs("score") + 1)), 6).alias("relevance"))
    return ranked.orderBy(F.desc("n_hits"), F.desc("relevance"), "feature").limit(features)


def coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(feature, requirements, covered): requirements that some test names."""
    covered = edges.where("kind = 'TEST_COVERS_REQUIREMENT'").select(F.col("to_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return nodes.where("kind = 'requirement'").join(covered, "id", "left").groupBy("feature").agg(F.count("*").alias("requirements"), F.sum(F.coalesce("hit", F.lit(0))).alias("covered"))
