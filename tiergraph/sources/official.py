"""Official sources: sheets, pages, dumps, and the claims they make."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiergraph.functions.text import content_id, html_canonical, html_published, html_title, slug, strip_html
from tiergraph.model import make_edges, make_nodes

# Words of names that are no entities, and the longest body of a document node.
JUNK_NAMES = ("test", "sample", "example", "demo", "placeholder", "dummy", "tbd", "unknown", "mean", "median", "average", "totals?", "non-?zero", "excluding")
MAX_BODY = 4000


def is_junk_name(name: Column) -> Column:
    """Empty, test, placeholder and aggregate names."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | n.rlike(r"(?i)\b(" + "|".join(JUNK_NAMES) + r")\b") | F.startswith(F.lower(n), F.lit("number of"))


def metric_predicate(name: Column) -> Column:
    """tuition_resident or tuition_nonresident of a tuition header, by what follows its last dash; else null."""
    last = F.lower(F.trim(F.element_at(F.split(name, " - "), -1)))
    kind = F.when(last.rlike("non-?resident"), "tuition_nonresident").when(F.contains(last, F.lit("resident")), "tuition_resident")
    return F.when(name.rlike("(?is)tuition by class"), kind)


# Headers of the school, state and city columns, parts of such headers, and headers that are no metrics.
SCHOOL_HEADERS = ("school", "dental school", "institution", "name", "school name")
SCHOOL_PARTS = ("dental schools", "dental-schools", "coda-accredited dental", "dental school 1", "dental school 2", "dental school 3", "dental school (")
STATE_HEADERS, STATE_PARTS = ("state", "st", "state / province", "state/province"), ("state /", "state/", "state / country", "country / province")
OTHER_HEADERS = ("city", "type", "type of institutional support", "country", "region")


def _names(cell: Column, whole: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    low = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    out = low.isin(*whole)
    for x in parts:
        out = out | F.contains(low, F.lit(x))
    return out


def sheet_headers(rows: DataFrame) -> DataFrame:
    """(sheet, header_row, school_at, state_at, metrics) of raw sheets (sheet, row, cells): the first row that names a school column is the header.

    metrics are structs (at, name) of all other named columns. Places count from 0; a sheet without such a row has none.
    """
    school = lambda c: _names(c, SCHOOL_HEADERS, SCHOOL_PARTS)
    state = lambda c: _names(c, STATE_HEADERS, STATE_PARTS)
    heads = rows.where(F.exists("cells", school)).groupBy("sheet").agg(F.min(F.struct("row", "cells")).alias("h")).select("sheet", "h.*")
    at = lambda hit: F.element_at(F.filter(F.transform("cells", lambda c, i: F.when(hit(c), i)), lambda i: i.isNotNull()), 1)
    named = F.transform("cells", lambda c, i: F.struct(i.alias("at"), F.trim(c).alias("name")))
    metric = F.filter(named, lambda x: (x["name"] != "") & ~school(x["name"]) & ~state(x["name"]) & ~F.lower(x["name"]).isin(*OTHER_HEADERS))
    first = lambda hit: F.when(F.exists("cells", hit), at(hit))
    return heads.select("sheet", F.col("row").alias("header_row"), first(school).alias("school_at"), first(state).alias("state_at"), metric.alias("metrics"))


def sheet_values(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, school, state, metric_name, metric_value) of the rows below each sheet's header."""
    body = rows.join(headers, "sheet").where("row > header_row")
    cell = lambda i: F.nullif(F.trim(F.get("cells", i)), F.lit(""))
    long = body.select("sheet", cell(F.col("school_at")).alias("school"), cell(F.col("state_at")).alias("state"), "cells", F.explode("metrics").alias("m"))
    value = F.regexp_replace(F.get("cells", F.col("m.at")), r"[$,%\s]", "").try_cast("double")
    return long.select("sheet", "school", "state", F.col("m.name").alias("metric_name"), value.alias("metric_value")).where("school is not null and metric_value is not null")


def unpivot_sheet(sheet: DataFrame, keys: list[str], cycle: str) -> DataFrame:
    """(keys, cycle_year, metric_name, metric_value) for every other column that holds a number in a row."""
    others = [c for c in sheet.columns if c not in keys]
    long = sheet.select(*keys, *[F.col(c).cast("string").alias(c) for c in others]).unpivot(keys, others, "metric_name", "text")
    value = F.regexp_replace("text", r"[$,%\s]", "").try_cast("double")
    return long.withColumn("metric_value", value).where("metric_value is not null").select(*keys, F.lit(cycle).alias("cycle_year"), "metric_name", "metric_value")


def schools_of(sheet: DataFrame, name_col: str, state_col: str) -> DataFrame:
    """(canonical_id, canonical_name, state): a school a name and state, junk left out."""
    kept = sheet.where(~is_junk_name(F.col(name_col))).select(F.trim(name_col).alias("canonical_name"), F.trim(state_col).alias("state")).distinct()
    return kept.withColumn("canonical_id", F.concat(F.lit("school:"), slug(F.concat_ws(" ", "canonical_name", "state"))))


def assemble_official(schools: DataFrame, metrics: DataFrame, aliases: DataFrame, dump_id: str, ingest: datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): schools, metrics of a cycle with its valid window, aliases and the dump itself, whose nodes are emitted as well."""
    dump = schools.sparkSession.createDataFrame([(dump_id,)], "dump_id string")
    metric_id = F.concat_ws(":", F.lit("metric"), F.substring(F.sha2(F.concat_ws("|", "canonical_id", "cycle_year", "metric_name"), 256), 1, 16))
    alias_id = F.concat(F.lit("alias_node:"), slug(F.col("alias_text")))
    nodes = make_nodes(schools, "School", "L1", F.col("canonical_id"), F.struct("canonical_name", "state"))
    nodes = nodes.unionByName(make_nodes(metrics, "Metric", "L1", metric_id, F.struct("metric_name", "metric_value", "cycle_year", F.col("canonical_id").alias("school_id"))))
    nodes = nodes.unionByName(make_nodes(aliases.select("alias_text").distinct(), "Alias", "L1", alias_id, F.struct("alias_text")))
    nodes = nodes.unionByName(make_nodes(dump, "Dump", "L1", F.concat(F.lit("dump:"), "dump_id"), F.struct("dump_id")))
    year = F.substring("cycle_year", 1, 4).try_cast("int")
    window = (F.make_timestamp(year, F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(year + 1, F.lit(6), F.lit(30), F.lit(0), F.lit(0), F.lit(0)))
    known = (F.lit(ingest), None)
    edges = make_edges(metrics, "SCHOOL_HAS_METRIC", "L1", F.col("canonical_id"), metric_id, rank="preferred", qualifiers=F.create_map(F.lit("cycle_year"), F.col("cycle_year")), valid=window, ingest=known)
    edges = edges.unionByName(make_edges(aliases, "HAS_ALIAS", "L1", F.col("canonical_id"), alias_id, rank="preferred", ingest=known, confidence=F.col("confidence")))
    return nodes, edges.unionByName(make_edges(schools, "PROVENANCE", "L1", F.col("canonical_id"), F.lit(f"dump:{dump_id}"), ingest=known))


def html_documents(pages: DataFrame, path_col: str, html_col: str, tier: str = "L2") -> DataFrame:
    """(doc_id, title, body, url, published, source_tier) of pages."""
    body, html = strip_html(F.col(html_col)), F.col(html_col)
    return pages.select(F.concat(F.lit("l2doc:"), content_id(F.col(path_col), body)).alias("doc_id"), html_title(html).alias("title"), body.alias("body"), html_canonical(html).alias("url"), F.try_to_timestamp(html_published(html)).alias("published"), F.lit(tier).alias("source_tier"))


def page_documents(pages: DataFrame, source_name: str) -> DataFrame:
    """Page texts (page_no, text) as documents (doc_id, page_no, title, cycle_year, body)."""
    return pages.select(F.concat_ws(":", F.lit("l1doc"), slug(F.lit(source_name)), F.col("page_no").cast("string")).alias("doc_id"), "page_no", F.substring(F.trim(F.regexp_extract("text", r"^\s*([^\n]+)", 1)), 1, 200).alias("title"), F.nullif(F.regexp_extract("text", r"\b(20\d\d-\d\d)\b", 1), F.lit("")).alias("cycle_year"), F.substring("text", 1, MAX_BODY).alias("body"))


def metric_claims(metrics: DataFrame, ingest: datetime) -> DataFrame:
    """Claims of the latest cycle of each (school, predicate)."""
    named = metrics.withColumn("predicate", metric_predicate(F.col("metric_name"))).where("predicate is not null")
    best = named.groupBy(F.col("canonical_id").alias("subject_id"), "predicate").agg(F.max(F.struct("cycle_year", "metric_value")).alias("m"))
    return best.select(F.concat_ws(":", F.lit("claim"), "subject_id", "predicate").alias("claim_id"), "subject_id", "predicate", F.col("m.metric_value").cast("string").alias("object_value"), F.lit("L1").alias("source_tier"), F.lit(1.0).alias("credibility"), F.col("m.cycle_year").alias("cycle_year"), F.lit(ingest).cast("timestamp").alias("t_ingest_from"))


def fact_claims(entities: DataFrame, id_col: str, facts: list[str], cycle: str) -> DataFrame:
    """Claims of the fact columns that are not null."""
    long = entities.select(id_col, *[F.col(c).cast("string").alias(c) for c in facts]).unpivot([id_col], facts, "predicate", "object_value").where("object_value is not null")
    return long.select(F.concat_ws(":", F.lit("claim"), id_col, "predicate").alias("claim_id"), F.col(id_col).alias("subject_id"), "predicate", "object_value", F.lit("L1").alias("source_tier"), F.lit(cycle).alias("cycle_year"))


def supersede_changed(versions: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Versions whose value differs from the one before, closed where the next begins."""
    order = Window.partitionBy(*keys).orderBy(time)
    changed = versions.withColumn("__was", F.lag(F.col(value).cast("string")).over(order)).where(F.col("__was").isNull() | (F.col("__was") != F.col(value).cast("string")))
    return changed.withColumn("t_to", F.lead(time).over(order)).drop("__was")


def residency(programs: DataFrame, institutions: DataFrame, specialties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of programmes that an institution offers in a specialty; missing partners give no edge."""
    node = lambda rows, label: make_nodes(rows.where(~is_junk_name(F.col("name"))), label, "L1", F.concat(F.lit(label.lower() + ":"), F.col("id").cast("string")), F.struct("name"))
    nodes = node(specialties, "Specialty").unionByName(node(institutions, "Institution")).unionByName(node(programs, "Program"))
    me = F.concat(F.lit("program:"), F.col("id").cast("string"))
    offered = programs.join(institutions.select(F.col("id").alias("institution_id")), "institution_id", "left_semi")
    within = programs.join(specialties.select(F.col("id").alias("specialty_id")), "specialty_id", "left_semi")
    edges = make_edges(offered, "OFFERED_BY", "L1", me, F.concat(F.lit("institution:"), F.col("institution_id").cast("string")))
    return nodes, edges.unionByName(make_edges(within, "IN_SPECIALTY", "L1", me, F.concat(F.lit("specialty:"), F.col("specialty_id").cast("string"))))


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a written graph."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges by label, so that scans of a label read its files alone; once per id, and no edge without its ends."""
    from tiergraph.operators.graph import drop_dangling, latest

    kept = latest(nodes, ["id"], [F.col("source_tier"), F.col("properties_json")])
    kept.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    drop_dangling(edges, kept).write.mode("overwrite").partitionBy("label").parquet(f"{folder}/edges")
