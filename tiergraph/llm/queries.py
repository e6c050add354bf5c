"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.llm import toxicity
from tiergraph.llm._common import scratch_path, table, write_scratch
from tiergraph.llm.decontaminate import find_leaks
from tiergraph.llm.jaccard_join import jaccard_components
from tiergraph.llm.mixing import MIX_SQL, mix_sources
from tiergraph.llm.pii import find_pii, spans_text
from tiergraph.llm.quality_rules import score_quality
from tiergraph.llm.suffix_dedup import remove_repeats
from tiergraph.llm.token_counts import count_tokens
from tiergraph.llm.url_filters import judge_captures, url_host
from tiergraph.llm.warc import read_archives, write_archives

TOKENIZER = "byte_bpe_50k.json"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures. They carry no fetch time, so page_id gives a day of 2024 or 2025."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.coalesce("page_id", F.lit(0)) * 37 % 730).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.cast("timestamp").alias("fetched_at"))


def url_lists(pages: DataFrame) -> DataFrame:
    """A history of dated list entries for the sites of the pages, by the digest of the site's name."""
    host = url_host(F.col("url"))
    site = F.substring_index(host, ".", -3)
    first = F.regexp_extract("url", r"(?i)^\s*https?://[^/?#]*/([^/?#\s]+)", 1)
    known = pages.select(host.alias("host"), site.alias("site"), first.alias("first")).where("host is not null").distinct()
    digit = lambda i: F.conv(F.substring(F.md5("name"), i, 1), 16, 10).cast("int")
    day = lambda base: F.date_add(F.lit("2024-01-01").cast("date"), F.lit(base) + digit(2) * 16 + digit(3))

    def entries(name: str, kind: str, pattern: str, action: str, low: int, high: int, which: Column) -> DataFrame:
        chosen = known.select(F.col(which).alias("name"), F.col(pattern).alias("pattern") if pattern != "path" else F.concat_ws("/", "host", F.when(F.col("first") != "", F.col("first"))).alias("pattern")).distinct().where(digit(1).between(low, high))
        row = lambda base, event: F.struct(day(base).alias("listed_at"), F.lit(event).alias("event"))
        #: All are added, half of them removed, a quarter added again.
        rows = F.array(row(0, "add"), F.when(digit(4) < 8, row(150, "remove")), F.when(digit(4) < 4, row(300, "add")))
        return chosen.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), F.explode(rows).alias("e")).where("e is not null").select("list", "kind", "pattern", "action", "e.listed_at", "e.event")

    return entries("bad-domains", "domain", "site", "deny", 0, 5, "site").unionByName(entries("good-hosts", "host", "host", "allow", 4, 9, "host")).unionByName(entries("bad-paths", "path", "path", "deny", 8, 12, "host"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures(spark, sf_dir)
    return judge_captures(found, url_lists(found)).select("page_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "verdict", "matched_key", "matched_list", "n_active")


#: op1's rows in DuckDB's SQL: every capture against the intervals of its keys.
URL_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(coalesce(page_id, 0) * 37 % 730 AS INTEGER) AS seen,
         nullif(rtrim(lower(regexp_extract(coalesce(url, ''), '(?i)^\s*https?://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1)), '.'), '') AS host,
         regexp_extract(url, '(?i)^\s*https?://[^/?#]*/([^/?#\s]+)', 1) AS first,
         list_filter(string_split(regexp_extract(url, '(?i)^\s*https?://[^/?#]*/([^?#\s]*)', 1), '/'), lambda s: s <> '')[1:3] AS segments
  FROM pages),
known AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[-3:], '.') AS site, first FROM captures WHERE host IS NOT NULL),
named AS (
  SELECT DISTINCT 'bad-domains' AS list, 'domain' AS kind, site AS pattern, 'deny' AS action, site AS name, 0 AS low, 5 AS high FROM known UNION
  SELECT DISTINCT 'good-hosts', 'host', host, 'allow', host, 4, 9 FROM known UNION
  SELECT DISTINCT 'bad-paths', 'path', CASE WHEN first <> '' THEN host || '/' || first ELSE host END, 'deny', host, 8, 12 FROM known),
digits AS (
  SELECT *, strpos('0123456789abcdef', md5(name)[1]) - 1 AS d1, strpos('0123456789abcdef', md5(name)[2]) - 1 AS d2,
         strpos('0123456789abcdef', md5(name)[3]) - 1 AS d3, strpos('0123456789abcdef', md5(name)[4]) - 1 AS d4 FROM named),
intervals AS (
  SELECT list, kind || ':' || lower(pattern) AS key, action, CAST(DATE '2024-01-01' + CAST(d2 * 16 + d3 AS INTEGER) AS DATE) AS since,
         CASE WHEN d4 < 8 THEN CAST(DATE '2024-01-01' + CAST(150 + d2 * 16 + d3 AS INTEGER) AS DATE) END AS until
  FROM digits WHERE d1 BETWEEN low AND high UNION ALL
  SELECT list, kind || ':' || lower(pattern), action, CAST(DATE '2024-01-01' + CAST(300 + d2 * 16 + d3 AS INTEGER) AS DATE), NULL
  FROM digits WHERE d1 BETWEEN low AND high AND d4 < 4),
keys AS (
  SELECT page_id, seen, 'host:' || host AS key, 100 AS rank FROM captures WHERE host IS NOT NULL UNION ALL
  SELECT page_id, seen, 'domain:' || array_to_string(string_split(host, '.')[i:], '.'), len(string_split(host, '.')) - i + 1
  FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) t(i) WHERE host IS NOT NULL UNION ALL
  SELECT page_id, seen, 'path:' || host || '/' || array_to_string(segments[1:i], '/'), 200 + i
  FROM captures, unnest(range(1, len(segments) + 1)) t(i) WHERE host IS NOT NULL),
met AS (
  SELECT k.page_id, k.rank, i.key, i.list, i.action,
         row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC, CASE WHEN i.action = 'deny' THEN 0 ELSE 1 END, i.key, i.list) AS place,
         count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keys k JOIN intervals i ON k.key = i.key AND k.seen >= i.since AND (i.until IS NULL OR k.seen < i.until))
SELECT c.page_id, strftime(c.seen, '%Y-%m-%d') AS fetched_on, coalesce(m.action, 'none') AS verdict, m.key AS matched_key, m.list AS matched_list,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_active
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id AND m.place = 1
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = score_quality(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    found = write_scratch(records.select(F.col("record_id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")), "records")
    #: A revisit's size is that of the response it refers to.
    stored = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("stored_bytes"), "payload_digest").join(found.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi").distinct()
    joined = found.join(stored, ["refers_to", "payload_digest"], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH payloads AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
stored AS (SELECT payload_digest, max(page_id) AS stored FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM payloads LEFT JOIN stored USING (payload_digest)
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items are counted first, into the cache that the documents then find."""
    import public_tokenizers

    tokenizer, cache = public_tokenizers.path(TOKENIZER), scratch_path(spark, "token_cache")
    count_tokens(table(spark, sf_dir, "benchmark"), tokenizer, cache_path=cache, id_col="item_id")
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer, cache_path=cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks alone: a document that leaks nothing has no row."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)
    return leaks.select("doc_id", "item_id", "n_windows", "n_found", F.round("containment", 6).alias("containment"), "n_slots", "n_conflicts", "verbatim")


def held_out(doc_id: Column) -> Column:
    """Rows that no model here may learn from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, _ = find_pii(table(spark, sf_dir, "documents"))
    base = spans_text(F.col("spans"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("spans", F.coalesce("terms", F.slice("spans", 1, 0)))
    return spans.select(F.col("id").alias("doc_id"), *map(n, ("email", "ip", "card", "phone")), F.sha2(base, 256).alias("base_sha256"), spans_text(every).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_quality_rules": op2_quality_rules,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_mix_sources": op4_mix_sources,
        "op5_warc": op5_warc,
        "op6_token_counts": op6_token_counts,
        "op7_decontaminate": op7_decontaminate,
        "op8_toxicity": op8_toxicity,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": URL_SQL, "op4_mix_sources": MIX_SQL.format(documents="documents"), "op5_warc": WARC_SQL}
