"""WARC archives: writing records with revisits, and reading them back by boundary chains.

An archive is a file of records, each a head that starts with a magic line and tells
the length of the block after it. Payloads may hold the magic as well, so a reader that
starts in the middle of a file cannot trust what looks like a record. Tasks therefore
read their parts of a file independently, cut at every magic, and emit for each
candidate where its successor would start. A candidate is a record exactly if the chain
of successors from the file's start reaches it, which pointer jumping finds in
logarithmically many rounds; runs of candidates that follow each other directly within a part
are one jump from the start. Text after a false magic is put back into the record around it.
An archive is scanned once for the chain and once for the texts, and the scans may be split
differently, so the second finds what it looks for by file and digest, not by a row's place.

Archives are written and read by Spark's own text source, on any file system it knows.
Of payloads that are equal and have ``least`` bytes, the one with the largest id is
stored as a response; the others are revisit records that refer to it.

Defined results: a null payload is empty; rows that share the largest id of a payload
are all responses; a null id comes back null and counts as the smallest; a null URL is an
empty target; line ends in URLs are percent-encoded; an empty table gives archives
without records and an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiergraph.llm._common import drop_scratch, write_scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads below so many bytes are always stored.
LEAST = 1000
_ID = "urn:page:"
#: Chunks or digests are broadcast up to so many rows (some 10 MB at most); beyond that they are shuffled.
SMALL_ROWS = 100_000


def _head(kind: Column | str, row: Column, url: Column, digest: Column, extra: Column, length: Column) -> Column:
    lines = [
        F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)),
        F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), row, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        extra,
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """One archive a task, below ``path``, with a record for each row."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    chosen = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max("key").alias("stored"), F.count("*").alias("times")).where("times > 1")
    rows = rows.join(_if_small(chosen), "digest", "left")
    revisit = F.col("stored").isNotNull() & ~F.col("key").eqNullSafe(F.col("stored")) & (F.col("n") >= least)
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    row = F.coalesce("id", F.lit(""))
    full = F.concat(_head("response", row, url, F.col("digest"), F.lit(None).cast("string"), F.col("n") + len(HTTP)), F.lit(HTTP), F.col("payload"))
    refers = F.concat(F.lit(f"WARC-Refers-To: <{_ID}"), F.col("stored").cast("string"), F.lit(">"))
    again = _head("revisit", row, url, F.col("digest"), F.concat(refers, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.lit(0))
    rows.select(F.when(revisit, again).otherwise(full).alias("value")).write.option("lineSep", END).text(path)


def _if_small(chosen: DataFrame) -> DataFrame:
    """Payloads that repeat, broadcast if they are few."""
    chosen = write_scratch(chosen, "repeats")
    return F.broadcast(chosen) if chosen.count() <= SMALL_ROWS else chosen


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, digest): what stands between one magic and the next."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), "value", F.unhex(F.md5("value")).alias("digest"), F.col("_metadata.file_block_start").alias("part"))


def _field(name: str, head: Column) -> Column:
    return F.regexp_extract(head, rf"(?:^|\n){name}:[ \t]*([^\r\n]*)", 1)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: file, record_type, record_id, url, payload_digest, refers_to, payload (binary; null for revisits).

    ``record_id`` and ``refers_to`` are what follows the record's scheme.
    """
    #: The way to a chunk: its place is the sizes before it, within its part of the file and then over the parts.
    chunks = _chunks(spark, path)
    head = F.substring_index("value", END, 1)
    complete = F.instr("value", END) > 0
    length = F.when(complete, F.try_to_number(_field("Content-Length", head), F.lit("999999999999999")))
    span = F.octet_length(head) + len(MAGIC) + 2 * len(END) + length.cast("long")
    size = (F.octet_length("value") + len(MAGIC)).cast("long")
    skinny = write_scratch(chunks.select("file", "part", F.monotonically_increasing_id().alias("n"), "digest", size.alias("size"), span.alias("span")), "chunks")
    sizes = skinny.groupBy("file", "part").agg(F.sum("size").alias("all"))
    #: One row a part of a file, some hundred MB each, meet here; chunks meet within their part alone.
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = skinny.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["file", "part"])
    #: A file starts with the empty chunk before its first magic, so a chunk's magic is one magic to the left.
    placed = write_scratch(placed.select("file", "part", "digest", (F.col("base") + F.col("before") - len(MAGIC)).alias("at"), "span"), "placed")
    records = write_scratch(_reachable(placed), "records")

    #: Chunks of a record: its own, and those up to its successor, which began with a false magic.
    carried = records.groupBy("file", "part").agg(F.max("at").alias("latest"))
    carried = placed.select("file", "part").distinct().join(carried, ["file", "part"], "left").select("file", "part", F.max("latest").over(earlier).alias("carried"))
    upto = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = placed.join(records.withColumn("real", F.lit(True)), ["file", "part", "at"], "left").withColumn("latest", F.max(F.when(F.col("real"), F.col("at"))).over(upto))
    owned = write_scratch(marked.join(carried, ["file", "part"]).select("file", "digest", "at", F.coalesce("latest", "carried").alias("record")), "owned")
    #: Nearly all chunks are one record each, so only the others are looked up, with whatever equals them.
    shared = owned.groupBy("file", "record").agg(F.count("*").alias("n")).where("n > 1 or record is null").select("file", F.col("record").alias("r"))
    torn = owned.join(shared, (owned.file == shared.file) & owned.record.eqNullSafe(shared.r), "left_semi").select("file", "digest").distinct()
    torn = _if_small(torn)
    whole = chunks.join(torn, ["file", "digest"], "left_anti").select("file", "value")
    texts = chunks.join(torn, ["file", "digest"], "left_semi").groupBy("file", "digest").agg(F.first("value").alias("value"))
    places = owned.join(torn, ["file", "digest"], "left_semi").where("record is not null")
    pieces = places.join(texts, ["file", "digest"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    joined = pieces.select("file", F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).alias("value"))
    return _parsed(whole.unionByName(joined))


def _reachable(placed: DataFrame) -> DataFrame:
    """(file, part, at) of the candidates on the chain from the start of their file. Without a column part, a file is one part."""
    placed = placed if "part" in placed.columns else placed.withColumn("part", F.lit(0))
    order = Window.partitionBy("file", "part").orderBy("at")
    nodes = placed.where("at >= 0").select("file", "part", "at", (F.col("at") + F.col("span")).alias("next"))
    #: A run of candidates that follow each other directly within a part is one node.
    linked = nodes.withColumn("starts", F.when(F.lag("next").over(order) == F.col("at"), 0).otherwise(1))
    runs = write_scratch(linked.select("file", "part", "at", "next", F.sum("starts").over(order).alias("run")), "runs")
    run = ["file", "part", "run"]
    ends = runs.groupBy(*run).agg(F.min("at").alias("first"), F.max_by("next", "at").alias("next"))
    entry = runs.select("file", F.col("at").alias("next"), F.struct("part", "run").alias("to"), F.col("at").alias("enter"))
    hops = write_scratch(ends.select("file", F.struct("part", "run").alias("of"), "next").join(entry, ["file", "next"]).select("file", "of", "to", "enter"), "hops")
    #: A run may be entered in its middle; from there on all of it is reached.
    reached = write_scratch(ends.where("first = 0").select("file", F.struct("part", "run").alias("of"), F.col("first").alias("enter")), "reached")
    n_reached = reached.count()
    while True:
        step = reached.select("file", "of").join(hops, ["file", "of"]).select("file", F.col("to").alias("of"), "enter")
        grown = write_scratch(reached.unionByName(step).groupBy("file", "of").agg(F.min("enter").alias("enter")), "reached")
        n_grown = grown.count()
        if n_grown == n_reached:
            break
        drop_scratch(reached)
        reached, n_reached = grown, n_grown
        #: Twice as far: where two hops lead.
        far = hops.select("file", F.col("of").alias("to"), F.col("to").alias("to2"), F.col("enter").alias("enter2"))
        hops = write_scratch(hops.select("file", "of", "to").join(far, ["file", "to"]).select("file", "of", F.col("to2").alias("to"), F.col("enter2").alias("enter")), "hops")
    entered = grown.select("file", "of.part", "of.run", "enter")
    return runs.join(entered, run).where("at >= enter").select("file", "part", "at")


def _parsed(records: DataFrame) -> DataFrame:
    head = F.substring_index("value", END, 1)
    block = F.substring(F.col("value").cast("binary"), F.octet_length(head) + len(END) + 1, F.col("length").cast("int"))
    parsed = records.withColumns({"head": head, "length": F.try_to_number(_field("Content-Length", head), F.lit("999999999999999")).cast("long")}).withColumn("block", block)
    body = F.instr(F.col("block").cast("string"), END)
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    payload = F.when(body > 0, F.substring("block", http + 1, F.octet_length("block"))).otherwise(F.col("block"))
    strip = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit("\n"), F.col("head")), rf"\n{name}:[ \t]*<{_ID}([^>\r\n]*)>", 1), F.lit(""))
    return parsed.select(
        "file", _field("WARC-Type", F.col("head")).alias("record_type"), strip("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI", F.col("head")).alias("url"),
        F.regexp_replace(_field("WARC-Payload-Digest", F.col("head")), "^sha1:", "").alias("payload_digest"), strip("WARC-Refers-To").alias("refers_to"),
        F.when(_field("WARC-Type", F.col("head")) != "revisit", payload).alias("payload"),
    )
