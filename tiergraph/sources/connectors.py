"""Databases and files as sources: delta pulls by typed per-table cursors, receipts, registries, dumps."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiergraph.runtime import scratch_path

RECEIPT_SCHEMA = "source_id string, pulled_at timestamp, mode string, status string, rows long, cursor_value string, error string"


def delta(table: DataFrame, cursor_column: str, after) -> DataFrame:
    """Rows past a cursor, all without one. On JDBC and Parquet the filter is pushed down."""
    return table if after is None else table.where(F.col(cursor_column) > F.lit(after))


def next_cursor(table: DataFrame, cursor_column: str):
    """The largest cursor value; null for an empty table."""
    return table.agg(F.max(cursor_column)).first()[0]


def jdbc(spark: SparkSession, url: str, table: str, *, partition: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """A relational table (PostgreSQL, MySQL, SQLite by their drivers); ``partition`` is (column, low, high, readers)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(n))
    return reader.load()


def discover_schema(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """(table_name, column_name, data_type, ordinal) of a database that has an information schema."""
    query = "(SELECT table_name, column_name, data_type, ordinal_position AS ordinal FROM information_schema.columns WHERE table_schema NOT IN ('information_schema', 'pg_catalog')) c"
    return jdbc(spark, url, query, **options)


def sqlite_source(path: str):
    """A Spark data source class for SQLite files, which need no driver: options table, and after with cursor for deltas."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, schema, options):
            self.names, self.options = [f.name for f in schema], options

        def partitions(self):
            import sqlite3

            with sqlite3.connect(path) as db:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()  # noqa: S608
            if low is None:
                return []
            step = max(1, (high - low) // int(self.options.get("readers", 4)) + 1)
            return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

        def read(self, partition):
            import sqlite3

            columns = ", ".join(f'"{n}"' for n in self.names)
            sql, values = f'SELECT {columns} FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?', list(partition.value)  # noqa: S608
            if self.options.get("after"):
                sql, values = sql + f' AND "{self.options["cursor"]}" > ?', [*values, self.options["after"]]
            with sqlite3.connect(path) as db:
                yield from db.execute(sql, values)

    class SQLite(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tiergraph_sqlite"

        def schema(self) -> str:
            import sqlite3

            kinds = {"INTEGER": "long", "INT": "long", "REAL": "double"}
            with sqlite3.connect(path) as db:
                return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in db.execute(f'PRAGMA table_info("{self.options["table"]}")'))

        def reader(self, schema):
            return Reader(schema, self.options)

    return SQLite


def pull(source_id: str, read: Callable[[object], DataFrame], cursor_column: str, after, *, mode: str = "delta", target: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(receipt, rows): one pull. A source that fails gives an errored receipt and no rows; the cursor then stays.

    Rows are landed (at ``target``, else in the shared folder) before they are counted, so that what a receipt says is what was read, whatever the source does later.
    """
    spark = SparkSession.active()
    try:
        path = target or scratch_path(spark, "pull")
        fresh = delta(read(after), cursor_column, after if mode == "delta" else None)
        fresh.write.parquet(path)
        rows = spark.read.schema(fresh.schema).parquet(path)
        n, last = rows.agg(F.count("*"), F.max(cursor_column)).first()
        receipt = (source_id, datetime.now(), mode, "ok", n, str(last if last is not None else after), None)
    except Exception as error:  # noqa: BLE001  whatever a foreign source raises belongs in the receipt
        rows, receipt = None, (source_id, datetime.now(), mode, "errored", 0, None if after is None else str(after), str(error)[:500])
    return spark.createDataFrame([receipt], RECEIPT_SCHEMA), rows


def reset_receipt(source_id: str, at: datetime) -> DataFrame:
    """A receipt after which a source is pulled from its beginning."""
    return SparkSession.active().createDataFrame([(source_id, at, "reset", "ok", 0, None, None)], RECEIPT_SCHEMA)


def cursors(receipts: DataFrame) -> DataFrame:
    """(source_id, cursor_value): where each source's next pull begins, from the last receipt that went well; null after a reset."""
    last = receipts.where("status = 'ok'").groupBy("source_id").agg(F.max_by(F.struct("cursor_value"), "pulled_at").alias("c"))
    return last.select("source_id", "c.cursor_value")


def connector_stats(receipts: DataFrame) -> DataFrame:
    """(source_id, pulls, rows) over the pulls that went well."""
    return receipts.where("status = 'ok'").groupBy("source_id").agg(F.count("*").alias("pulls"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def registry_state(log: DataFrame) -> DataFrame:
    """(source_id, tier, from, to): tiers over time, from a log (source_id, tier, at); setting the same tier again changes nothing."""
    order = Window.partitionBy("source_id").orderBy("at")
    changed = log.withColumn("__was", F.lag("tier").over(order)).where("__was is null or __was <> tier")
    return changed.select("source_id", "tier", F.col("at").alias("t_from"), F.lead("at").over(order).alias("t_to"))


def multiple_official(state: DataFrame) -> DataFrame:
    """The active first-tier sources, where there are two or more: a warning."""
    active = state.where("t_to is null and tier = 'L1'")
    return active.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("source_id")).alias("sources")).where("n >= 2")


def dump_id(tier: Column, hashes: Column) -> Column:
    """A payload's identity: the tier and the sorted digests of its files."""
    return F.substring(F.sha2(F.concat_ws("|", tier, F.array_join(F.array_sort(hashes), "|")), 256), 1, 16)


def register_dump(files: DataFrame, known: DataFrame, tier: str) -> DataFrame:
    """(dump_id, n_files) of a payload that is not known yet. files: content, as the binaryFile source gives it."""
    found = files.agg(F.collect_list(F.sha2("content", 256)).alias("h"), F.count("*").alias("n_files"))
    return found.select(dump_id(F.lit(tier), F.col("h")).alias("dump_id"), "n_files").join(known, "dump_id", "left_anti")


#: Lines of a dump that meet in one task.
LINES = 1_000_000
# What follows a backslash in a dump, and what it stands for; any other character stands for itself.
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}


def unescaped(field: Column) -> Column:
    """A field of a text dump: \\N is null, and each backslash is read with the character after it, once."""
    held = F.replace(field, F.lit("\\\\"), F.lit("\0"))  # a dump can't hold NUL: it keeps the place of escaped backslashes
    for letter, stands_for in ESCAPES.items():
        held = F.replace(held, F.lit("\\" + letter), F.lit(stands_for))
    plain = F.replace(F.regexp_replace(held, r"\\(.)", "$1"), F.lit("\0"), F.lit("\\"))
    return F.when(field != r"\N", plain)


def copy_blocks(lines: DataFrame) -> DataFrame:
    """(table, columns, row, fields) of the COPY ... FROM stdin blocks of a text dump. lines: at, line of one file, in order.

    Lines meet in stretches of ``LINES``; what a stretch starts in is carried from the last head before it.
    """
    stretch = F.floor(F.col("at") / LINES)
    inside = Window.partitionBy("__stretch").orderBy("at")
    before = Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    head = F.regexp_extract("line", r"^COPY ([^ (]+) *\((.*)\) FROM stdin;", 1)
    opened = F.struct(head.alias("t"), F.regexp_extract("line", r"\((.*)\)", 1).alias("c"))
    closed = F.struct(F.lit("").alias("t"), F.lit("").alias("c"))
    marked = lines.withColumn("__stretch", stretch).withColumn("__head", F.when(F.col("line").rlike(r"^COPY .* FROM stdin;"), opened).when(F.col("line") == r"\.", closed))
    last = marked.groupBy("__stretch").agg(F.max_by("__head", F.when(F.col("__head").isNotNull(), F.col("at"))).alias("__last"))
    carried = last.select("__stretch", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    known = marked.withColumn("__own", F.last("__head", ignorenulls=True).over(inside)).join(carried, "__stretch").withColumn("__in", F.coalesce("__own", "__carried"))
    rows = known.where("__head is null and __in.t <> ''")
    return rows.select(F.regexp_replace("__in.t", r"^.*\.", "").alias("table"), F.split("__in.c", r",\s*").alias("columns"), F.col("at").alias("row"), F.transform(F.split("line", "\t"), unescaped).alias("fields"))


def block_table(blocks: DataFrame, table: str) -> DataFrame:
    """(row, values) of one table, values by column name."""
    return blocks.where(F.col("table") == table).select("row", F.map_from_arrays("columns", "fields").alias("values"))


def local_files(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """(path, content_hash, content) of the files below a folder whose content is not in ``seen`` (content_hash): the cursor of file sources.

    Of files with equal content the first by path counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("content_hash"), "content")
    fresh = files.select("path", "content_hash").join(seen.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("path").alias("path"))
    return files.join(fresh, ["path", "content_hash"], "left_semi")


def batched(rows: DataFrame, size: int) -> DataFrame:
    """Adds batch: numbers of at most ``size`` rows each, for writers that send so many at once. Rows stay in their partitions."""
    n = F.monotonically_increasing_id()
    part, place = F.shiftright(n, 33), n.bitwiseAND((1 << 33) - 1)
    return rows.withColumn("batch", F.shiftleft(part, 33) + F.floor(place / size))
