"""Incremental pulls: a file source read as a stream, deduplicated, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.runtime import shared_folder


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def pull_available(spark: SparkSession, path: str, *, keys: list[str], target: str | None = None, watermark: tuple[str, str] | None = None) -> DataFrame:
    """All that a Parquet folder or file holds by now, each key once, appended to ``target`` with its progress beside it.

    A second pull into the same target reads new files alone. With ``watermark`` (column, delay) the state of
    the keys stays bounded.
    """
    target = target or fresh_folder(spark)
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).first()
    is_file = single is not None and single.path.rstrip("/").endswith(f"/{name}")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if is_file else spark.readStream.schema(schema).parquet(path)
    stream = stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})
    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    else:
        stream = stream.dropDuplicates(keys)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{target}/progress").option("path", f"{target}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/rows")


def daily_counts(stream: DataFrame, time: str, by: list[str], delay: str = "1 day") -> DataFrame:
    """(window, by, n) of a stream; days close once the watermark has passed them."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), *by).agg(F.count("*").alias("n"))
