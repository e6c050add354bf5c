"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words, for split().
SPACE = r"[\x20\x09-\x0D]+"

#: Ids that are broadcast: 32 MB at most.
BROADCAST_ROWS = 1 << 20
#: Whether shuffle files go as soon as the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all is one process, as in tests; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tiergraph-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many texts at most, so that long ones don't fill a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the process removes its own at exit."""
    root = f"{shared_dir(spark)}/tiergraph-{uuid.uuid4().hex}"
    if not _roots:
        atexit.register(_drop_all)
    _roots[root] = spark
    return f"{root}/{name}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and outlives lost executors.

    What the write has shuffled goes with it. Else shuffle files stay until the driver happens to collect its garbage, and those of a job's steps add up.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def if_small(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast where it has so few rows, so that the texts that meet it aren't shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def drop_scratch(df: DataFrame) -> None:
    """Removes a scratch table that nothing lazy still reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tiergraph-" in path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for root, spark in _roots.items():
        try:
            _delete(spark, root)
        except Exception:  # the JVM may be gone by now
            return


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
