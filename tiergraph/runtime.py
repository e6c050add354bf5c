"""Session helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all is one process, as in tests; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tiergraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which goes when the process ends."""
    path = f"{shared_folder(spark)}/tiergraph-{uuid.uuid4().hex}/{name}"

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            return

    atexit.register(drop)
    return path


def write_lean(df: DataFrame, path: str) -> None:
    """Writes df over what is there; what the write has shuffled goes with it, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def in_blocks(small: DataFrame, rows: int) -> list[DataFrame]:
    """A stated set, of any size, in blocks of about so many rows that are dealt by their hash: each can be broadcast. One block at least."""
    n = max(1, -(-small.count() // rows))
    return [small.where(F.pmod(F.xxhash64(*small.columns), F.lit(n)) == i) for i in range(n)] if n > 1 else [small]
