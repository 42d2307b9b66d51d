"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset and all runs in one process, a folder of this session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.talus.scratch", None)
        if not path:
            master = spark.conf.get("spark.master", "")
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="talus-")
            spark.conf.set("spark.talus.scratch", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here and a lost executor loses nothing.

    The table stays as long as the shared folder does, since the frame returned is lazy. Rows go to Python workers in batches of
    at most BATCH_ROWS while it is written, which bounds what executor and worker hold of long texts at once.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, str(before))
    return spark.read.schema(df.schema).parquet(path)
