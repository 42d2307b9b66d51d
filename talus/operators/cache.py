"""Results kept by key in a table: what a run asks for is looked up within the run, then in the table, and only the rest is worked out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.sources.scratch import stash

C, L = F.col, F.lit


def looked_up(rows: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], exists: bool) -> DataFrame:
    """rows (id, key, ...) with what compute gives for their keys, and outcome: table, new, or run for a key that an earlier row of this run asked for.

    compute takes different keys (key, and the other columns of the row that asks first) and gives (key, ...), one row each; it is given those
    only that the table at path does not have, and its results are appended there. exists: whether an earlier run wrote the
    table. Keys are not null.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in ("id", "key")]
    first = rows.groupBy("key").agg(F.min(F.struct("id", *others)).alias("f")).select("key", C("f.id").alias("_first"), *[C(f"f.{c}").alias(c) for c in others])
    first = stash(first, "asked")
    known = spark.read.parquet(path).select("key") if exists else spark.createDataFrame([], first.select("key").schema)
    # written before anything is appended: what was there when the run began
    known = stash(first.select("key").join(known, "key", "left_semi").withColumn("_known", L(True)), "known")
    stash(compute(first.join(known, "key", "left_anti").drop("_first")), "computed").write.mode("append").parquet(path)
    got = spark.read.parquet(path)
    told = first.select("key", "_first").join(known, "key", "left")
    outcome = F.when(C("id") != C("_first"), "run").when(C("_known"), "table").otherwise("new")
    return rows.drop(*others).join(told, "key").join(got, "key").withColumn("outcome", outcome).drop("_first", "_known")
