"""A table with a key, kept in folders by the key's hash; a merge rewrites the folders that new rows fall in and no other."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import rank

C, L = F.col, F.lit


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    return jvm(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), L(buckets)).cast("int"))


def create(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Writes rows as a new table. Its buckets keep files of about the same size as long as their number fits the rows."""
    _bucketed(rows, keys, buckets).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merge(new: DataFrame, path: str, keys: list[str], buckets: int, latest: list[Column], admit: Column, values: dict[str, Column] | None = None) -> tuple[int, list[int]]:
    """Puts new rows in the place of those of a table with the same keys, and adds those that have none; (refused rows, buckets written).

    Of new rows with the same keys the last by the order latest counts; rows that admit doesn't hold for are refused before that.
    values: what a column becomes where a row has been there, of columns old.x and new.x; all others are taken from the new row.
    The new buckets are written whole beside the table first, so a failure up to then leaves every old row; each bucket then
    changes places with its old one by a rename. Other buckets keep their files.
    """
    spark = new.sparkSession
    told = new.withColumn("_ok", F.coalesce(admit, L(False)))
    refused = told.where(~C("_ok")).count()
    last = rank.keep_first(told.where("_ok").drop("_ok"), keys, *[c.desc() for c in latest])
    last = _bucketed(last, keys, buckets)
    hit = sorted(r["bucket"] for r in last.select("bucket").distinct().collect())  # buckets at most
    if not hit:
        return refused, []
    old = spark.read.parquet(path)
    columns = [c for c in old.columns if c != "bucket"]
    there = old.where(C("bucket").isin(hit))
    both = there.withColumn("_old", L(True)).alias("old").join(last.withColumn("_new", L(True)).alias("new"), [*keys, "bucket"], "full")
    given = lambda c: (values or {}).get(c, C(f"new.{c}") if c in last.columns else C(f"old.{c}"))
    value = lambda c: C(c) if c in keys else F.when(C("_new").isNull(), C(f"old.{c}")).when(C("_old").isNull(), C(f"new.{c}") if c in last.columns else L(None)).otherwise(given(c)).cast(old.schema[c].dataType)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    both.select(*[value(c).alias(c) for c in columns], "bucket").repartition(len(hit), "bucket").write.partitionBy("bucket").parquet(staged)
    fs, jvm = _fs(spark, path)
    for b in hit:
        at, away = f"{path}/bucket={b}", f"{staged}/old-{b}"
        if fs.exists(jvm(at)):
            fs.rename(jvm(at), jvm(away))
        fs.rename(jvm(f"{staged}/bucket={b}"), jvm(at))
    fs.delete(jvm(staged), True)
    return refused, hit


def files(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, file) of the files that a table has now."""
    return spark.read.parquet(path).select("bucket", F.col("_metadata.file_name").alias("file")).distinct()
