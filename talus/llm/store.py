"""Intermediate tables in the folder that driver and executors share, and numbers that tell rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources.scratch import shared_dir, stash  # noqa: F401  (the operators take them from here)

#: What a null doc_id counts as in order: the least number.
NO_ID = -(2**63)


def parts(spark: SparkSession) -> int:
    """How many partitions the cluster is set to deal a shuffle over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(docs: DataFrame, each: int) -> int:
    """How many buckets hold what comes of docs' texts (text) with about so many bytes of text each; at least one a partition."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-total // each))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, to: str) -> tuple[DataFrame, bool]:
    """docs with to, a number of each row's own in order of doc_id (null first, then by hash of text), and whether that is the doc_id.

    Where no doc_id repeats it is, and null is NO_ID. Where one does, all rows are written once and sorted by
    (doc_id, hash of text); they and not their ids are numbered, so rows that share an id stay apart, equal rows too.
    """
    docs = docs.withColumn(to, F.coalesce(F.expr("try_cast(doc_id as bigint)"), F.lit(NO_ID).cast("long")))
    if docs.groupBy(to).count().where("count > 1").isEmpty():
        return docs, True
    at, h, n = (fresh(docs, c) for c in ("_at", "_h", "_n"))
    rows = stash(docs.withColumn(at, F.monotonically_increasing_id()), "rows")
    order = rows.select(to, F.xxhash64(F.col("text").cast("string")).alias(h), at).orderBy(to, h, at)
    order = stash(order.select(at, F.monotonically_increasing_id().alias(n)), "order")
    return rows.join(order, at).withColumn(to, F.col(n)).select(*docs.columns), False
