"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.store import parts, stash

#: Edges that one task writes, about.
EDGES = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's neighbours to the least of them; large: those above the vertex, else those below it.

    The edges of a vertex with very many meet one row, so a skew join may divide them.
    """
    if large:
        e = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = e.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges (a, b): component is the least vertex it reaches. Empty edges give no rows."""
    edges = stash(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rows, mark = edges.count(), None
    while True:
        step, files = _star(_star(edges, True), False), -(-rows // EDGES) or 1
        # few edges go to few files
        edges = stash(step.coalesce(files) if files < parts(step.sparkSession) else step, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        rows, mark = now[0], now
    low = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "v")
    return low.unionByName(low.select(F.col("component").alias("v"), "component").distinct())
