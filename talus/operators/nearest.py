"""Exact nearest vectors by cosine, with cells around pivots and the triangle inequality in place of all pairs.

Vectors of length one at cosine c lie sqrt(2 - 2c) apart, which is a metric. Each vector belongs to the cell of its nearest
pivot. A query first meets the cells next to it until they hold k rows, which bounds how far its k-th nearest can be; after
that only cells that reach into that distance, and of them only rows whose distance to the pivot differs from the query's by
no more than it. Cells are cut into blocks, so a large one is no single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.operators import rank
from talus.sources.scratch import stash

C, L = F.col, F.lit
#: Pivots, the vectors with the least hashes; rows of a cell, and queries, that one task compares.
PIVOTS, ROWS = 64, 4096
#: Cosines are compared to this precision when distances decide what is left out; one digit beyond what results are rounded to.
SLACK = 2e-5


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _units(vectors: DataFrame) -> DataFrame:
    """vectors (id, v) with v of length one; null vectors and those without a length are left out."""
    d = vectors.where("v is not null").withColumn("v", C("v").cast("array<double>"))
    d = d.withColumn("_l", F.sqrt(F.aggregate("v", L(0.0), lambda s, x: s + x * x))).where("_l > 0")
    return d.select("id", F.transform("v", lambda x: x / C("_l")).alias("v"))


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * one @ two.T))


def _celled(pivots: np.ndarray):
    def go(batches):
        for batch in batches:
            if batch.num_rows:
                d = _apart(_matrix(batch.column("v")), pivots)
                cell = d.argmin(1)
                yield pa.record_batch({"id": batch.column("id"), "v": batch.column("v"), "cell": cell.astype(np.int32), "r": d[np.arange(len(d)), cell]})

    return go


def _distances(pivots: np.ndarray):
    def go(batches):
        for batch in batches:
            if batch.num_rows:
                d = _apart(_matrix(batch.column("v")), pivots)
                n, p = d.shape
                yield pa.record_batch({"query_id": batch.column("id").take(pa.array(np.repeat(np.arange(n), p))), "cell": np.tile(np.arange(p, dtype=np.int32), n), "to": d.ravel()})

    return go


def _compared(k: int):
    """Of one block of a cell and one of queries: each query's k nearest by rounded cosine, and how many pairs were compared."""

    def go(key, table: pa.Table, asked: pa.Table) -> pa.Table:
        ids, x, r = np.asarray(table.column("id").to_numpy()), _matrix(table.column("v")), np.asarray(table.column("r").to_numpy())
        q, a, to, reach = np.asarray(asked.column("query_id").to_numpy()), _matrix(asked.column("a")), np.asarray(asked.column("to").to_numpy()), np.asarray(asked.column("reach").to_numpy())
        out = []
        for i in range(len(q)) if len(ids) else []:
            near = np.flatnonzero((np.abs(r - to[i]) <= reach[i]) & (ids != q[i]))
            cosine = np.round(x[near] @ a[i], 5)
            best = np.lexsort((ids[near], -cosine))[:k]
            out.append((np.full(len(best), q[i]), ids[near][best], cosine[best], np.full(len(best), len(near)) * (np.arange(len(best)) == 0)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros(0, np.int64)]
        return pa.table({"query_id": cols[0].astype(np.int64), "id": cols[1].astype(np.int64), "cosine": cols[2].astype(np.float64), "compared": cols[3].astype(np.int64)})

    return go


def _meet(rows: DataFrame, asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """asked: query_id, a, cell, to, reach. Every block of a cell meets every block of the queries that reach it, which are copied to them."""
    few = F.ceil(C("n") / ROWS).cast("int")
    count = asked.groupBy("cell").agg(F.count("*").alias("nq"))
    blocks = cells.select("cell", few.alias("m")).join(count, "cell").select("cell", "m", F.ceil(C("nq") / ROWS).cast("int").alias("mq"))
    x = rows.join(F.broadcast(blocks), "cell").withColumn("i", F.pmod(F.xxhash64("id"), C("m")).cast("int")).withColumn("j", F.explode(F.sequence(L(0), C("mq") - 1)))
    q = asked.join(F.broadcast(blocks), "cell").withColumn("j", F.pmod(F.xxhash64("query_id"), C("mq")).cast("int")).withColumn("i", F.explode(F.sequence(L(0), C("m") - 1)))
    pair = x.select("cell", "i", "j", "id", "v", "r").groupBy("cell", "i", "j").cogroup(q.select("cell", "i", "j", "query_id", "a", "to", "reach").groupBy("cell", "i", "j"))
    return pair.applyInArrow(_compared(k), "query_id long, id long, cosine double, compared long")


def search(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """query_id, id, cosine (five places), compared of all the rows that are among the k nearest of one of the blocks that a query meets.

    vectors and queries: (id long, v), all of one length; a row is no result of a query with its own id. compared counts the
    pairs behind a row once. The pivots, some of the vectors, are all that the driver and every task hold.
    """
    rows = _units(vectors)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if not some:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, cosine double, compared long")
    p = np.array([r["v"] for r in some])
    rows = stash(rows.mapInArrow(_celled(p), "id long, v array<double>, cell int, r double"), "cells")
    cells = stash(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius")), "radii")  # a row for each pivot at most
    asked = _units(queries)
    to = asked.mapInArrow(_distances(p), "query_id long, cell int, to double").join(F.broadcast(cells), "cell")
    # the cells next to a query until they hold k rows besides itself
    near = Window.partitionBy("query_id").orderBy("to", "cell").rowsBetween(Window.unboundedPreceding, -1)
    to = stash(to.withColumn("before", F.coalesce(F.sum("n").over(near), L(0))).drop("n"), "distances")
    a = asked.select(C("id").alias("query_id"), C("v").alias("a"))
    first = stash(_meet(rows, to.where(C("before") <= k).join(a, "query_id").withColumn("reach", L(3.0)), cells, k), "nearest")
    kth = rank.top_k_by(first, ["query_id"], k, C("cosine").desc(), C("id")).where(C("rank") == k)
    bound = kth.select("query_id", F.sqrt(F.greatest(L(0.0), 2 - 2 * (C("cosine") - SLACK))).alias("reach"))
    rest = to.where(C("before") > k).join(bound, "query_id", "left").withColumn("reach", F.coalesce("reach", L(3.0)))
    rest = rest.where(C("to") - C("radius") <= C("reach")).join(a, "query_id")
    return first.unionByName(_meet(rows, rest, cells, k))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """query_id, id, cosine, rank: the k vectors with the largest cosines, rounded to five places, of equal ones those with the least ids."""
    return rank.top_k_by(search(vectors, queries, k, pivots).drop("compared"), ["query_id"], k, C("cosine").desc(), C("id"))


def _lengths(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column by their length: places, and a matrix of vectors of length one; those that are null, empty or zero are in none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(n[n > 0]):
        at = np.flatnonzero(n == size)
        m = _matrix(column.take(pa.array(at)))
        norm = np.sqrt((m * m).sum(1))
        out[int(size)] = at[norm > 0], m[norm > 0] / norm[norm > 0, None]
    return out


def _all_compared(k: int):
    """Of one block of rows and one of queries: each query's k rows with the largest rounded cosines, of equal ones those with the least ids."""

    def go(table: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = np.asarray(table.column("id").to_numpy()), np.asarray(asked.column("query_id").to_numpy())
        mine, theirs = _lengths(asked.column("a")), _lengths(table.column("v"))
        out = []
        for start in range(0, len(names) if len(ids) else 0, 256):
            part = names[start : start + 256]
            cosine = np.zeros((len(part), len(ids)))
            for size in mine.keys() & theirs.keys():
                (q_at, q), (at, x) = mine[size], theirs[size]
                here = (q_at >= start) & (q_at < start + 256)
                cosine[np.ix_(q_at[here] - start, at)] = np.round(q[here] @ x.T, 5)
            for i, name in enumerate(part):
                row = np.where(ids == name, -2.0, cosine[i])
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -1.5
                near = np.flatnonzero((row >= least) & (row > -1.5))
                best = near[np.lexsort((ids[near], -row[near]))[:k]]
                out.append((np.full(len(best), name), ids[best], row[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0].astype(np.int64), "id": cols[1].astype(np.int64), "cosine": cols[2].astype(np.float64)})

    return go


def of_all(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, cosine, rank as top_k, from all pairs: blocks of rows meet blocks of queries by products of matrices, and a pair of blocks gives k rows a query.

    A vector that is null, empty, zero, not finite or of another length than the query has cosine 0.
    """
    parts = lambda df: max(1, -(-df.count() // ROWS))
    m, mq = parts(vectors), parts(queries)
    deal = lambda c, n: F.pmod(F.xxhash64(c), L(n)).cast("int")
    x = vectors.select("id", C("v").cast("array<double>").alias("v"), deal("id", m).alias("i"), F.explode(F.sequence(L(0), L(mq - 1))).alias("j"))
    q = queries.select(C("id").alias("query_id"), C("v").cast("array<double>").alias("a"), deal("id", mq).alias("j"), F.explode(F.sequence(L(0), L(m - 1))).alias("i"))
    met = x.groupBy("i", "j").cogroup(q.groupBy("i", "j")).applyInArrow(_all_compared(k), "query_id long, id long, cosine double")
    return rank.top_k_by(met, ["query_id"], k, C("cosine").desc(), C("id"))


def share_compared(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> float:
    """The share of all pairs that top_k compares."""
    n = vectors.count() * queries.count()
    return (search(vectors, queries, k, pivots).agg(F.sum("compared")).first()[0] or 0) / n if n else 0.0
