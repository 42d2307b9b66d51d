"""Whitening of embeddings by a tiled covariance.

Method. Entries become integers, so all sums are exact. Columns are cut into blocks and rows into row blocks; a pair of column
blocks is a tile. Each column block of a row block is sent to every tile it takes part in, tile pairs are multiplied there,
and the products are summed entry by entry. What comes to the driver is one number for each pair of dimensions, however many
rows there are; it assembles the covariance and decomposes it.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.store import fresh, stash

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on count as not finite: beyond it doubles have no fractions left and sums would not fit.
MOST = 2.0**40
#: Dimensions in a column block at least; there are at most BLOCKS of them, so a column goes to BLOCKS tiles at most.
TILE, BLOCKS = 32, 8
#: Rows of a row block, and row blocks that are multiplied together.
ROWS, TOGETHER = 4096, 16
#: Components returned, and the share of the largest variance below which a component counts as without variance.
TOP, LEAST = 8, 1e-12


def _matrix(column) -> np.ndarray:
    """The rows of an array column of equal lengths as doubles; null entries are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _integers(column) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have finite entries only, the integers of those)."""
    m = _matrix(column)
    ok = (np.abs(m) < MOST).all(1) if m.size else np.zeros(len(column), bool)  # NaN compares false
    return ok, np.floor(SCALE * m[ok]).astype(np.int64) + SHIFT


def _split(dim: int) -> np.ndarray:
    width = max(TILE, -(-dim // BLOCKS))
    return np.append(np.arange(0, dim, width), dim)


def _sums(batches):
    """Rows and exact sums of each dimension of each batch."""
    for batch in batches:
        _, x = _integers(batch.column("v"))
        if len(x):
            # a batch has at most 2**20 rows, so small entries add up in longs
            total = (x if np.abs(x).max() < 2**42 else x.astype(object)).sum(0)
            yield pa.record_batch({"dim": np.arange(x.shape[1], dtype=np.int32), "n": np.full(x.shape[1], len(x), np.int64), "s": pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))})


def _column_blocks(centre: np.ndarray):
    """Column blocks of row blocks, once for each tile that they take part in."""
    cut = _split(len(centre))
    blocks = len(cut) - 1

    def go(batches):
        k = 0
        for batch in batches:
            _, x = _integers(batch.column("v"))
            for lo in range(0, len(x), ROWS):
                z = x[lo : lo + ROWS] - centre
                body = [np.ascontiguousarray(z[:, cut[i] : cut[i + 1]]).tobytes() for i in range(blocks)]
                tiles = [(min(i, j), max(i, j), i) for i in range(blocks) for j in range(blocks)]
                yield pa.record_batch({
                    "i": pa.array([t[0] for t in tiles], pa.int32()), "j": pa.array([t[1] for t in tiles], pa.int32()), "of": pa.array([t[2] for t in tiles], pa.int32()),
                    "place": pa.array([k] * len(tiles), pa.int32()), "block": pa.array([body[t[2]] for t in tiles], pa.binary()),
                })
                k += 1

    return go


def product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The exact product of one transposed and two: in doubles where all sums fit, else in integers of any size."""
    bound = float(np.abs(one).max(initial=0)) * float(np.abs(two).max(initial=0)) * max(1, len(one))
    if bound < 2.0**53:
        return (one.T.astype(np.float64) @ two.astype(np.float64)).astype(np.int64)
    return one.T @ two if bound < 2.0**62 else one.T.astype(object) @ two.astype(object)


def _products(cut: np.ndarray):
    """The entries of one tile, summed over the row blocks of one group."""

    def go(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        wi, wj = cut[i + 1] - cut[i], cut[j + 1] - cut[j]
        held: dict[int, dict[int, np.ndarray]] = {}
        for place, of, block in zip(table.column("row").to_pylist(), table.column("of").to_pylist(), table.column("block"), strict=True):
            held.setdefault(place, {})[of] = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, wi if of == i else wj)
        total = sum(product(b[i], b[j]).astype(object) for b in held.values())
        p, q = np.divmod(np.arange(wi * wj), wj)
        return pa.table({"p": (p + cut[i]).astype(np.int32), "q": (q + cut[j]).astype(np.int32), "s": pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))})

    return go


def _clean(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """vectors with v, their usable vectors as arrays of doubles without nulls, and their length: the most frequent one, the longest of ties."""
    v = fresh(vectors, "v")
    out = vectors.withColumn(v, F.col(column).cast("array<double>"))
    out = out.where(f"{v} is not null and size({v}) > 0 and not exists({v}, x -> x is null or isnan(x) or abs(x) >= {MOST}D)")
    sizes = out.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (out.where(F.size(v) == sizes["d"]), sizes["d"]) if sizes else (out.where("false"), 0)


def fit(kept: DataFrame, dim: int) -> dict:
    """n, sums (exact integers), values and vectors (the eigenpairs of the covariance of the integers, largest first) of vectors (v) of length dim.

    The covariance's divisor is n. Entries are centred by the integer next to the mean before they are multiplied, and what the
    mean is off by is taken off in exact integers. Only sums of dimensions and of pairs of them reach the driver.
    """
    if not dim:
        return {"n": 0, "sums": [], "values": np.zeros(0), "vectors": np.zeros((0, 0)), "trace": 0.0}
    got = kept.mapInArrow(_sums, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    n, sums = got[0]["n"], [0] * dim
    for r in got:
        sums[r["dim"]] = int(r["s"])
    centre = [(2 * s + n) // (2 * n) for s in sums]
    # the number of row blocks follows the rows; each group of them is multiplied on its own, and Spark adds up the entries
    sent = kept.mapInArrow(_column_blocks(np.array(centre, np.int64)), "i int, j int, of int, place int, block binary")
    sent = sent.withColumn("task", F.spark_partition_id()).withColumn("part", F.floor(F.col("place") / TOGETHER))
    sent = sent.withColumn("row", F.col("place")).drop("place")
    cut = _split(dim)
    entries = sent.groupBy("i", "j", "task", "part").applyInArrow(_products(cut), "p int, q int, s decimal(38,0)")
    zz = np.zeros((dim, dim), object)
    for r in entries.groupBy("p", "q").agg(F.sum("s").alias("s")).collect():
        zz[r["p"], r["q"]] = zz[r["q"], r["p"]] = int(r["s"])
    off = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)
    cov = ((n * zz - np.outer(off, off)).astype(object) / (n * n)).astype(np.float64)
    values, vecs = np.linalg.eigh(cov)
    return {"n": n, "sums": sums, "values": values[::-1].copy(), "vectors": vecs[:, ::-1].copy(), "trace": float(np.trace(cov))}


def _projected(n: int, sums: list[int], directions: np.ndarray, scale: np.ndarray):
    """(integers of the rows, whitened values of each): integers are centred exactly before they become doubles."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([float(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    basis = directions / scale

    def of(column):
        _, x = _integers(column)
        return x, ((x - centre).astype(np.float64) - rest) @ basis

    return of


def _second_moments(of, k: int):
    def go(batches):
        for batch in batches:
            _, w = of(batch.column("v"))
            if len(w):
                p, q = np.divmod(np.arange(k * k), k)
                yield pa.record_batch({"p": p.astype(np.int32), "q": q.astype(np.int32), "s": (w.T @ w).ravel(), "m": np.repeat(w.sum(0), k)})

    return go


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """The exact sums of (n * x - S)**2 of each row; None where one exceeds a long."""
    bound = max((abs(s) for s in sums), default=0) + n * int(np.abs(x).max(initial=0))
    if bound < 2**62:
        y = n * x - np.array(sums, np.int64)
        if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (y * y).sum(1)
    y = n * x.astype(object) - np.array(sums, object)
    return np.array([t if t < 2**63 else None for t in (y * y).sum(1)], object)


def whiten(vectors: DataFrame, column: str = "embedding", top: int = TOP) -> DataFrame:
    """The usable rows of vectors, each once for each component, with component, n, deviation, whitened, explained, identity_error.

    column holds arrays of numbers. Rows go whose vector is null or empty, holds a null, NaN, infinite entry or one of 2**40 or
    more, or is not of the most frequent length (of ties the longest). The others are fitted on, repeated rows as often as they
    occur. Components are at most top unit eigenvectors of the covariance, by falling variance; those without variance are left
    out, so a table of equal vectors, one of a single row and an empty one give no rows. Signs are free, but the same in all rows; ties between
    equal variances are resolved in any way. deviation is exact, and null where it exceeds a long. Other columns of vectors stay,
    but for those with the names of new ones.
    """
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    vectors = vectors.drop(*[c for c in vectors.columns if c.lower() in new and c != column])
    kept, dim = _clean(vectors, column)
    v = kept.columns[-1]
    kept = kept.drop(column)
    model = fit(kept.select(F.col(v).alias("v")), dim)
    n, values = model["n"], model["values"][:top]
    k = int((values > LEAST * max(values, default=0)).sum()) if n else 0
    fields = [f for f in kept.schema.fields if f.name != v]
    out = T.StructType([*fields, *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if not k:
        return kept.sparkSession.createDataFrame([], out)
    of = _projected(n, model["sums"], model["vectors"][:, :k], np.sqrt(values[:k]))
    moments, mean = np.zeros((k, k)), np.zeros(k)
    for r in kept.select(F.col(v).alias("v")).mapInArrow(_second_moments(of, k), "p int, q int, s double, m double").groupBy("p", "q").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).collect():
        moments[r["p"], r["q"]], mean[r["p"]] = r["s"] / n, r["m"] / n
    error = float(np.abs(moments - np.outer(mean, mean) - np.eye(k)).max())
    explained, sums = values[:k] / model["trace"], model["sums"]

    def go(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                x, w = of(rows.column(v))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                cols = {c: rows.column(c).take(each) for c in rows.schema.names if c != v}
                cols |= {
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": pa.array(np.full(len(x) * k, n), pa.int64()),
                    "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(each), "whitened": w.ravel(), "explained": np.tile(explained, len(x)), "identity_error": np.full(len(x) * k, error),
                }
                yield pa.record_batch(cols)

    return kept.mapInArrow(go, out)
