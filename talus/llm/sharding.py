"""Shards of nearly equal bytes by histogram sort: probe, count exactly, refine, then exchange once."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.store import fresh, stash

SHARDS = 24
#: Probes of the first round, evenly over all keys.
FIRST = 2048
#: Probes between a splitter's bounds in each round.
PROBES = 32
#: Ranges that each shard is exchanged in, at least, and rows that a range holds about, at most; slots are numbered within them.
RANGES, RANGE_ROWS = 8, 2_000_000

_SPAN = 1 << 64


def _bytes(keys: list[int]) -> np.ndarray:
    """Keys as 24-byte strings in the same order."""
    return np.array([min(max(k, 0), _SPAN**3 - 1).to_bytes(24, "big") for k in keys], "S24")


def _ranges(batch: pa.RecordBatch, cuts: np.ndarray) -> np.ndarray:
    """For each row of (h, d, r) the number of cuts at or below its key."""
    n = batch.num_rows
    cols = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("h", "d", "r")]
    signed = [x.view(np.uint64) ^ np.uint64(1 << 63) for x in cols[:2]] + [cols[2].view(np.uint64)]
    raw = np.stack(signed, 1).astype(">u8").tobytes() if n else b""  # bytes in the order of the numbers
    return np.searchsorted(cuts, np.frombuffer(raw, "S24"), "right")


def _counts(keys: DataFrame, probes: list[int]) -> np.ndarray:
    """The exact bytes below each probe."""
    cuts = _bytes(probes)

    def go(batches):
        held = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            held += np.bincount(_ranges(batch, cuts), np.asarray(batch.column("size").to_numpy(zero_copy_only=False), float), len(held)).astype(np.int64)
        some = np.flatnonzero(held)
        yield pa.record_batch({"range": some.astype(np.int32), "b": held[some]})

    held = np.zeros(len(cuts) + 1, np.int64)
    for r in keys.select("h", "d", "r", "size").mapInArrow(go, "range int, b long").groupBy("range").agg(F.sum("b").alias("b")).collect():
        held[r["range"]] = r["b"]
    return np.cumsum(held)[:-1]


def splitters(keys: DataFrame, total: int, pieces: int, tolerance: list[int]) -> list[int]:
    """Keys that cut keys (h, d, r, size) into pieces; the bytes below each are within its tolerance of its share, or as near as rows allow."""
    top = _SPAN**3
    bounds = [[0, 0, top, total] for _ in range(pieces - 1)]
    done: dict[int, int] = {}
    probes = [top // FIRST * k for k in range(1, FIRST)]
    while probes:
        at = _counts(keys, probes).tolist()
        for k in range(pieces - 1):
            if k in done:
                continue
            want = total * (k + 1) / pieces
            lo, below, hi, upto = bounds[k]
            j = bisect_right(at, want)
            if j and probes[j - 1] > lo:
                lo, below = probes[j - 1], at[j - 1]
            if j < len(probes) and probes[j] < hi:
                hi, upto = probes[j], at[j]
            bounds[k] = [lo, below, hi, upto]
            if min(want - below, upto - want) <= tolerance[k] or hi - lo <= 1:
                done[k] = lo if want - below <= upto - want else hi
        probes = set()
        for k, (lo, _, hi, _) in enumerate(bounds):
            if k not in done:
                probes.update(min(hi - 1, lo + max(1, (hi - lo) // (PROBES + 1)) * (i + 1)) for i in range(PROBES))
        probes = sorted(probes)
    return [done[k] for k in range(pieces - 1)]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0005, carry: list[str] | None = None) -> DataFrame:
    """docs with size, text_crc32, shard and slot: shards of nearly equal sums of size, in order of (text hash, doc_id).

    size is the UTF-8 bytes of text (null: none) plus 8; text_crc32 that of the bytes (null: of none). Equal texts are
    neighbours, so a group of copies is divided only where its bytes need more than one shard. Slots count from 0 without
    gaps. A splitter's error is at most tolerance times a shard's share or one row. Repeated rows each get their slot; a null
    doc_id sorts first; an empty table gives no rows. Columns of docs with the names of new ones give way to them. carry: the
    columns of docs to keep (all of them if not given); text only moves if it is among them.
    """
    # columns of these names go along under others
    kept = docs.drop("size", "text_crc32", "shard", "slot")
    other: dict[str, str] = {}
    for c in kept.columns:
        if c.lower() in ("h", "d", "r", "range"):
            other[c] = fresh(kept, f"_{c.lower()}")
            kept = kept.withColumnRenamed(c, other[c])
    docs = kept
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    new = {"size": (F.octet_length(raw) + 8).cast("long"), "text_crc32": F.crc32(raw)}
    keyed = docs.withColumns(new).withColumns({"h": F.xxhash64(raw), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "r": F.monotonically_increasing_id()})
    if carry is not None:
        keyed = keyed.select(*dict.fromkeys([*[other.get(c, c) for c in carry], "size", "text_crc32", "h", "d", "r"]))
    return _shard(keyed, shards, tolerance).drop("h", "d", "r", "range").withColumnsRenamed({v: k for k, v in other.items()})


def _shard(keyed: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """Numbers keyed rows (h, d, r, size, ...); the rows themselves move once, to the range that holds them."""
    keyed = stash(keyed, "keys")
    total, rows = keyed.agg(F.sum("size"), F.count("*")).first()
    ranges = max(RANGES, -(-rows // (shards * RANGE_ROWS)))
    if total is None:
        return keyed.withColumns({"range": F.lit(0), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    share = total / shards
    loose = [int(tolerance * share) if (k + 1) % ranges == 0 else int(share / ranges / 4) for k in range(shards * ranges - 1)]
    cuts = _bytes(sorted(splitters(keyed, total, shards * ranges, loose)))

    def deal(batches):
        for batch in batches:
            yield batch.append_column("range", pa.array(_ranges(batch, cuts), pa.int32()))

    dealt = keyed.mapInArrow(deal, T.StructType([*keyed.schema.fields, T.StructField("range", T.IntegerType())]))
    size = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    base, at = [], 0
    for k in range(shards * ranges):
        at = 0 if k % ranges == 0 else at
        base.append(at)
        at += size.get(k, 0)
    slot = F.row_number().over(Window.partitionBy("range").orderBy("h", "d", "r")) - 1
    first = F.element_at(F.array(*[F.lit(b) for b in base]), F.col("range") + 1)
    return dealt.withColumns({"slot": (slot + first).cast("long"), "shard": F.floor(F.col("range") / ranges).cast("int")})
