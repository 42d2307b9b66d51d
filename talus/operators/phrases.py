"""All keys of a lexicon in each of many texts, in one pass over the texts however many keys there are.

The keys make an automaton with a state for each of their prefixes. A text is cut into pieces that overlap by the longest key
less one, so all pieces step through the automaton side by side, and a key is found in the piece that it ends in.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.sources.scratch import stash

C, L = F.col, F.lit
#: Bytes of keys in one automaton; a larger lexicon takes a pass for each so many, one after the other.
KEYS = 4 << 20
#: Bytes of text that step at once, and fresh bytes in a piece.
TEXT, PIECE = 1 << 21, 256


@lru_cache(maxsize=2)
def automaton(keys: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of a byte, next state by state and class, the key that ends in a state or -1, the longest shorter state in which one ends or 0)."""
    kind = np.zeros(256, np.int64)
    used = np.unique(np.frombuffer(b"".join(keys), np.uint8))
    kind[used] = np.arange(1, len(used) + 1)
    children: list[dict[int, int]] = [{}]
    depth, ends = [0], [-1]
    for i, key in enumerate(keys):
        at = 0
        for b in key:
            c = int(kind[b])
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                depth.append(depth[at] + 1)
                ends.append(-1)
            at = children[at][c]
        if ends[at] < 0 and key:
            ends[at] = i
    ends, depth = np.array(ends), np.array(depth)
    step, back, link = np.zeros((len(ends), len(used) + 1), np.int32), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    # what a state does with a byte that none of its keys has, its longest proper suffix among the states does
    for at in np.argsort(depth, kind="stable").tolist():
        step[at] = step[back[at]]
        for c, child in children[at].items():
            back[child] = step[back[at], c] if at else 0
            step[at, c] = child
        link[at] = back[at] if ends[back[at]] >= 0 else link[back[at]]
    return kind, step, ends, link


def found_in(keys: tuple[bytes, ...], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, keys) by number: each key that a text holds, once, in order."""
    kind, step, ends, link = automaton(keys)
    over = max(map(len, keys), default=1) - 1
    state_of, text_of, row = [], [], PIECE + over
    pad = [(i, lo) for i, t in enumerate(texts) for lo in range(0, len(t), PIECE)]
    for start in range(0, len(pad), max(1, TEXT // row)):
        some = pad[start : start + max(1, TEXT // row)]
        data = b"".join(texts[i][max(0, lo - over) : lo + PIECE].ljust(row, b"\0") for i, lo in some)
        size = np.array([min(lo + PIECE, len(texts[i])) - max(0, lo - over) for i, lo in some])
        columns = np.ascontiguousarray(kind[np.frombuffer(data, np.uint8)].reshape(-1, row).T)
        state, which = np.zeros(len(some), np.int64), np.array([i for i, _ in some])
        hit = (ends >= 0) | (link > 0)
        for k, c in enumerate(columns):
            state = step[state, c]
            here = np.flatnonzero(hit[state] & (k < size))
            if len(here):
                state_of.append(state[here])
                text_of.append(which[here])
    if not state_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    met = np.unique(np.stack([np.concatenate(text_of), np.concatenate(state_of).astype(np.int64)], 1), axis=0)
    out = []
    while len(met):  # a state in which a key ends, and the shorter ones in which others do
        own = met[ends[met[:, 1]] >= 0]
        out.append(np.stack([own[:, 0], ends[own[:, 1]]], 1))
        met = np.stack([met[:, 0], link[met[:, 1]]], 1)
        met = np.unique(met[met[:, 1] > 0], axis=0)
    both = np.unique(np.concatenate(out), axis=0)
    return both[:, 0], both[:, 1]


def _searched(keys: tuple[bytes, ...], ordinals: list[int], column: str):
    def go(batches):
        place = np.array(ordinals, np.int64)
        for batch in batches:
            texts = [t.encode() if t is not None else b"" for t in batch.column(column).to_pylist()]
            i, k = found_in(keys, texts)
            at = np.searchsorted(i, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(place[k], pa.int64()))
            yield pa.record_batch([*[batch.column(c) for c in batch.schema.names if c != column], lists], names=[*[c for c in batch.schema.names if c != column], "found"])

    return go


def held_keys(rows: DataFrame, column: Column, lexicon: DataFrame) -> DataFrame:
    """(id, ordinal) for each key of lexicon (ordinal, key) that the text column of rows (id, ...) contains, once for each pair.

    Ids do not repeat. Null texts hold nothing, and null and empty keys are in none; of keys that repeat each ordinal is found.
    Keys come to the driver and workers KEYS bytes at a time, whatever the lexicon's size; so many take one pass over the texts.
    """
    spark = rows.sparkSession
    keyed = lexicon.where("key is not null and key <> ''").groupBy("key").agg(F.min("ordinal").alias("ordinal"))
    keyed = stash(keyed, "lexicon")
    total = keyed.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    blocks = -(-total // KEYS) or 1
    texts = rows.select("id", column.alias("t"))
    id_ = texts.schema["id"]
    out = None
    for b in range(blocks):
        part = keyed.where(F.pmod(F.xxhash64("key"), L(blocks)) == b).orderBy("key").collect()
        if not part:
            continue
        keys, places = tuple(r["key"].encode() for r in part), [r["ordinal"] for r in part]
        schema = T.StructType([id_, T.StructField("found", T.ArrayType(T.LongType()))])
        some = texts.mapInArrow(_searched(keys, places, "t"), schema).select("id", F.explode("found").alias("ordinal"))
        some = stash(some, "held") if blocks > 1 else some  # then the driver need hold one block only
        out = some if out is None else out.unionByName(some)
    if out is None:
        return spark.createDataFrame([], T.StructType([id_, T.StructField("ordinal", T.LongType())]))
    same = lexicon.select("key", C("ordinal").alias("every")).join(keyed, "key").where("every <> ordinal").select("ordinal", "every")
    return out.unionByName(out.join(same, "ordinal").select("id", C("every").alias("ordinal")))


def longest_key(rows: DataFrame, column: Column, lexicon: DataFrame) -> DataFrame:
    """(id, ordinal) of the longest key that a text holds, of equally long ones the first; texts without a key have no row."""
    met = held_keys(rows, column, lexicon).join(lexicon.select("ordinal", F.length("key").alias("n")), "ordinal")
    best = met.groupBy("id").agg(F.max(F.struct("n", (-C("ordinal")).alias("at"))).alias("b"))
    return best.select("id", (-C("b.at")).alias("ordinal"))


def either_holds(rows: DataFrame, column: Column, lexicon: DataFrame) -> DataFrame:
    """(id, ordinal) where a text holds a key or a key holds the text, each pair once; empty texts and keys meet nothing."""
    one = held_keys(rows, column, lexicon)
    texts = rows.select(C("id").alias("ordinal"), column.alias("key"))
    two = held_keys(lexicon.select(C("ordinal").alias("id"), "key"), C("key"), texts).select(C("ordinal").alias("id"), C("id").alias("ordinal"))
    return one.unionByName(two).distinct()
