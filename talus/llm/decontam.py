"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window passes when its set of five-word shingles and the item's have a weighted Jaccard of LEAST or more. Such a window
holds a shingle of the item, and its document holds shingles of at least LEAST of the item's weight: so every window of the
item's size around a shared shingle is fingerprinted, at every shift, and no others. Fingerprints of windows and items are
compared by four 16-bit blocks: at most RADIUS differing bits leave some block with at most RADIUS // 4, and all values that
near to a window's block are looked up, so no pair within the radius is missed.

A shingle of an item weighs log(1 + items / items that have it), counted over all items; one that the item lacks weighs as
much as one that a single item has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import words as W
from talus.llm import worker
from talus.llm.store import fresh, numbered, stash

U64 = np.uint64
WIDTH = 5
LEAST = 0.75
RADIUS = 20
#: Text bytes of the items that are held in each task at once; larger benchmarks are taken block by block.
BLOCK_BYTES = 4 << 20
#: Words whose windows are fingerprinted at once.
RUN = 1 << 14


def fingerprints(word_hashes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit SimHash over the words of each window."""
    bits = np.unpackbits(word_hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    total = np.zeros((len(word_hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    on = (total[start + n] - total[start]) > 0
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """A block of benchmark items: shingles with weights, and fingerprints indexed by four blocks of bits.

    total: the number of items of all blocks. shared: how many of these have each of some shingles, if more than one.
    """

    def __init__(self, ids: list, texts: list, total: int | None = None, shared: dict[int, int] | None = None):
        data, at = W.text_buffers(pa.array(texts, pa.string()))
        self.words, self.bounds = W.word_hashes(data, at)
        shingles, cut = W.shingle_hashes(self.words, self.bounds, WIDTH)
        self.ids, self.n = ids, np.diff(self.bounds)
        self.sets = [np.unique(shingles[cut[i] : cut[i + 1]]) for i in range(len(ids))]
        keys = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], np.repeat(np.arange(len(ids)), [len(s) for s in self.sets])[order]
        self.known, count = np.unique(keys, return_counts=True)
        if shared is not None:
            count = np.array([shared.get(int(s), 1) for s in self.known.view(np.int64)], np.int64)
        total = len(ids) if total is None else total
        self.weight = np.log1p(total / np.maximum(count, 1))
        self.rest = float(np.log1p(total))
        self.weights = [self.weight[np.searchsorted(self.known, s)] for s in self.sets]
        self.whole = np.array([w.sum() for w in self.weights])
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True
        self.short = sorted({int(x) for x in self.n if 0 < x < WIDTH})
        self.prints = fingerprints(self.words, self.bounds[:-1], self.n) if len(self.words) else np.zeros(len(ids), np.uint64)
        halves = self.prints.astype("<u8").view("<u2").reshape(-1, 4)
        self.index = []  # for each block of bits: its values, and the items that have each
        for b in range(4):
            order = np.argsort(halves[:, b], kind="stable")
            values, first = np.unique(halves[order, b], return_index=True)
            self.index.append((values, np.split(order, first[1:])))
        self.found: list[dict[int, np.ndarray]] = [{}, {}, {}, {}]

    def _near_block(self, b: int, value: int) -> np.ndarray:
        """The items whose block b differs from value in at most RADIUS // 4 bits; each value is looked up once."""
        got = self.found[b].get(value)
        if got is None:
            values, items = self.index[b]
            some = np.flatnonzero(np.bitwise_count(values ^ np.uint16(value)) <= RADIUS // 4)
            got = self.found[b][value] = np.concatenate([np.zeros(0, np.int64), *[items[k] for k in some]])
        return got

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs of fingerprints within RADIUS."""
        halves = prints.astype("<u8").view("<u2").reshape(-1, 4)
        window, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in range(4):
            for x, value in enumerate(halves[:, b].tolist()):
                got = self._near_block(b, value)
                window.append(np.full(len(got), x))
                item.append(got)
        window, item = np.concatenate(window), np.concatenate(item)
        on = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        pairs = np.unique(np.stack([window[on], item[on]], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def likeness(self, s: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a set of shingles, in order, with an item's."""
        own = s[np.minimum(np.searchsorted(s, self.sets[item]), len(s) - 1)] == self.sets[item]
        return float(self.weights[item][own].sum() / (self.whole[item] + self.rest * (len(s) - own.sum())))

    def candidates(self, shingles: np.ndarray, cut: np.ndarray):
        """(document, {item: (places, weights) of the item's shingles in it}) for documents that hold LEAST of an item's weight or more.

        shingles: of several documents, each from its cut on.
        """
        hit = np.flatnonzero(self.bloom[(shingles & U64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, shingles[hit]), max(0, len(self.known) - 1))
        on = self.known[at] == shingles[hit] if len(self.known) else np.zeros(0, bool)
        hit, at = hit[on], at[on]
        lo, hi = np.searchsorted(self.keys, shingles[hit], "left"), np.searchsorted(self.keys, shingles[hit], "right")
        n = hi - lo
        item = self.owner[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
        place, shingle = np.repeat(hit, n), np.repeat(at, n)
        doc = np.searchsorted(cut, place, "right") - 1
        order = np.lexsort((place, shingle, item, doc))
        doc, item, place, shingle = doc[order], item[order], place[order], shingle[order]
        if not len(doc):
            return
        group = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        first = np.ones(len(doc), bool)
        first[1:] = shingle[1:] != shingle[:-1]
        first[group] = True
        held = np.add.reduceat(self.weight[shingle] * first, group)
        end, out, of = np.append(group[1:], len(doc)), {}, -1
        for k in np.flatnonzero(held >= (LEAST - 1e-9) * self.whole[item[group]]):
            a, b = group[k], end[k]
            if doc[a] != of:
                if out:
                    yield of, out
                out, of = {}, int(doc[a])
            own = np.argsort(place[a:b])
            out[int(item[a])] = (place[a:b][own] - cut[of], self.weight[shingle[a:b]][own])
        if out:
            yield of, out

    def windows(self, words: int, held: dict) -> np.ndarray:
        """(start, end) of the windows of a document that hold a shingle of an item of their size, without repeats and in order."""
        out = [np.zeros((0, 2), np.int64)]
        for k, (place, _) in held.items():
            size, last = int(self.n[k]), max(0, words - int(self.n[k]))
            edge = np.zeros(last + 2, np.int32)
            np.add.at(edge, np.clip(place - (size - WIDTH), 0, last), 1)
            np.add.at(edge, np.minimum(place, last) + 1, -1)
            start = np.flatnonzero(np.cumsum(edge) > 0)
            out.append(np.stack([start, np.minimum(start + size, words)], 1))
        return np.unique(np.concatenate(out), axis=0)

    def scan(self, words: np.ndarray, shingles: np.ndarray, held: dict) -> dict[int, tuple[float, int]]:
        """item -> (likeness, first word) of the best window of a document of at least WIDTH words, for the items it holds enough of."""
        out: dict[int, tuple[float, int]] = {}
        window = self.windows(len(words), held)
        upto = {k: (place, np.concatenate([[0], np.cumsum(w)])) for k, (place, w) in held.items()}
        lo = 0
        while lo < len(window):
            first = int(window[lo, 0])
            hi = max(lo + 1, min(lo + 1024, int(np.searchsorted(window[:, 0], first + RUN, "right"))))
            w = window[lo:hi]
            lo = hi
            last = int(w[:, 1].max())
            near, items = self.near(fingerprints(words[first:last], w[:, 0] - first, w[:, 1] - w[:, 0]))
            for item in held.keys() & set(items.tolist()):
                x = w[near[items == item]]
                place, total = upto[item]
                # no window is more alike than by all the weight of the item's shingles in it
                most = (total[np.searchsorted(place, x[:, 1] - WIDTH, "right")] - total[np.searchsorted(place, x[:, 0])]) / self.whole[item]
                for k in np.lexsort((x[:, 0], -most)):
                    best = out.get(item, (LEAST - 1e-9, 0))
                    if most[k] < best[0] - 1e-12:
                        break
                    a, b = x[k]
                    got = self.likeness(np.unique(shingles[a : max(a + 1, b - WIDTH + 1)]), item)
                    if got > best[0] + 1e-12 or (item in out and abs(got - best[0]) <= 1e-12 and a < best[1]) or (item not in out and got >= best[0]):
                        out[item] = (got, int(a))
        return out


def _shared(items: DataFrame) -> DataFrame:
    """(s, n): the shingles that several items have, and how many."""

    def go(batches):
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            shingles, cut = W.shingle_hashes(*W.word_hashes(data, at), WIDTH)
            sets = [np.unique(shingles[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch({"s": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)})

    return items.select("text").mapInArrow(go, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")


def _blocks(benchmark: DataFrame):
    """Blocks of items that have text, each of bounded size; weights are counted over all of them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    size, total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = -(-size // BLOCK_BYTES)
    shared = stash(_shared(items), "shared") if n > 1 else None
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        ids, texts = [r["item_id"] for r in rows], [r["text"] for r in rows]
        if n == 1:
            yield Items(ids, texts)
        else:
            known = items.sparkSession.createDataFrame(pa.table({"s": Items(ids, texts).known.view(np.int64)}))
            yield Items(ids, texts, total, {r["s"]: r["n"] for r in shared.join(known, "s", "left_semi").collect()})


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word: each benchmark item that a document holds, with its most alike window.

    docs and benchmark need doc_id or item_id and text; other columns are ignored. Whole texts are searched, in any ASCII
    case and white space. Items of fewer than five words must occur word for word. Null and empty texts on either side match
    nothing; of equal windows the first counts; rows that share a doc_id count as one document; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark):

        def go(batches, items=items):
            worker.claim("shingles")
            for batch in batches:
                data, at = W.text_buffers(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                rows = []
                for lo, hi in W.slices(at):
                    words, bounds = W.word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    all_, cut = W.shingle_hashes(words, bounds, WIDTH)
                    for i, held in items.candidates(all_, cut):
                        if bounds[i + 1] - bounds[i] >= WIDTH:
                            found = items.scan(words[bounds[i] : bounds[i + 1]], all_[cut[i] : cut[i + 1]], held)
                            rows += [(ids[lo + i], items.ids[k], s, a) for k, (s, a) in found.items()]
                    for width in items.short:
                        part, cut2 = W.shingle_hashes(words, bounds, width)
                        for k in np.flatnonzero(items.n == width):
                            own = W.shingle_hashes(items.words[items.bounds[k] : items.bounds[k + 1]], np.array([0, width]), width)[0][0]
                            p = np.flatnonzero(part == own)
                            doc = np.searchsorted(cut2, p, "right") - 1
                            doc, first = np.unique(doc, return_index=True)
                            rows += [(ids[lo + i], items.ids[k], 1.0, int(p[f] - cut2[i])) for i, f in zip(doc, first, strict=True) if bounds[i + 1] - bounds[i] >= width]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "start_word"])

        part = docs.mapInArrow(go, "doc_id long, item_id long, similarity double, start_word long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("start_word")).where("false")
    best = F.max_by(F.struct("similarity", "start_word"), F.struct("similarity", -F.col("start_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.similarity", "best.start_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item; all columns stay. Rows that share a doc_id are documents of their own."""
    row = fresh(docs, "_row")
    rows, _ = numbered(docs, row)
    bad = leaks(rows.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(bad, row, "left_anti").select(*docs.columns)
