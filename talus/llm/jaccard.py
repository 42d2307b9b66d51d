"""Exact Jaccard self-join of shingle sets by universe partition, with components of the links.

Method. Equal sets fall into one class. A set can only link with another when enough of its lowest-hashed shingles
occur elsewhere (a lossless count filter). For the classes that remain, shingles are hashed into m segments chosen by
size band; two sets whose symmetric difference is at most H agree on a segment as soon as the segments a set indexes
(one credit each, two where all one-deletion variants of the segment are indexed as well) outnumber H. Bands are
sized so that links stay within a band or its neighbour; m and the number of deletion segments come from a cost model.
Segments whose key is hot are not expanded into pairs: a set that keeps enough credit without them loses nothing, and
the others meet again by their rarest shingles. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

import io
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import words as W
from talus.llm import worker
from talus.llm.graph import components
from talus.llm.store import NO_ID, buckets, fresh, numbered, stash

U64 = np.uint64
WIDTH = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Keys in more sets than this are not expanded into pairs at once.
HOT = 8
#: Owners of a hot key that all others meet before pairs across what is left are made.
LEADERS = 16
#: Credit to spare, so that a set may lose some segments to hot keys.
SPARE = 1.2
#: Sets up to this size index no segments; they, and the larger sets they can link with, meet by their rarest shingles.
TINY = 8
#: Text bytes whose keys one bucket takes, about.
BUCKET_BYTES = 4 << 20

#: Shingles whose keys a worker holds at once, and rows of sets that it takes up at once.
AT_ONCE, ROWS = 1 << 18, 256

_ROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("head", pa.binary()), ("keys", pa.binary()), ("aux", pa.binary())])
ROW = "bucket int, chunk long, head binary, keys binary, aux binary"


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def lowest_overlap(total: int) -> int:
    """The least intersection of a link between sets whose sizes add up to total."""
    return -(-PERCENT * total // (100 + PERCENT))


def own_overlap(n):
    """The least intersection of any link of a set of n."""
    return -(-PERCENT * n // 100)


@lru_cache(maxsize=4096)
def bands(n: int) -> tuple[int, int, int, int]:
    """(i, b_i, b_i+1, b_i+2): the band of size n and its bounds; links stay in a band or go to the next."""
    i, lo = 0, TINY + 1
    while True:
        hi = lo * 100 // PERCENT + 1
        if n < hi:
            return i, lo, hi, hi * 100 // PERCENT + 1
        i, lo = i + 1, hi


def needed(n: int, lo: int, mid: int, hi: int) -> int:
    """Credits that let a set of n find all its links within the table of bands [lo, mid) and [mid, hi)."""
    most = min(n * 100 // PERCENT, hi - 1 if n < mid else mid - 1)
    least = max(lo, own_overlap(n))
    gaps = [n + b - 2 * lowest_overlap(n + b) for b in range(max(least, most - 7), most + 1)]
    return max(gaps, default=-1) + 1


@lru_cache(maxsize=4096)
def segments(lo: int, mid: int, hi: int) -> tuple[int, int]:
    """(m, q): the cheapest number of segments, and of those with deletion variants, that give sets of the table the credits needed.

    Cost counts the keys to emit and, dearer, the segments of a single shingle, which meet by chance most often.
    """
    best = None
    for share in (0.0, 0.25, 0.5, 1.0):
        for m in range(1, hi):
            q = math.ceil(share * m)
            ok = True
            for n in (lo, (lo + mid) // 2, mid - 1, mid, hi - 1):
                x = n / m
                full, single = 1 - math.exp(-x), x * math.exp(-x)
                credit = m * full + q * (full - single)
                ok &= credit - 2.5 * math.sqrt(max(1.0, m * full * (1 - full))) >= SPARE * needed(n, lo, mid, hi)
            if ok:
                x = mid / m
                cost = m + q * x + 3 * m * x * math.exp(-x)
                if best is None or cost < best[0]:
                    best = (cost, m, q)
                break
    return best[1:] if best else (max(1, hi // 2), max(1, hi // 2))


def pieces(batches, sized: str | None = None, most: int = AT_ONCE):
    """Slices of at most ROWS rows of batches; with sized, the name of a column of numbers, also of about most by their sum."""
    for batch in batches:
        lo = 0
        total = np.concatenate([[0], np.cumsum(batch.column(sized).to_numpy(zero_copy_only=False))]) if sized else None
        while lo < batch.num_rows:
            hi = min(lo + ROWS, batch.num_rows) if total is None else max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def chunk_id(k: int) -> int:
    ctx = TaskContext.get()
    return ((ctx.partitionId() if ctx else 0) << 24) + k


def deal(keys: np.ndarray, nb: int) -> np.ndarray:
    """The bucket of each key, from its high bits."""
    return ((keys >> U64(33)) % U64(nb)).astype(np.int32)


def rows(bucket, chunk, head, keys, aux) -> pa.RecordBatch:
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(head, pa.binary()), pa.array(keys, pa.binary()), pa.array(aux, pa.binary())], schema=_ROW)


def by_bucket(keys: np.ndarray, nb: int):
    """(bucket, positions of its keys in order) for each bucket that has keys."""
    b = deal(keys, nb)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(nb + 1))
    for k in np.flatnonzero(np.diff(cut)):
        yield int(k), order[cut[k] : cut[k + 1]]


def exchange(sent: DataFrame, answer, collect, schema: str) -> DataFrame:
    """Each chunk of rows asks the bucket of each of its keys and gets back what answer(keys of a bucket, aux) says.

    sent: ROW rows; those with a head go through to the chunk. answer: list of keys, list of aux -> list of blobs.
    collect: (chunk's head, [(bucket, blob)]) -> RecordBatch of schema.
    """

    def bucket(table: pa.Table) -> pa.Table:
        worker.claim("shingles")
        heads, keys, aux = (table.column(c).to_pylist() for c in ("head", "keys", "aux"))
        ask = [i for i, k in enumerate(keys) if k is not None]
        got = [None] * len(keys)
        if ask:
            for i, blob in zip(ask, answer([keys[i] for i in ask], [aux[i] for i in ask]), strict=True):
                got[i] = blob
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "head": pa.array(heads, pa.binary()), "resp": pa.array(got, pa.binary())})

    def chunk(table: pa.Table) -> pa.Table:
        heads = [h for h in table.column("head").to_pylist() if h is not None]
        resp = sorted((b, r) for b, r in zip(table.column("bucket").to_pylist(), table.column("resp").to_pylist(), strict=True) if r is not None)
        return pa.Table.from_batches([collect(heads[0], resp)])

    answered = sent.groupBy("bucket").applyInArrow(bucket, "bucket int, chunk long, head binary, resp binary")
    return answered.groupBy("chunk").applyInArrow(chunk, schema)


def sets_of(batch: pa.RecordBatch):
    """(first row, doc_ids, list of sorted distinct shingle hashes) for slices of a batch of (doc_id, text)."""
    data, at = W.text_buffers(batch.column("text"))
    ids = np.asarray(batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)
    for lo, hi in W.slices(at):
        h, b = W.word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        s, cut = W.shingle_hashes(h, b, WIDTH)
        yield ids[lo:hi], [np.unique(s[cut[i] : cut[i + 1]]) for i in range(hi - lo)]


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share; as signed integers."""
    a, b = W.mix(s + U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), W.mix(s ^ U64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _filter_rows(nb: int):
    def go(batches):
        worker.claim("shingles")
        k = 0
        for batch in batches:
            for ids, sets in sets_of(batch):
                chunk = chunk_id(k)
                k += 1
                n = np.array([len(s) for s in sets], np.int64)
                sig = np.array([signature(s) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
                need = -(-n // 4)
                p = np.minimum(n, n - own_overlap(n) + need)
                keys = np.concatenate([s[:x] for s, x in zip(sets, p, strict=True)]) if len(sets) else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(len(sets)), p)
                mixed = W.mix(keys ^ U64(0xD6E8FEB86659FD93))
                out = [(chunk % nb, pack(ids=ids, n=n, sig=sig, need=need), None, None)]
                for b, at in by_bucket(mixed, nb):
                    out.append((b, None, mixed[at].astype(np.uint32).tobytes(), np.bincount(doc[at], minlength=len(sets)).astype(np.uint32).tobytes()))
                yield rows([o[0] for o in out], [chunk] * len(out), [o[1] for o in out], [o[2] for o in out], [o[3] for o in out])

    return go


def _shared(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    """For each row, how many of each document's keys other documents have as well."""
    own = [np.frombuffer(k, np.uint32) for k in keys]
    _, back, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    twice, out, at = count[back] > 1, [], 0
    for k, a in zip(own, aux, strict=True):
        per = np.frombuffer(a, np.uint32)
        total = np.concatenate([[0], np.cumsum(twice[at : at + len(k)])])
        end = np.cumsum(per, dtype=np.int64)
        out.append((total[end] - total[end - per]).astype(np.uint32).tobytes())
        at += len(k)
    return out


def _classify(head: bytes, resp: list) -> pa.RecordBatch:
    h = unpack(head)
    got = np.zeros(len(h["n"]), np.int64)
    for _, r in resp:
        got += np.frombuffer(r, np.uint32)
    return pa.record_batch({"doc_id": h["ids"], "n": h["n"], "sig": h["sig"][:, 0].copy(), "sig2": h["sig"][:, 1].copy(), "may": (h["n"] > 0) & (got >= h["need"])})


def credits(s: np.ndarray, slot: int, lo: int, mid: int, hi: int, table: int):
    """(keys, credit each key's segment gives, slack): what a set indexes in one table, and by how much its credit exceeds the need."""
    m, q = segments(lo, mid, hi)
    h = W.mix(s ^ U64(0x8CB92BA72F3D8DD7 * (2 * table + 1) % (1 << 64)))
    seg = (h >> U64(20)) % U64(m)
    part = W.mix(h + U64(0x632BE59BD9B4E019))
    size = np.bincount(seg.astype(np.int64), minlength=m)
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg.astype(np.int64), part)
    full = np.flatnonzero(size)
    label = lambda j: W.mix(j.astype(np.uint64) * U64(0x9FB21C651E98DF25) + U64(table))
    keys = [W.mix(total[full] + label(full))]
    seg_of = [full]
    two = seg < U64(q)
    two &= size[seg.astype(np.int64)] > 1
    j = seg[two].astype(np.int64)
    keys.append(W.mix(total[j] - part[two] + label(j)))
    seg_of.append(j)
    credit = (size > 0).astype(np.int64) + ((size > 1) & (np.arange(m) < q))
    return np.concatenate(keys), np.concatenate(seg_of), credit, int(credit.sum()) - needed(len(s), lo, mid, hi)


def tables_of(n: int):
    """(slot, table, bounds) of the one or two tables that a set of n takes part in."""
    i, lo, mid, hi = bands(n)
    yield 0, i, (lo, mid, hi)
    if i:
        _, l0, m0, h0 = bands(lo - 1)
        yield 1, i - 1, (l0, m0, h0)


def _class_sets(batches):
    """Rows (cid, n, shingles, slack) of classes named in doc_id; slack below zero: credit in either table, or with partners that index no segments, doesn't cover the set."""
    worker.claim("shingles")
    for batch in batches:
        for ids, sets in sets_of(batch):
            out = []
            for cid, s in zip(ids.tolist(), sets, strict=True):
                slack = [credits(s, slot, *bound, table)[3] for slot, table, bound in tables_of(len(s))] if own_overlap(len(s)) > TINY else [-1]
                out.append((cid, len(s), s.tobytes(), min(slack)))
            yield pa.record_batch({"cid": pa.array([o[0] for o in out], pa.int64()), "n": pa.array([o[1] for o in out], pa.int64()), "shingles": pa.array([o[2] for o in out], pa.binary()), "slack": pa.array([o[3] for o in out], pa.int64())})


def _segment_rows(nb: int):
    def go(batches):
        worker.claim("shingles")
        k = 0
        for batch in pieces(batches, "n"):
            cids = batch.column("cid").to_pylist()
            keys, who, room = [], [], []
            for cid, n, blob, slack in zip(cids, batch.column("n").to_pylist(), batch.column("shingles").to_pylist(), batch.column("slack").to_pylist(), strict=True):
                if n <= TINY:
                    continue
                s = np.frombuffer(blob, np.uint64)
                for slot, table, bound in tables_of(n):
                    got, seg, credit, _ = credits(s, slot, *bound, table)
                    keys.append(got)
                    who.append(np.full(len(got), cid, np.int64))
                    room.append(credit[seg].astype(np.int8) + np.int8(10 * slot))
            if not keys:
                continue
            keys, who, room = np.concatenate(keys), np.concatenate(who), np.concatenate(room)
            chunk = chunk_id(k)
            k += 1
            out = [(b, keys[at].tobytes(), pack(cid=who[at], room=room[at])) for b, at in by_bucket(keys, nb)]
            yield rows([o[0] for o in out], [chunk] * len(out), [None] * len(out), [o[1] for o in out], [o[2] for o in out])

    return go


def _runs(keys: np.ndarray, who: np.ndarray):
    """Keys and owners in key order without repeats, and the bounds of each key's run."""
    order = np.lexsort((who, keys))
    keys, who = keys[order], who[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
    order, keys, who = order[new], keys[new], who[new]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    return order, keys, who, cut


def compact(pairs: list[np.ndarray], at_least: int = 0) -> list[np.ndarray]:
    """The pairs as one array without repeats, once there are so many."""
    return [np.unique(np.concatenate(pairs), axis=0)] if sum(map(len, pairs)) > at_least else pairs


def _all_pairs(who: np.ndarray, cut: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pairs within each run, as rows (a, b), without repeats."""
    out = []
    for n in np.unique(size):
        if n < 2:
            continue
        block = who[cut[:-1][size == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(int(n), 1)
        out.append(np.stack([block[:, i].ravel(), block[:, j].ravel()], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _segment_pairs(table: pa.Table, hot: int) -> pa.Table:
    """Candidate pairs (a, b) of a bucket; for hot keys pairs with the least owner on a share of the keys, and the credit that each owner loses (slot, lost)."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
    aux = [unpack(x) for x in table.column("aux").to_pylist()]
    order, keys, who, cut = _runs(keys, np.concatenate([x["cid"] for x in aux]))
    room = np.concatenate([x["room"] for x in aux])[order]
    size = np.diff(cut)
    pairs = [_all_pairs(who, cut, np.where(size <= hot, size, 0))]
    lost = []
    for k in np.flatnonzero(size > hot):
        own = who[cut[k] : cut[k + 1]]
        if keys[cut[k]] % U64(8) == 0:
            pairs.append(np.stack([np.full(len(own) - 1, own[0]), own[1:]], 1))
            if len(pairs) > 64:
                pairs = compact(pairs, 1 << 20)
        lost.append(np.stack([own, room[cut[k] : cut[k + 1]].astype(np.int64)], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    lost = np.concatenate(lost) if lost else np.zeros((0, 2), np.int64)
    return pa.table({"a": np.concatenate([pairs[:, 0], lost[:, 0]]), "b": np.concatenate([pairs[:, 1], lost[:, 1] % 10]), "slot": np.concatenate([np.full(len(pairs), -1), lost[:, 1] // 10]).astype(np.int32)})


def _verify(batches):
    worker.claim("shingles")
    for batch in pieces(batches):
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that link."""
    one, two = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")


def _rare_rows(nb: int):
    """Asks how many sets have each shingle."""

    def go(batches):
        worker.claim("shingles")
        k = 0
        for batch in pieces(batches, "n", 4 * AT_ONCE):
            chunk = chunk_id(k)
            k += 1
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
            keys = np.concatenate([np.zeros(0, np.uint64), *sets])
            out = [(chunk % nb, pack(cid=np.array(batch.column("cid").to_pylist(), np.int64), home=np.array(batch.column("home").to_pylist(), np.int64), n=np.array([len(s) for s in sets]), keys=keys), None)]
            out += [(b, None, keys[at].tobytes()) for b, at in by_bucket(W.mix(keys), nb)]
            yield rows([o[0] for o in out], [chunk] * len(out), [o[1] for o in out], [o[2] for o in out], [None] * len(out))

    return go


def _frequency(keys: list[bytes], _aux: list) -> list[bytes]:
    own = [np.frombuffer(k, np.uint64) for k in keys]
    _, back, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    cut = np.cumsum([len(k) for k in own])[:-1]
    return [x.astype(np.uint32).tobytes() for x in np.split(count[back], cut)]


def _rarest(nb: int):
    """Deals each set's rarest shingles, as many as one of a link must share, to buckets."""

    def go(head: bytes, resp: list) -> pa.RecordBatch:
        h = unpack(head)
        keys, n, freq = h["keys"], h["n"], np.zeros(len(h["keys"]), np.int64)
        dealt = dict(resp)
        for b, at in by_bucket(W.mix(keys), nb):
            freq[at] = np.frombuffer(dealt[b], np.uint32)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((keys, freq, doc))
        place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
        use = (place < np.repeat(n - own_overlap(n) + 1, n)) & (freq[order] > 1)
        take, place = order[use], place[use]
        keys, doc = W.mix(keys[take] + U64(77)), doc[take]
        out = [(b, keys[at].tobytes(), pack(cid=h["cid"][doc[at]], home=h["home"][doc[at]], n=n[doc[at]], left=n[doc[at]] - place[at])) for b, at in by_bucket(keys, nb)]
        return rows([o[0] for o in out], [0] * len(out), [None] * len(out), [o[1] for o in out], [o[2] for o in out])

    return go


def _rare_pairs(star: int, table: pa.Table) -> pa.Table:
    """The pairs of a key's owners that no link joins yet and whose sizes and shingles from the key on allow a link.

    Each owner meets all others that remain, one block at a time, whatever their number. With star, owners of a key that
    has more than star of them meet LEADERS of them only.
    """
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
    aux = [unpack(x) for x in table.column("aux").to_pylist()]
    order, keys, who, cut = _runs(keys, np.concatenate([x["cid"] for x in aux]))
    home, n, left = (np.concatenate([x[k] for x in aux])[order] for k in ("home", "n", "left"))
    pairs = [np.zeros((0, 2), np.int64)]
    for k in np.flatnonzero(np.diff(cut) > 1):
        own = slice(cut[k], cut[k + 1])
        w, at, size, rest = who[own], home[own], n[own], left[own]
        some = star and len(w) > star
        # those with the fewest rarer shingles are nearest to what the group has in common
        for x in np.lexsort((w, size - rest))[:LEADERS] if some else range(len(w) - 1):
            y = slice(0 if some else x + 1, None)
            fits = (at[y] != at[x]) & (np.minimum(rest[y], rest[x]) >= -(-PERCENT * (size[y] + size[x]) // (100 + PERCENT)))
            if fits.any():
                pairs.append(np.sort(np.stack([np.full(fits.sum(), w[x]), w[y][fits]], 1), axis=1))
                if len(pairs) > 64:
                    pairs = compact(pairs, 1 << 20)
    pairs = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _paired(star: int):
    return lambda table: _rare_pairs(star, table)


def shingle_links(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links) of docs' whole texts (doc_id, text), whose doc_ids are long, not null and do not repeat.

    documents: doc_id, n, sig, sig2, may for each row. classes: sig, sig2, n, doc_id (the least), cid for each class of equal
    sets that can have links; two 64-bit sums and the size tell sets apart, and cid is a number of its own. links: (a, b)
    pairs of classes that link, enough for the components of all links. hot: keys in more sets are not expanded at once; it
    changes the work, not the result.
    """
    nb = 2 * buckets(docs, 2 * BUCKET_BYTES)
    sent = docs.mapInArrow(_filter_rows(nb), ROW)
    seen = stash(exchange(sent, _shared, _classify, "doc_id long, n long, sig long, sig2 long, may boolean"), "sets")
    reps = seen.where("may").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("doc_id"))
    reps = stash(reps.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # classes grow with the documents, so this is a shuffled join at every size
    sets = docs.join(reps.select("doc_id", "cid").hint("merge"), "doc_id").select(F.col("cid").alias("doc_id"), "text")
    sets = stash(sets.mapInArrow(_class_sets, "cid long, n long, shingles binary, slack long"), "shingles")

    found = stash(sets.mapInArrow(_segment_rows(nb), ROW).groupBy("bucket").applyInArrow(lambda t: _segment_pairs(t, hot), "a long, b long, slot int"), "candidates")
    links = stash(_links(found.where("slot = -1").select("a", "b").distinct(), sets), "links")

    lost = found.where("slot >= 0").groupBy(F.col("a").alias("cid"), "slot").agg(F.sum("b").alias("lost")).groupBy("cid").agg(F.max("lost").alias("lost"))
    open_ = sets.join(lost, "cid", "left").where("slack < coalesce(lost, 0)").select("cid", "n", "shingles")
    # stars first: in a large group of near copies they join most owners, and only pairs across what is left meet after that
    for star in (hot, 0):
        home = components(links).select(F.col("v").alias("cid"), F.col("component").alias("home"))
        homed = open_.join(home, "cid", "left").select("cid", F.coalesce("home", "cid").alias("home"), "n", "shingles")
        asked = exchange(homed.mapInArrow(_rare_rows(nb), ROW), _frequency, _rarest(nb), ROW)
        again = asked.groupBy("bucket").applyInArrow(_paired(star), "a long, b long").distinct()
        links = stash(links.unionByName(_links(again, sets)), "links")
    return seen, reps, links


def _groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of docs as shingle_links takes them."""
    seen, reps, links = shingle_links(docs, hot)
    comp = components(links).withColumnRenamed("v", "cid")
    classes = reps.join(comp, "cid", "left").select("sig", "sig2", "n", F.col("doc_id").alias("low"), F.coalesce("component", "cid").alias("component"))
    classes = stash(classes, "low")
    low = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(low, "component").select("sig", "sig2", "n", "component_id")
    return seen.join(named.hint("merge"), ["sig", "sig2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: the least doc_id that links reach, a document's own included.

    docs needs doc_id and text; other columns are ignored. A text without words (null, empty, white space) has no shingles
    and its own doc_id as component. Rows that share a doc_id are documents of their own, and repeated rows are repeated; a
    null doc_id is the least of all. Ties have no effect; texts of any length count whole; an empty table gives no rows.
    """
    rows_, own = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")), "row")
    got = _groups(rows_.select(F.col("row").alias("doc_id"), "text"), hot)
    if own:
        null = lambda c: F.nullif(F.col(c), F.lit(NO_ID).cast("long")).alias(c)
        return got.select(null("doc_id"), "n_shingles", null("component_id"))
    ids = rows_.select("row", F.expr("try_cast(doc_id as bigint)").alias("id"))
    one, all_ = ids.toDF("doc_id", "one"), ids.toDF("component_id", "all_")
    return got.join(one, "doc_id").join(all_, "component_id").select(F.col("one").alias("doc_id"), "n_shingles", F.col("all_").alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of docs of each near-duplicate group, that with the least doc_id (null first, then by hash of text); all columns stay.

    Rows that share a doc_id are documents of their own. All rows whose text has no words stay.
    """
    row = fresh(docs, "_row")
    rows_, _ = numbered(docs, row)
    got = _groups(rows_.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")))
    keep = got.where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return rows_.join(keep, row, "left_semi").select(*docs.columns)
