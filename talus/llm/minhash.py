"""Near duplicates by b-bit MinHash signatures and a multi-index Hamming join.

Method. A signature has CHUNKS chunks of WIDE positions of BITS bits each; its distance is the number of positions that
differ. Two signatures that differ in fewer than CHUNKS * (ERRORS + 1) positions have a chunk with at most ERRORS of them, so
every chunk is indexed once for each choice of ERRORS positions to leave out: all pairs below that distance share a key. Keys
with many owners are not expanded: all owners meet the most central one, and those that the links found so far leave in
different groups meet in blocks that compare signatures; a near pair is emitted by the first key that it shares only, and
only where sizes and parity sketches allow a link, which they do for every link. Every pair is confirmed on the whole sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import words as W
from talus.llm import worker
from talus.llm.graph import components
from talus.llm.store import NO_ID, fresh, numbered, stash

U64 = np.uint64
WIDTH = 2
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: At PERCENT a fifth of the positions differs, 20 +- 4 of 100; a pair without a shared key has CHUNKS * (ERRORS + 1) = 40 at least.
CHUNKS, WIDE, ERRORS, BITS = 20, 5, 1, 16
POSITIONS = CHUNKS * WIDE
#: The largest distance of which all pairs share a key; pairs that differ in more positions are not confirmed, 5 deviations beyond the least links.
FAR = CHUNKS * (ERRORS + 1) - 1
#: Keys with more owners are not expanded into pairs at once.
HOT = 16
#: Owners in a block of a hot key.
BLOCK = 1024
#: Shingles hashed at once.
AT_ONCE = 1 << 17

#: Bits of a set's parity sketch. Each shingle in one of two sets only changes one bit, so the bits that differ are no more than these.
PARITY = 1024

#: What a class is compared by: its signature, its parity sketch and its size.
MARK = np.dtype([("mins", "<u2", (POSITIONS,)), ("bits", "u1", (PARITY // 8,)), ("n", "<i8")])

_rng = np.random.Generator(np.random.PCG64(20240806))
_SALT = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64)
_LABEL = _rng.integers(1, 1 << 63, (CHUNKS, WIDE), dtype=np.uint64)


def sets_of(batch: pa.RecordBatch, width: int):
    """(ids, list of sorted distinct shingle hashes) for slices of a batch of (doc_id, text)."""
    data, at = W.text_buffers(batch.column("text"))
    ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
    for lo, hi in W.slices(at):
        h, b = W.word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        s, cut = W.shingle_hashes(h, b, width)
        yield ids[lo:hi], [np.unique(s[cut[i] : cut[i + 1]]) for i in range(hi - lo)]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each set, BITS bits of the least hash by each of POSITIONS functions; zeros for an empty set."""
    out = np.zeros((len(sets), POSITIONS), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    while some:
        take, n = [], 0
        while some and (not take or n + len(sets[some[0]]) <= AT_ONCE):
            take.append(some.pop(0))
            n += len(sets[take[-1]])
        x, start = np.concatenate([sets[i] for i in take]), np.cumsum([0] + [len(sets[i]) for i in take[:-1]])
        for k in range(POSITIONS):
            y = (x ^ _SALT[k]) * U64(0x9E3779B97F4A7C15)
            y ^= y >> U64(29)
            y *= U64(0xBF58476D1CE4E5B9)
            out[take, k] = (np.minimum.reduceat(y, start) >> U64(16)).astype(np.uint16)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parity sketch of each set."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * PARITY
    where = (W.mix(np.concatenate([np.zeros(0, np.uint64), *sets]) ^ _SALT[0]) >> U64(40)).astype(np.int64) % PARITY
    return np.packbits(np.bincount(at + where, minlength=len(sets) * PARITY).reshape(len(sets), PARITY) & 1, axis=1)


def marks(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(sets), MARK)
    out["mins"], out["bits"], out["n"] = minima(sets), parities(sets), [len(s) for s in sets]
    return out


def may_link(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether the marks of pairs allow a link: by sizes and by the parity bits that differ. False only where the sets do not link."""
    both = one["n"] + two["n"]
    apart = np.bitwise_count(one["bits"] ^ two["bits"]).sum(1, dtype=np.int64)
    return (100 * np.minimum(one["n"], two["n"]) >= percent * np.maximum(one["n"], two["n"])) & ((100 + percent) * apart <= (100 - percent) * both)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature: a chunk without ERRORS of its positions, for each choice of them."""
    s = signatures.reshape(-1, CHUNKS, WIDE).astype(np.uint64)
    out = []
    for j, left in enumerate(combinations(range(WIDE), WIDE - ERRORS)):
        v = np.zeros(s.shape[:2], np.uint64)
        for p in left:
            v = v << U64(BITS) | s[:, :, p]
        out.append(W.mix(v + _LABEL[:, j]))
    return np.concatenate(out, 1)


def distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Positions in which each row of one differs from each of two."""
    out = np.zeros((len(one), len(two)), np.int16)
    for k in range(POSITIONS):
        out += one[:, k, None] != two[None, :, k]
    return out


def _marks(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), MARK)


def _signed(width: int):
    def go(batches):
        worker.claim("shingles")
        for batch in batches:
            for ids, sets in sets_of(batch, width):
                sums = np.array([(W.mix(s + U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), W.mix(s ^ U64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                yield pa.record_batch({"doc_id": ids, "n": np.array([len(s) for s in sets], np.int64), "sig": sums[:, 0].copy(), "sig2": sums[:, 1].copy(), "mark": pa.array([m.tobytes() for m in marks(sets)], pa.binary())})

    return go


def _keyed(batches):
    for batch in batches:
        cid = np.asarray(batch.column("cid").to_numpy(zero_copy_only=False), np.int64)
        for lo in range(0, len(cid), 512):
            keys = keys_of(_marks(batch.column("mark").slice(lo, 512))["mins"])
            yield pa.record_batch({"key": keys.view(np.int64).ravel(), "cid": np.repeat(cid[lo : lo + 512], keys.shape[1])})


def _near(percent: int):
    def go(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                one, two = _marks(some.column("ma")), _marks(some.column("mb"))
                yield some.select(["a", "b"]).filter(pa.array(((one["mins"] != two["mins"]).sum(1) <= FAR) & may_link(one, two, percent)))

    return go


def _blocks(percent: int):
    """The pairs of two blocks of a key's owners that may link, that no link joins yet and that share no earlier key."""

    def go(table: pa.Table) -> pa.Table:
        side, key = np.asarray(table.column("side").to_numpy()), np.int64(table.column("key")[0].as_py())
        cid, home, mark = np.asarray(table.column("cid").to_numpy()), np.asarray(table.column("home").to_numpy()), _marks(table.column("mark"))
        one, two = np.flatnonzero(side < 2), np.flatnonzero((side == 2) if (side == 2).any() else (side == 0))
        i, j = np.nonzero((distances(mark["mins"][one], mark["mins"][two]) <= FAR) & (home[one][:, None] != home[two][None]))
        keys, out = keys_of(mark["mins"]).view(np.int64), []
        for lo in range(0, len(i), 4096):
            x, y = one[i[lo : lo + 4096]], two[j[lo : lo + 4096]]
            keep = may_link(mark[x], mark[y], percent)
            x, y = x[keep], y[keep]
            first = keys[x, (keys[x] == keys[y]).argmax(1)] == key
            out.append(np.sort(np.stack([cid[x[first]], cid[y[first]]], 1), axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return go


def _confirmed(percent: int):
    def go(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return go


def _sets(width: int):
    def go(batches):
        worker.claim("shingles")
        for batch in batches:
            for ids, sets in sets_of(batch, width):
                yield pa.record_batch({"cid": ids, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return go


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose signatures are near and whose whole sets link."""
    for c in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("cid").alias(c), F.col("mark").alias(f"m{c}")), c)
    near = stash(pairs.select("a", "b", "ma", "mb").mapInArrow(_near(percent), "a long, b long"), "near")
    if near.isEmpty():  # then no text need move
        return near
    asked = near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct()
    # grows with the documents, so these are shuffled joins at every size
    texts = docs.join(reps.join(asked, "cid").select("doc_id", "cid").hint("merge"), "doc_id").select(F.col("cid").alias("doc_id"), "text")
    sets = stash(texts.mapInArrow(_sets(width), "cid long, shingles binary"), "shingles")
    one, two = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return near.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long")


def _star(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of the owners (key, cid, rank) of keys with the one of the highest rank."""
    lead = rows.groupBy("key").agg(F.max("rank").alias("r")).select("key", F.col("r.c").alias("lead"))
    return rows.join(lead, "key").where("cid <> lead").select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b"))


def _split_keys(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (key, cid, ...) with home, the group that found links put a class in, of the keys whose owners are in several groups."""
    home = components(found).select(F.col("v").alias("cid"), F.col("component").alias("home"))
    homed = stash(rows.join(home, "cid", "left").withColumn("home", F.coalesce("home", "cid")), "homes")
    split = homed.groupBy("key").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low < high").select("key")
    return homed.join(split, "key")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links) of docs' whole texts (doc_id long, not null, not repeated; text).

    documents: doc_id, n, sig, sig2, mark of each row. classes: sig, sig2, n, doc_id (the least), mark, cid for each class of equal
    sets that are not empty. links: (a, b) pairs of cids that link, enough for the components of all links. hot and block change
    the work, not the result.
    """
    seen = stash(docs.mapInArrow(_signed(width), "doc_id long, n long, sig long, sig2 long, mark binary"), "signatures")
    reps = seen.where("n > 0").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark"))
    reps = stash(reps.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keyed = reps.select("cid", "mark").mapInArrow(_keyed, "key long, cid long")
    # counted before rows of a key meet; most keys have one owner and end here
    shared = stash(keyed.groupBy("key").agg(F.count("*").alias("owners")).where("owners > 1"), "keys")
    owned = stash(keyed.join(shared.hint("merge"), "key"), "owners")
    few = owned.where(F.col("owners") <= hot).groupBy("key").agg(F.array_sort(F.collect_list("cid")).alias("o"))
    few = few.select("o", F.explode(F.expr("sequence(1, size(o) - 1)")).alias("i")).select(F.expr("o[i - 1]").alias("a"), F.explode(F.expr("slice(o, i + 1, size(o))")).alias("b"))

    # the owner that shares hot keys with most others is nearest to what a group has in common
    many = owned.where(F.col("owners") > hot)
    central = many.groupBy("cid").agg(F.sum("owners").alias("central"))
    many = stash(many.join(central, "cid").select("key", "cid", "owners", F.struct("central", F.col("cid").alias("c")).alias("rank")), "many")
    pairs = few.unionByName(_star(many)).distinct()
    found = stash(_links(pairs, reps, docs, width, percent), "links")

    # what that left: keys whose owners are in different groups
    open_ = _split_keys(many, found).select("key", "cid", "home", "owners").join(reps.select("cid", "mark"), "cid")
    open_ = open_.withColumn("m", F.ceil(F.col("owners") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("m")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")
    met = open_.select("key", "cid", "home", "mark", "own", each).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "home", "mark",
        F.expr("case when own = other then 0 when own < other then 1 else 2 end").alias("side"),
    )
    last = met.groupBy("key", "i", "j").applyInArrow(_blocks(percent), "a long, b long")
    last = stash(_links(last, reps, docs, width, percent), "links")
    return seen, reps, found.unionByName(last)


def _groups(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of docs as links takes them."""
    seen, reps, found = links(docs, **how)
    comp = components(found).withColumnRenamed("v", "cid")
    named = stash(reps.join(comp, "cid", "left").select("sig", "sig2", "n", "doc_id", F.coalesce("component", "cid").alias("component")), "named")
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(low, "component").select("sig", "sig2", "n", "component_id")
    out = seen.select("doc_id", "sig", "sig2", "n").join(named.hint("merge"), ["sig", "sig2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs: the least doc_id that links reach, and whether it is the row's own.

    docs needs doc_id and text; other columns are ignored. A text without words (null, empty, white space) has no shingles, links
    with nothing and is kept. Very long texts count whole. Rows that share a doc_id are documents of their own, of which
    the first by hash of text is kept, and repeated rows are copies; a null doc_id is the least of all. Ties have no effect;
    an empty table gives no rows.
    """
    rows, own = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")), "row")
    got = _groups(rows.select(F.col("row").alias("doc_id"), "text"), **how).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if own:
        null = lambda c: F.nullif(F.col(c), F.lit(NO_ID).cast("long")).alias(c)
        return got.select(null("doc_id"), "n_shingles", null("component_id"), "kept")
    ids = rows.select("row", F.expr("try_cast(doc_id as bigint)").alias("id"))
    one, all_ = ids.toDF("doc_id", "one"), ids.toDF("component_id", "all_")
    return got.join(one, "doc_id").join(all_, "component_id").select(F.col("one").alias("doc_id"), "n_shingles", F.col("all_").alias("component_id"), "kept")


def first_of_groups(docs: DataFrame, **how) -> DataFrame:
    """One row of docs of each near-duplicate group, that with the least doc_id (null first, then by hash of text); all columns stay.

    Nulls, repeats and empty texts are as in near_groups: all rows whose text has no words stay.
    """
    row = fresh(docs, "_row")
    rows, _ = numbered(docs, row)
    got = _groups(rows.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")), **how)
    keep = got.where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return rows.join(keep, row, "left_semi").select(*docs.columns)
