"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

Only lengths matter to a packing, so it is solved on the counts of the lengths 1..capacity: the plan has a bounded
number of bin patterns whatever the number of documents. Pieces then find their place by rank among equal lengths.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm import words as W
from talus.llm import worker
from talus.llm.store import stash

CAPACITY = 2048
#: The tokenizer's file, and the words that a worker remembers: beyond that, those which occur again.
TOKENIZER = "word_bpe_49k.json"
REMEMBER = 600_000
#: Bytes of text that are split and encoded at once.
AT_ONCE = 1 << 20

# Words of these characters split alike in every regex engine and lower-case alike in every Unicode version.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
_LETTERS = re.compile(r"[a-zà-öø-ÿ]+([!-&(-/:-@\[-`{-~]?)")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ÿ]+")
#: Texts with these go through the tokenizer as a whole.
_ODD = "[\x1c-\x1f]|<\\|"
_encoders: dict[str, "WordEncoder"] = {}
worker.remembers("tokens", _encoders.clear)


def tokenizer_path(path: str | None = None) -> str:
    """A tokenizer's file; without one, that of the public package."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordTable:
    """Token ids of words by the words' hashes: sorted hashes, where each word's ids begin, how many there are, and all ids."""

    def __init__(self, keys=None, n=None, ids=None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.n = np.zeros(0, np.int32) if n is None else n
        self.ids = np.zeros(0, np.uint32) if ids is None else ids
        self.start = np.cumsum(self.n, dtype=np.int64) - self.n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def take(self, at: np.ndarray) -> "WordTable":
        """The words at places in ascending order of key."""
        return WordTable(self.keys[at], self.n[at], gather(self.ids, self.start[at], self.n[at]))

    def plus(self, other: "WordTable") -> "WordTable":
        """Both tables' words; they share none."""
        keys, n = np.concatenate([self.keys, other.keys]), np.concatenate([self.n, other.n])
        start, ids = np.concatenate([self.start, other.start + len(self.ids)]), np.concatenate([self.ids, other.ids])
        order = np.argsort(keys, kind="stable")
        return WordTable(keys[order], n[order], gather(ids, start[order], n[order]))


def gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ids[start : start + n] one after another."""
    end = np.cumsum(n, dtype=np.int64)
    return ids[np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0)]


class WordEncoder:
    """Token ids of whole texts by a BPE tokenizer that never joins words across white space, with words remembered.

    Words are told apart by 64-bit hashes of their bytes, A-Z in lower case as the tokenizer itself takes them.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        self.pieces = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges, end_of_word_suffix=spec["end_of_word_suffix"], cache_capacity=0))
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(spec["vocab"].values()) + 1, bool)
        for token, i in spec["vocab"].items():
            self.ends[i] = token.endswith(spec["end_of_word_suffix"])
        self.remember = remember
        self.old, self.young = WordTable(), WordTable()

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and where each piece's begin (with the end of the last)."""
        found, size = [], []
        for lo in range(0, len(pieces), 1 << 14):
            part = pieces[lo : lo + (1 << 14)]
            lines = [" ".join(part[i : i + 512]) for i in range(0, len(part), 512)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.pieces.encode_batch_fast(lines, add_special_tokens=False)])
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                each = [self._exact(p) for p in part]
                ids, cut = np.concatenate(each), np.cumsum([len(x) for x in each])
            found.append(ids)
            size.append(np.diff(cut, prepend=0))
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *size]))])

    def _learn(self, keys: np.ndarray, words: list[str]) -> WordTable:
        """A table of words new to the encoder, in ascending order of key. Each word is split into pieces that are encoded once."""
        known: dict[str, int] = {}
        number, odd = lambda p: known.setdefault(p, len(known)), {}
        parts, count = [], np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            low = w.lower()
            m = _LETTERS.fullmatch(low)
            if m and (w.isascii() or _PLAIN.fullmatch(w)):
                mark = m[1]
                parts.append(number(low[:-1] if mark else low))
                count[k] = 1
                if mark:
                    parts.append(number(mark))
                    count[k] = 2
            elif _PLAIN.fullmatch(w):
                split = _PIECE.findall(low)
                parts += map(number, split)
                count[k] = len(split)
            else:
                odd[k] = self._exact(w)
        ids, cut = self._ids(list(known))
        parts = np.array(parts, np.int64)
        n = (cut[1:] - cut[:-1])[parts]
        flat = gather(ids, cut[:-1][parts], n)
        end = np.concatenate([[0], np.cumsum(n)])[np.cumsum(count)]
        size = np.diff(end, prepend=0)
        if odd:
            runs = np.split(flat, end)[:-1]
            for k, x in odd.items():
                runs[k], size[k] = x, len(x)
            flat = np.concatenate(runs)
        return WordTable(keys, size.astype(np.int32), flat)

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit integers; words new to the encoder are learnt together."""
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False)
        plain = pc.if_else(odd, "", texts)
        data, at = W.text_buffers(plain)
        hashes, places, bounds = W.word_places(data, at)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        old, young = self.old.find(keys), self.young.find(keys)
        new = np.flatnonzero((old < 0) & (young < 0))
        upto = np.append(places, len(data))
        raw = data.tobytes()
        words = [raw[a:b].rstrip(b" \t\n\v\f\r").decode("utf-8", "replace") for a, b in zip(places[first[new]].tolist(), upto[first[new] + 1].tolist(), strict=True)]
        learnt = self._learn(keys[new], words)
        # all different words of these texts in one table
        used = self.old.take(old[old >= 0]).plus(self.young.take(young[young >= 0])).plus(learnt)
        self.young = self.young.plus(learnt)
        if len(self.old.keys) + len(self.young.keys) > self.remember:  # what occurs again stays
            self.old, self.young = self.old.take(old[old >= 0]).plus(self.young.take(self.young.find(keys[young >= 0]))), WordTable()
        elif 4 * len(self.young.keys) > len(self.old.keys):
            self.old, self.young = self.old.plus(self.young), WordTable()
        ids = gather(used.ids, used.start[back], used.n[back]).astype("<u4", copy=False)
        end = np.concatenate([[0], np.cumsum(used.n[back], dtype=np.int64)])[bounds]
        out = [ids[a:b].tobytes() for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[k] = self._exact(texts[int(k)].as_py()).astype("<u4", copy=False).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))


def encoded(enc: WordEncoder, texts: pa.Array):
    """The ids of each text (null: none) in order, learning from a few megabytes at a time."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + AT_ONCE, "right")) - 1)
        yield from enc.encode_array(texts.slice(lo, hi - lo))
        lo = hi


def encoder(path: str) -> WordEncoder:
    worker.claim("tokens")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths, number of bins) that hold counts[length] items of each length.

    First the reduction: an item that fits with no other, with an exact partner, or whose best single partner provably
    dominates every other way to fill its bin is fixed with that partner for good, and the instance shrinks. What
    remains goes best-fit, longest first. The work depends on the number of different lengths only.
    """
    left = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        if length:
            left[length] += n
    bins: list[tuple[tuple[int, ...], int]] = []

    def fix(items: tuple[int, ...], n: int) -> None:
        bins.append((items, n))
        for x in items:
            left[x] -= n

    changed = True
    while changed:
        changed = False
        for a in range(capacity, 0, -1):
            while left[a] > 0:
                rest = capacity - a
                left[a] -= 1
                have = np.flatnonzero(left[: rest + 1])
                left[a] += 1
                if not len(have):
                    fix((a,), 1 if 2 * a <= capacity else int(left[a]))
                    changed = True
                    continue
                best = int(have[-1])
                low = np.repeat(have[:3], np.minimum(left[have[:3]] - (have[:3] == a), 3))[:3]
                pairs_fit = len(low) > 1 and low[0] + low[1] <= rest
                if best != rest and pairs_fit:
                    if len(low) > 2 and low[:3].sum() <= rest:
                        break
                    other = have[np.searchsorted(have, rest - have, "right") - 1]
                    real = (have <= other) | (other >= have[0])
                    if (have + other)[real & (have + other <= rest)].max(initial=0) > best:
                        break
                n = int(left[a] // 2 if best == a else min(left[a], left[best]))
                fix((a, best), n)
                changed = True
    open_: list[list] = []  # [room, items, number of bins], by room
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            k = next((i for i, b in enumerate(open_) if b[0] >= a), None)
            if k is None:
                fit = capacity // a
                if n >= fit:
                    new, m = [capacity - fit * a, (a,) * fit, n // fit], fit * (n // fit)
                else:
                    new, m = [capacity - n * a, (a,) * n, 1], n
            else:
                room, items, number = open_.pop(k)
                fit = min(room // a, n)
                m = fit * min(number, n // fit)
                new = [room - fit * a, items + (a,) * fit, m // fit]
                if number > m // fit:
                    open_.append([room, items, number - m // fit])
            open_.append(new)
            open_.sort(key=lambda b: b[0])
            n -= m
    return bins + [(items, number) for _, items, number in open_]


def _slots(bins: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[list, list]]:
    """For each length: the first ranks of its runs, and for each run (first sequence, step, offset, copies per bin)."""
    out: dict[int, tuple[list, list]] = {}
    seen: dict[int, int] = {}
    first = 0
    for items, number in bins:
        at = 0
        for x in items:
            starts, runs = out.setdefault(x, ([], []))
            starts.append(seen.get(x, 0))
            runs.append((first, at))
            seen[x] = seen.get(x, 0) + number
            at += x
        first += number
    return out


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32, part, place (its rank in part among equal lengths)."""
    path = tokenizer_path(tokenizer)

    def go(batches):
        enc, tail = encoder(path), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(enc, batch.column("text")), strict=True):
                ids += tail
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[lo : lo + 4 * capacity]
                    n = len(one) // 4
                    out.append((doc, k, lo // 4, n, zlib.crc32(one), part, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "place")
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(go, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text; others ignored).

    Null and empty texts are the end token alone. Documents longer than capacity are cut into full pieces and a rest.
    Texts of any length count whole. Repeated rows are packed each for itself; an empty table gives no rows; a null doc_id is kept. The driver holds one
    count for each length (capacity numbers at most) and the bin patterns made from them.
    """
    pieces = stash(token_pieces(docs, tokenizer, capacity), "pieces")
    per = pieces.groupBy("part", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = stash(per.withColumn("base", F.coalesce(before, F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = _slots(plan(counts, capacity), capacity)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_pylist() for c in ("length", "rank"))
            seq, off = [], []
            for n, r in zip(length, rank, strict=True):
                starts, runs = slots[n]
                k = bisect_right(starts, r) - 1
                first, at = runs[k]
                seq.append(first + r - starts[k])
                off.append(at)
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(per.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
