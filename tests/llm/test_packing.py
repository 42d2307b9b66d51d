import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from talus.llm import packing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])


def fits(bins, counts, capacity):
    held = Counter()
    for items, n in bins:
        assert sum(items) <= capacity and n > 0
        for x in items:
            held[x] += n
    assert held == Counter({k: v for k, v in counts.items() if k and v})
    return sum(n for _, n in bins)


def least_bins(items, capacity):
    """Exact, by depth-first search over small instances."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= items[k]:
                rooms[i] -= items[k]
                go(k + 1, rooms)
                rooms[i] += items[k]
        rooms.append(capacity - items[k])
        go(k + 1, rooms)
        rooms.pop()

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_valid_and_near_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([20, 50])
    items = [r.randint(1, capacity) for _ in range(r.randint(0, 10))]
    got = fits(packing.plan(Counter(items), capacity), Counter(items), capacity)
    best = least_bins(items, capacity)
    assert best <= got <= best + (best > 4)


def test_plan_of_many_items_has_few_patterns():
    r = random.Random(3)
    counts = Counter(min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(200_000))
    bins = packing.plan(counts)
    used = fits(bins, counts, 2048)
    assert used <= 1.003 * sum(k * v for k, v in counts.items()) / 2048 + 1
    assert len(bins) < 8 * 2048


TEXTS = [None, "", "  ", "It's a test of 12 THINGS, isn't it?", "naïve Éclair ça-va $$$ x", "İstanbul ΣΑΣ ½ x²", "a\x1cb <|endoftext|> c", "snow ☃ man", "éa", "don't 'd 's _x_ 3.5"]


def test_ids_equal_the_tokenizer():
    enc = packing.WordEncoder(packing.tokenizer_path())
    for t in TEXTS:
        want = enc.whole.encode(t or "", add_special_tokens=False).ids
        for _ in range(2):
            assert np.frombuffer(enc.encode([t or ""])[0], "<u4").tolist() == want


def test_pack(spark):
    r = random.Random(5)
    texts = TEXTS + [" ".join(r.choice(["alpha", "beta,", "Gamma", "12"]) for _ in range(r.choice([3, 300, 3000, 9000]))) for _ in range(40)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "null id", None), (5, texts[5], "x")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    enc = packing.WordEncoder(packing.tokenizer_path())
    want = Counter()
    for i, t, _ in rows:
        ids = [*enc.whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            one = np.array(ids[k : k + 2048], "<u4")
            want[i, k // 2048, k, len(one), zlib.crc32(one.tobytes())] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    places = defaultdict(list)
    for g in got:
        places[g.sequence_id].append((g.offset, g.length))
    for p in places.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
        assert at <= 2048


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
