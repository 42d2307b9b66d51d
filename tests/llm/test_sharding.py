import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

from talus.llm import sharding

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("h", T.LongType())])


def check(spark, rows, shards=24):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sharding.shard_by_bytes(df, shards).collect()
    want = Counter((i, t, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((g.doc_id, g.text, g["size"], g.text_crc32) for g in got) == want
    slots, held = defaultdict(list), Counter()
    for g in got:
        slots[g.shard].append(g.slot)
        held[g.shard] += g["size"]
    assert all(g.h == 1 for g in got)  # a column of a name that is used inside
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return got, [held[k] for k in range(shards)]


def test_shards_are_near_equal_and_copies_adjacent(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 300) + str(i)) for i in range(2000)] + [(5000 + i, "the same text " * 10) for i in range(1000)]
    got, held = check(spark, rows)
    share = sum(held) / 24
    assert max(abs(h - share) for h in held) <= 400
    mine = sorted({g.shard for g in got if g.doc_id >= 5000})
    assert mine == list(range(mine[0], mine[-1] + 1)) and len(mine) <= 1000 * 148 / share + 2


def test_splitters_equal_a_sort_of_all_rows(spark):
    """Shards are runs of all rows in order of text hash and doc_id, cut where the bytes before come nearest to each share."""
    r = random.Random(2)
    rows = [(i, "y" * r.choice([0, 5, 50, 2000]) + str(i % 700)) for i in range(3000)]
    got, held = check(spark, rows)
    at = {(o.doc_id, o.text): o.h for o in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(cast(text as binary)) as h").collect()}
    order = sorted(got, key=lambda g: (at[g.doc_id, g.text], g.doc_id))
    assert [(g.shard, g.slot) for g in order] == sorted((g.shard, g.slot) for g in got)
    total, below = sum(held), 0
    cuts = [0]
    for g in order:
        below += g["size"]
        cuts.append(below)
    for k in range(23):
        want = total * (k + 1) / 24
        nearest = min(abs(c - want) for c in cuts)
        assert abs(sum(held[: k + 1]) - want) <= max(nearest, 0.0005 * total / 24) + 1


def test_nulls_ties_repeats_and_few_rows(spark):
    check(spark, [(None, None), (None, "a"), (1, ""), (1, ""), (2, "z" * 100_000), (2, "é")])
    check(spark, [(1, "a")] * 50, shards=4)


def test_empty(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
