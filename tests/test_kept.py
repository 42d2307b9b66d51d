"""The kept structures against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from talus.operators import classes, index, names, nearest, phrases
from talus.sources import keyed
from talus.sources.scratch import fresh_path


def zipf(r, n):
    return min(int(r.paretovariate(0.7)), n)


@pytest.mark.parametrize(("seed", "k", "most"), [(1, 5, 1), (2, 3, 9), (3, 40, 4)])
def test_index_equals_scoring_all_rows(spark, monkeypatch, seed, k, most):
    monkeypatch.setattr(index, "BITS", 4)  # blocks of 16 postings, so frequent terms have many
    r = random.Random(seed)
    docs = {i: {f"t{zipf(r, 400)}": r.randint(1, most) for _ in range(r.choice([2, 8, 20]))} for i in range(1500)}
    asked = {q: {f"t{zipf(r, 450)}": r.randint(1, 3) for _ in range(r.choice([1, 3, 8]))} for q in range(25)} | {99: {"absent": 1}}
    kept = index.build(spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()] + [(None, "t1", 1), (4000, None, 1)], "id long, term string, w int"))
    q = spark.createDataFrame([(i, t, w) for i, d in asked.items() for t, w in d.items()], "query_id long, term string, weight int")
    want = {}
    for i, d in asked.items():
        s = {x: sum(w * docs[x].get(t, 0) for t, w in d.items()) for x in docs}
        want[i] = sorted(((-v, x) for x, v in s.items() if v))[:k]
    got = defaultdict(list)
    for x in index.top_k(kept, q, k).orderBy("query_id", "rank").collect():
        got[x.query_id].append((-x.score, x.id))
    assert dict(got) == {i: v for i, v in want.items() if v}
    read = index.reads(kept, q, k).agg(F.sum("n_read").alias("a"), F.sum("n_all").alias("b")).first()
    assert k > 5 or read["a"] < read["b"]
    assert kept.blocks.agg(F.max("n")).first()[0] <= 16
    all_ = {(x.query_id, x.term, x.id) for x in index.look_up(kept, q).collect()}
    assert all_ == {(i, t, x) for i, d in asked.items() for t in d for x in docs if t in docs[x]}


def test_index_reads_few_postings_of_frequent_terms(spark):
    r = random.Random(5)
    rows = [(i, "every", 1) for i in range(20_000)] + [(i, f"rare{i % 500}", 1) for i in range(20_000)]
    kept = index.build(spark.createDataFrame(rows, "id long, term string, w int"))
    q = spark.createDataFrame([(i, t, 1) for i in range(10) for t in ("every", f"rare{i}")], "query_id long, term string, weight int")
    read = index.reads(kept, q, 10).agg(F.sum("n_read").alias("a"), F.sum("n_all").alias("b")).first()
    assert read["b"] == 10 * 20_040 and read["a"] <= 10 * (2 * 40 + 4096)
    assert [x.id for x in index.top_k(kept, q.where("query_id = 3"), 10).orderBy("rank").collect()] == [3 + 500 * k for k in range(10)]
    assert index.top_k(kept, q.limit(0), 10).count() == 0 and r


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_lexicon_of_ten_thousand_keys(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "KEYS", block if block > 1000 else 40_000)
    r = random.Random(7)
    letters = "abcdé "
    keys = [(i, "".join(r.choice(letters) for _ in range(r.choice([1, 3, 6, 9, 14])))) for i in range(10_000)] + [(10_000, None), (10_001, ""), (10_002, "zz"), (10_003, "zz")]
    texts = [(i, "".join(r.choice(letters + "z\n") for _ in range(r.choice([0, 5, 255, 256, 257, 1000])))) for i in range(60)] + [(900, None), (901, "x" * 3000 + keys[4][1])]
    rows, lex = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(keys, "ordinal long, key string")
    want = {(i, k) for i, t in texts for k, key in keys if key and t and key in t}
    got = [tuple(x) for x in phrases.held_keys(rows, F.col("t"), lex).collect()]
    assert set(got) == want and len(got) == len(want)
    longest = {}
    for i, k in sorted(want, key=lambda x: (-len(keys[x[1]][1]), x[1])):
        longest.setdefault(i, k)
    assert {x.id: x.ordinal for x in phrases.longest_key(rows, F.col("t"), lex).collect()} == longest
    short = spark.createDataFrame([(0, "abc"), (1, "abcde"), (2, ""), (3, None), (4, "q")], "id long, t string")
    one = spark.createDataFrame([(7, "bc"), (8, "xxabcdexx"), (9, "")], "ordinal long, key string")
    assert sorted(map(tuple, phrases.either_holds(short, F.col("t"), one).collect())) == [(0, 7), (0, 8), (1, 7), (1, 8)]


@pytest.mark.parametrize(("seed", "pivots"), [(1, 4), (2, 30)])
def test_nearest_equals_all_pairs(spark, monkeypatch, seed, pivots):
    monkeypatch.setattr(nearest, "ROWS", 50)
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    data = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for i in range(600)] + [(600, [0.0] * 6), (601, None), (602, [1.0] * 6), (603, [1.0] * 6), (604, [2.0] * 6)]
    v = spark.createDataFrame(data, "id long, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = set()
    for i, a in data:
        if i % 20 == 0 and a and any(a):
            s = sorted((-round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 5), j) for j, b in data if j != i and b and any(b))
            want |= {(i, j, -c, k + 1) for k, (c, j) in enumerate(s[:7])}
    got = {tuple(x) for x in nearest.top_k(v, v.where("id % 20 = 0"), 7, pivots).collect()}
    assert got == want
    assert nearest.share_compared(v, v.where("id % 20 = 0"), 7, pivots) < 0.7
    assert nearest.top_k(v.limit(0), v, 3).count() == 0


def test_no_gram_group_is_large(spark, monkeypatch):
    """Names that share their common grams meet by the rare ones, far fewer times than they have grams in common."""
    r = random.Random(3)
    data = [(i, f"professor {''.join(r.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(9))}") for i in range(700)]
    rows, listed = spark.createDataFrame(data, "id long, key string"), spark.createDataFrame(data, "ordinal long, key string")
    assert names.like_pairs(rows, listed).count() < 700 * 700 / 10
    assert {(x.id, x.ordinal) for x in names.like_names(rows, listed).collect()} >= {(i, i) for i in range(700)}


def test_merge_rewrites_only_what_is_hit(spark):
    path = fresh_path(spark, "t")
    old = spark.createDataFrame([(k, f"v{k}", 1) for k in range(200)], "k long, v string, n int")
    keyed.create(old, path, ["k"], 32)
    before = {(x.bucket, x.file) for x in keyed.files(spark, path).collect()}
    new = spark.createDataFrame([(3, "a", 1, 1), (3, "b", 1, 2), (3, "", 1, 9), (500, "c", 1, 1), (4, "", 1, 1)], "k long, v string, n int, at int")
    refused, hit = keyed.merge(new, path, ["k"], 32, [F.col("at")], F.col("v") != "", {"n": F.col("old.n") + 1})
    after = {(x.bucket, x.file) for x in keyed.files(spark, path).collect()}
    assert refused == 2 and len(hit) <= 2
    assert {x for x in before if x[0] not in hit} == {x for x in after if x[0] not in hit} and not {x for x in before & after if x[0] in hit}
    got = {x.k: (x.v, x.n) for x in keyed.read(spark, path).collect()}
    assert got == {k: (f"v{k}", 1) for k in range(200)} | {3: ("b", 2), 500: ("c", 1)}
    with pytest.raises(Exception):  # noqa: B017
        keyed.merge(new.withColumn("v", F.expr("element_at(array(v), k + 2)")), path, ["k"], 32, [F.col("at")], F.col("v") != "")
    assert {x.k: (x.v, x.n) for x in keyed.read(spark, path).collect()} == got
    assert keyed.merge(new.where("v = ''"), path, ["k"], 32, [F.col("at")], F.col("v") != "") == (2, [])


def test_seeds_go_on_behind_a_short_first_block(spark):
    """A term's first block may hold few of its postings; the k-th score comes from as many rows as are asked for all the same."""
    rows = [(i, "every", 1) for i in range(5000)] + [(i, "rare", 1) for i in range(40)]
    kept = index.build(spark.createDataFrame(rows, "id long, term string, w int").repartition(1))
    # the first two of the rare term's postings lie in a block of their own
    cut = lambda df: df.withColumn("block", F.when((F.col("term") == "rare") & (F.col("id") >= 2), 1 << 40).when(F.col("term") == "rare", 1 << 39).otherwise(F.col("block")))
    postings = cut(kept.postings)
    blocks = postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("w").alias("high"))
    kept = index.Index(kept.terms, blocks, postings, kept.forward)
    q = spark.createDataFrame([(7, "every", 1), (7, "rare", 1)], "query_id long, term string, weight int")
    read = index.plan(kept, q, 10)
    assert {r.term for r in read.where("not seed").collect()} == {"rare"} and {r.n for r in read.where("seed and term = 'rare'").collect()} == {2, 38}
    assert [(x.id, x.score) for x in index.top_k(kept, q, 10).orderBy("rank").collect()] == [(i, 2.0) for i in range(10)]


def test_long_tables_are_joined_by_sorting(spark, monkeypatch):
    """Files of equal values are far shorter than their rows: what is asked must not go whole to all tasks by the files' size."""
    monkeypatch.setattr(classes, "SHORT", 50)
    kept = index.build(spark.createDataFrame([(i, "a", 1) for i in range(100)] + [(i, "b", 2) for i in range(5)], "id long, term string, w int"))
    q = spark.createDataFrame([(i, t, 1) for i in range(100) for t in "ab"], "query_id long, term string, weight int")
    got = index.top_k(kept, q, 3)
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in got.collect()} == {(i, k, 3.0, k + 1) for i in range(100) for k in range(3)}
