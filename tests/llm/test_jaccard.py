import random

import pytest
from pyspark.sql import types as T

from talus.llm import jaccard

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType())])


def brute(rows):
    sets = {}
    for i, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    up[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.choice([2, 3, 5])))
    common = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "a b c d", "A b\tc D", "a b c d e", "É x y z w"]
    for _ in range(60):
        base = [word() for _ in range(r.choice([6, 9, 14, 30, 80, 300]))]
        if r.random() < 0.4:
            base += common
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 2, 40 if r.random() < 0.1 else 1])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: r.choice([len(copy), len(copy), len(copy) - 2])]))
    r.shuffle(texts)
    return [(7 * k + 3, t, "x") for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_groups(spark.createDataFrame(rows, SCHEMA), hot=2 if seed == 2 else 24).collect()}
    assert got == brute(rows)


def test_links_across_the_tiny_bound(spark):
    r, rows = random.Random(3), []
    for _ in range(20):
        for short, more in ((12, 1), (12, 2), (11, 2), (13, 1)):
            base = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(short + more)]
            rows += [(len(rows), " ".join(base), "x"), (len(rows) + 1, " ".join(base[:short]), "x")]
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert all(i % 2 == 0 or c == i - 1 for i, (_, c) in got.items())


def test_first_of_groups(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from it all"
    rows = [(4, text, "a"), (2, text.upper(), "b"), (9, None, "c"), (9, None, "c"), (1, "other", None)]
    out = jaccard.first_of_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n) for r in out) == [(1, None), (2, "b"), (9, "c"), (9, "c")]


def test_rows_that_share_an_id_stay_apart(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from it all"
    rows = [(None, "one text that nobody has but this row", "a"), (None, "another of them", "b"), (5, "a third", "c"), (5, "and a fourth one", "d"), (6, text, "e"), (6, text, "e"), (3, text, "f"), (4, " ", "g")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(r.n for r in jaccard.first_of_groups(df).collect()) == ["a", "b", "c", "d", "f", "g"]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(df).collect()), key=str)
    assert got == sorted([(None, 4, None), (None, 1, None), (5, 1, 5), (5, 1, 5), (6, 12, 3), (6, 12, 3), (3, 12, 3), (4, 0, 4)], key=str)


def test_empty_table(spark):
    assert jaccard.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_credits_cover_the_need():
    for n in (9, 20, 100, 560, 3000):
        for _, _, bound in jaccard.tables_of(n):
            m, q = jaccard.segments(*bound)
            assert 1 <= m and 0 <= q <= m
            assert jaccard.needed(n, *bound) >= 1
