import random

import numpy as np
import pytest
from pyspark.sql import types as T

from talus.llm import minhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("N", T.StringType())])


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()


def brute(rows):
    """By place of the row, in order of doc_id."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                up[b] = a
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0], find(i) == i) for i in range(len(rows))}


def corpus(seed, copies=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.choice([2, 3, 5])))
    common = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "a b", "A\tb", "a b c d e f", "a b c d e", "É x y z w"]
    for _ in range(50):
        base = [word() for _ in range(r.choice([5, 6, 9, 14, 30, 80, 300]))]
        if r.random() < 0.5:
            base += common
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 1, copies])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: r.choice([len(copy), len(copy), len(copy) - 1])]))
    r.shuffle(texts)
    return [(3 * k + 1, t, "x", "y") for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"hot": 2, "block": 4}), (3, {"hot": 1, "block": 3})])
def test_components_equal_brute_force(spark, seed, how):
    rows = corpus(seed, copies=30)
    got = {r[0]: tuple(r)[1:] for r in minhash.near_groups(spark.createDataFrame(rows, SCHEMA), **how).collect()}
    assert got == brute(rows)


def test_all_pairs_below_the_distance_share_a_key():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, (400, minhash.POSITIONS), dtype=np.uint16)
    other = base.copy()
    bound = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for i in range(400):  # the hardest case: the errors are dealt evenly over the chunks
        at = rng.permutation(minhash.POSITIONS)[:bound] if i % 2 else np.concatenate([c * minhash.WIDE + rng.permutation(minhash.WIDE)[:2] for c in range(minhash.CHUNKS)])[:bound]
        other[i, at] ^= np.uint16(1 + i)
    assert (np.diag(minhash.distances(base, other)) == bound).all()
    assert all(np.intersect1d(a, b).size for a, b in zip(minhash.keys_of(base), minhash.keys_of(other), strict=True))


def test_links_at_the_bound_share_a_key():
    """Sets of similarity 0.8 exactly, the least that links."""
    rng = np.random.default_rng(6)
    missed = far = 0
    for _ in range(60):
        sets = []
        for _ in range(50):
            x = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
            sets += [x[:81], np.concatenate([x[:72], x[81:90]])]
        m = minhash.minima(sets)
        keys = minhash.keys_of(m)
        missed += sum(not np.intersect1d(keys[i], keys[i + 1]).size for i in range(0, 100, 2))
        far += int(((m[::2] != m[1::2]).sum(1) > minhash.FAR).sum())
    assert (missed, far) == (0, 0)  # of 3000


def test_no_link_is_ruled_out():
    rng = np.random.default_rng(9)
    for n in (1, 4, 9, 40, 300, 5000):
        for both in {0, 1, n // 2, -(-8 * n // 9), n}:
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            m = minhash.marks([np.sort(x[:n]), np.sort(x[n - both :])])
            links = 100 * both >= 80 * (2 * n - both)
            assert minhash.may_link(m[:1], m[1:], 80)[0] or not links
    a, b = (minhash.marks([x[:300]]) for x in (rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in "ab"))
    assert not minhash.may_link(a, b, 80)[0]


def test_repeats_nulls_and_first_of_groups(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "a", ""), (4, text, "b", ""), (4, text, "c", ""), (4, "other words altogether here", "d", ""), (5, None, "e", ""), (5, "", "f", ""), (6, text.upper(), "g", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, (tuple(r) for r in minhash.near_groups(df).collect())))
    assert got == sorted(map(str, [(None, 6, None, True), (4, 6, None, False), (4, 6, None, False), (4, 3, 4, True), (5, 0, 5, True), (5, 0, 5, True), (6, 6, None, False)]))
    assert sorted(r["row"] for r in minhash.first_of_groups(df).collect()) == ["a", "d", "e", "f"]
    assert minhash.near_groups(df.limit(0)).count() == 0
    assert minhash.first_of_groups(df.limit(0)).columns == df.columns


def test_very_long_text(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(120_000)]
    rows = [(1, " ".join(words), "", ""), (2, " ".join(words[:-9000]), "", ""), (3, " ".join(words[60_000:]), "", "")]
    got = {x[0]: tuple(x)[1:] for x in minhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
