import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import types as T

from talus.llm import langid

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("score", T.StringType()))])
WORDS = {"en": "the of and that with thing which there", "de": "der und nicht über schön heit ungen zwischen", "fr": "le les été où être avec nation élève"}


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(4)
    rows = []
    for k in range(300):
        lang = r.choice(list(WORDS))
        rows.append((k, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 60))), lang if k % 7 else None, "x"))
    truth = {k: next(l for l, w in WORDS.items() if t.split()[0] in w.split()) for k, t, _, _ in rows}
    rows += [(900, None, "en", "x"), (901, "", "en", None), (902, "12 *** 3", "de", "x"), (None, "the thing", None, "x"), (903, "the of and " * 600_000, None, "x")]
    out = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {o.doc_id: o for o in out}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902))
    assert by[903].lang_pred == "en" and by[None].lang_pred == "en"
    assert all(o.held_out == (zlib.crc32(str(o.doc_id).encode()) % 5 == 0) for o in out if o.doc_id is not None)
    assert sum(by[k].lang_pred == truth[k] for k in truth) >= 0.97 * len(truth)
    assert all(0 <= o.score <= 1 for o in out)
    kept = {r.doc_id for r in langid.known_language(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept & {900, 901, 902} and len(kept & set(truth)) >= 0.97 * len(truth)


def test_nothing_to_learn_from(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    out = langid.identify(spark.createDataFrame([(1, "some text", None, None)], SCHEMA)).collect()
    assert [(o.lang_pred, o.score) for o in out] == [("und", 0.0)]


def test_ftrl_equals_plain_loops():
    """The same training one coordinate at a time, from the published update rule."""
    r = random.Random(8)
    rows = [(r.randrange(3), np.array(sorted(r.sample(range(langid.DIM), 5))), np.array([r.random() for _ in range(5)])) for _ in range(30)]
    rows += [(y, at, x * 2) for y, at, x in rows[:10]]
    z, n = {}, {}

    def weight(i, k):
        zz, penalty = z.get((i, k), 0.0), 0.0 if i == langid.DIM else langid.L1
        if abs(zz) <= penalty:
            return 0.0
        return -(zz - math.copysign(penalty, zz)) / ((langid.BETA + math.sqrt(n.get((i, k), 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for y, at, x in rows:
            one = [*zip(at.tolist(), x.tolist()), (langid.DIM, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in one for k in range(3)}
            score = [sum(v * w[i, k] for i, v in one) for k in range(3)]
            total = sum(math.exp(s - max(score)) for s in score)
            for i, v in one:
                for k in range(3):
                    g = v * (math.exp(score[k] - max(score)) / total - (k == y))
                    old = n.get((i, k), 0.0)
                    n[i, k] = old + g * g
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(n[i, k]) - math.sqrt(old)) / langid.ALPHA * w[i, k]
    got = langid.ftrl(rows, 3)
    for i in {langid.DIM, *(int(i) for _, at, _ in rows for i in at)}:
        assert got[i] == pytest.approx([weight(i, k) for k in range(3)], abs=1e-9)
    assert np.count_nonzero(got) <= 3 * (1 + len({int(i) for _, at, _ in rows for i in at}))


def plain_grams(text):
    """Letter n-grams of a text as strings: lower case, other characters as one space, a space at both ends."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = " ".join(s.split(" ")) if "  " not in s else re.sub(" +", " ", s)
    return [s[k : k + n] for n in langid.ORDERS for k in range(len(s) - n + 1)]


def test_features_and_frequencies_equal_plain_loops(spark):
    texts = ["The cat, the DOG!", "a", "12 x 3", "été où naïve", "the the the", "zwischen  schön\nheit"]
    hashed = [Counter(h for g in langid.grams(t) for h in g.tolist()) for t in texts]
    named = [Counter(plain_grams(t)) for t in texts]
    one = {}
    for h, g in zip(hashed, named):
        assert sorted(h.values()) == sorted(g.values())  # as many different grams, as often each
    for t in texts:
        for g in plain_grams(t):
            one.setdefault(g, set()).add(t)
    df, total = langid.document_frequency(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert total == len(texts) and sorted(df[df > 0].tolist()) == sorted(len(x) for x in one.values())


def test_sample_is_the_least_hashed_rows(spark):
    rows = [(k, f"text {k}", "ab"[k % 7 == 0], None) for k in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for o in langid.least_hashed(docs, 40).collect():
        got.setdefault(o.lang, set()).add(o.order)
    every = docs.selectExpr("xxhash64(doc_id, text) as o", "lang").collect()
    assert got == {k: set(sorted(o.o for o in every if o.lang == k)[:40]) for k in "ab"}
    assert langid.least_hashed(docs, 1000).where("lang = 'b'").count() == 429
