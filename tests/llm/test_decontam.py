import math
import random
from collections import Counter

import pytest

from pyspark.sql import types as T

from talus.llm import decontam

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def brute(docs, items):
    """Best weighted likeness over all windows of an item's size."""
    cut = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    had = [(j, (t or "").lower().split()) for j, t in dict.fromkeys((i[0], i[1]) for i in items) if t is not None]
    df = Counter(s for _, p in had for s in (cut(p) if len(p) >= 5 else ()))
    out = {}
    for i, text, _ in docs:
        w = (text or "").lower().split()
        for j, p in had:
            if not p or not w:
                continue
            weight = {s: math.log1p(len(had) / df[s]) for s in cut(p)} if len(p) >= 5 else {}
            for k in range(max(1, len(w) - len(p) + 1)):
                a = cut(w[k : k + len(p)])
                if len(p) < 5:
                    got = float(w[k : k + len(p)] == p)
                else:
                    got = sum(weight[s] for s in a & set(weight)) / (sum(weight.values()) + math.log1p(len(had)) * len(a - set(weight)))
                if got >= 0.75 - 1e-9 and got > out.get((i, j), (0, 0))[0] + 1e-12:
                    out[i, j] = (got, k)
    return out


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(r.randint(14, 59))), "x") for k in range(12)] + [(90, "tiny one", "x"), (91, None, "x"), (92, " ", None)]
    common = items[0][1].split()[:9]  # shingles that several items have weigh less
    items += [(20 + k, " ".join(common + [word() for _ in range(12 + k)]), "x") for k in range(4)]
    docs = [(None, items[0][1], "n"), (500, None, "x"), (501, "", "x"), (502, "some Tiny\tONE here", "x"), (502, "some Tiny\tONE here", "x"), (503, "tiny", "x")]
    for k in range(60):
        body = [word() for _ in range(r.choice([3, 40, 400]))]
        if k % 2:
            p = items[r.choice([*range(12), 15, 16, 17, 18])][1].split()
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                p[r.randrange(len(p))] = word()
            for _ in range(r.choice([0, 0, 1, 2])):
                del p[r.randrange(len(p))]
            for _ in range(r.choice([0, 0, 1, 2])):
                p.insert(r.randrange(len(p)), word())
            at = r.randint(0, len(body))
            body[at:at] = [x.upper() for x in p]
        docs.append((k, "\n ".join(body), "x"))
    docs.append((700, " ".join(word() for _ in range(60_000)) + " " + items[3][1], "x"))
    leaks = decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = {(g.doc_id, g.item_id): (round(g.similarity, 9), g.start_word) for g in leaks}
    want = {k: (round(x, 9), a) for k, (x, a) in brute([d for d in docs if d[0] != 700], items).items()}
    assert got.pop((700, 3)) == (1.0, 60_000)
    assert got == want and len(got) == len(leaks) - 1


def test_rows_that_share_an_id_stay_apart(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = [(None, passage, "a"), (None, "clean", "b"), (5, "so is this", "c"), (5, "x " + passage, "d"), (6, None, "e"), (7, "clean", "f"), (7, "clean", "f")]
    kept = decontam.without_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, passage, "x")], ITEMS)).collect()
    assert sorted(k.item_id for k in kept) == ["b", "c", "e", "f", "f"]


def test_empty(spark):
    assert decontam.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert decontam.leaks(spark.createDataFrame([(1, "a", "b")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_recall_of_the_radius():
    """Of planted passages whose best item-sized window passes, with substitutions, insertions and deletions, none is lost."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(r.randint(20, 60))), "") for k in range(20)]
    held = decontam.Items([i[0] for i in items], [i[1] for i in items])
    passed = lost = 0
    for _ in range(400):
        k = r.randrange(20)
        p = items[k][1].split()
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(p))
            p[at : at + r.choice([0, 1, 1, 3])] = [word() for _ in range(r.choice([0, 1, 1, 2]))]
        text = " ".join([word() for _ in range(30)] + p + [word() for _ in range(30)])
        want = {j for _, j in brute([(0, text, "")], items)}
        h, b = decontam.W.word_hashes(*decontam.W.text_buffers(decontam.pa.array([text])))
        shingles, cut = decontam.W.shingle_hashes(h, b)
        got = {k for _, had in held.candidates(shingles, cut) for k in held.scan(h, shingles, had)}
        passed += len(want)
        lost += len(want - got)
        assert got <= want
    assert passed > 100 and lost == 0
