import random

import pytest

from pyspark.sql import types as T

from talus.llm import lines

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pos", T.StringType())])


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:])


def brute(rows):
    seen, out = [], {}
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        kept, all_ = [], text.split("\n")
        for line in all_:
            w = line.lower().split()  # as the operator: ASCII white space
            if not w:
                kept.append(line)
                continue
            # near copies: one word edit, which is at most an eighth of the longer line's words
            if not any(w == o or (max(len(w), len(o)) >= 8 and distance_at_most_one(w, o)) for o in seen):
                kept.append(line)
            seen.append(w)
        out[i] = ("\n".join(kept), len(all_), len(all_) - len(kept))
    return out


@pytest.mark.parametrize("seed, first", [(3, -40), (4, 0), (5, 2**62), (6, 7)])
def test_equals_brute_force(spark, seed, first):
    """With ids that leave room for places in a long, and ids that don't."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.choice([1, 2, 3])))
    pool = [" ".join(word() for _ in range(r.choice([1, 3, 7, 8, 9, 15, 40]))) for _ in range(40)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(r.randint(0, 9)):
            w = r.choice(pool).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                j = r.randrange(len(w))
                w[j : j + r.choice([0, 1, 1])] = r.choice([[], [word()], [word().upper()]])
                w = w or ["x"]
            text.append(r.choice(["  ".join(w), " ".join(w)]) if r.random() < 0.9 else " ")
        rows.append((k * 3 + first, "\n".join(text), "clash"))
    rows += [] if first == 7 else [(None, pool[5] + "\n" + pool[6], None), (1000, None, "x"), (1001, "", "x"), (1002, pool[5], "x"), (1003, ("long words in a row " * 900).strip() + " end\nlast", "x"), (1004, ("long words in a row " * 900).strip() + " fin", "x")]
    out = lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {o.doc_id: (o.text, o.n_lines, o.n_removed) for o in out} == brute(rows)
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "pos", "n_lines", "n_removed"}


def test_empty(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_share_an_id_stay_apart(spark):
    rows = [(1, "copy", "a"), (5, "zz\ncopy", "b"), (5, "zz\nunique line here", "c"), (None, "one\ncopy", "d"), (None, "two", "e"), (7, "two", "f"), (8, "same\n\nrow", "g"), (8, "same\n\nrow", "g")]
    out = sorted((o.pos, o.text, o.n_lines, o.n_removed) for o in lines.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert [o for o in out if o[0] in "adef"] == [("a", "", 1, 1), ("d", "one\ncopy", 2, 0), ("e", "two", 1, 0), ("f", "", 1, 1)]
    assert sorted(o[1:] for o in out if o[0] in "bc") in ([("unique line here", 2, 1), ("zz", 2, 1)], [("", 2, 2), ("zz\nunique line here", 2, 0)])
    assert sorted(o[1:] for o in out if o[0] == "g") == [("", 3, 2), ("same\n\nrow", 3, 0)]


def test_seven_words_beside_eight(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f z", "x"), (3, "a b c d e f g h", "x")]
    out = {o.doc_id: o.text for o in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: "a b c d e f g", 2: "a b c d e f z", 3: ""}


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x\ny", 3, "k", 9)], "doc_id long, text string, doc int, _doc string, _all int")
    assert lines.dedup(df).first().asDict() == {"doc_id": 1, "text": "x\ny", "doc": 3, "_doc": "k", "_all": 9, "n_lines": 2, "n_removed": 0}
