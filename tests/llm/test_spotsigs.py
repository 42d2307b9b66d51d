import hashlib
import random

from pyspark.sql import types as T

from talus.llm import spotsigs

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("s", T.StringType())])


def chains(text):
    """Signatures as tuples: (anchor, three content words)."""
    import re

    t = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    out, c = set(), [(w, t[k - 1] if k else None, k == 0 or t[k - 1] in anchors) for k, w in enumerate(t) if w not in anchors]
    inner = any(starts and before is not None for _, before, starts in c)
    for k, (w, before, starts) in enumerate(c):
        if starts or not inner:  # without an inner anchor all chains count
            out.add((before if inner else None, w, *[x[0] for x in c[k + 1 : k + 3]]))
    return out or {("whole", *t) if t else ("raw", text)}


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(1)
    vocab = spotsigs.ANCHORS[:20] + [f"w{k}é" for k in range(30)]
    rows = [(k * 5 - 20, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 40]))) + r.choice(["", "!", "…"]), "x") for k in range(40)]
    rows += [(None, "the one of them", None), (1000, None, "x"), (1001, "the and of", "x"), (1001, "the and of", "x"), (1002, " * ", "x"), (1003, "the word " * 40_000, "x")]
    rows += [(2000 + k, " ".join(f"cell{k % 2}{j}" for j in range(30)) + f" end{k}", "x") for k in range(4)]  # no anchors at all
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want = []
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        j = lambda a, b: round(len(chains(a) & chains(b)) / len(chains(a) | chains(b)), 6)
        want.append((i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), j(t, e), j(t, nxt)))
    got = spotsigs.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((g.doc_id or 0, g.n_chars, g.edited_sha256, round(g.near_edited, 6), round(g.near_next, 6)) for g in got) == sorted(want)
    by = {}
    for g in got:
        by.setdefault((g.doc_id, g.n_chars), set()).add(g.fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_near_pairs(spark):
    r = random.Random(2)
    rows = []
    for k in range(20):
        base = [r.choice(["the", "of", f"x{r.randrange(400)}", f"y{r.randrange(400)}", "z"]) for _ in range(60)]
        rows.append((3 * k, " ".join(base), "x"))
        base[r.randrange(60)] = "new"
        rows.append((3 * k + 1, " ".join(base), "x"))
        rows.append((3 * k + 2, rows[-1][1], "x"))
    got = {(g.a, g.b) for g in spotsigs.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    c = {i: chains(t) for i, t, _ in rows if i % 3 < 2}
    assert got == {(a, b) for a in c for b in c if a < b and c[a] != c[b] and len(c[a] & c[b]) >= 0.75 * len(c[a] | c[b])}


def test_empty(spark):
    assert spotsigs.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
