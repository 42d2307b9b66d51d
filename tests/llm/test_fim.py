import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm import fim

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("Form", T.StringType()), T.StructField("_row", T.LongType()), T.StructField("_h1", T.StringType())])


def model(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus(seed):
    r = random.Random(seed)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "é", "日本\n語", "<P>", "x<S", ">", "a<M>b", "<", "<P", "P>", "<<P>", "<P<S>", "<\nP>", "a" * 255 + "\n", "a" * 256 + "\n" + "b", "\n" * 600]
    for _ in range(120):
        texts.append("".join(r.choice(["word ", "é", "\n", "<", "P", ">", "😀", "S"]) for _ in range(r.choice([3, 40, 300, 900]))))
    texts += ["line of text\n" * 700, "ünï\n" * 900 + "<M", "z" * 5000, "y" * 700 + "<S>" + "y\n" * 700, "x" * 1023 + "<P>"]
    return [(None if k % 40 == 7 else k // 2 if k % 10 == 3 else k, t, "x", k, "y") for k, t in enumerate(texts)]


@pytest.mark.parametrize(("chunk", "how"), [(1 << 16, {}), (64, {}), (700, {"rate": 60, "spm": 30, "seed": 3})])
def test_equals_model(spark, chunk, how):
    rows = corpus(1)
    df = fim.transform(spark.createDataFrame(rows, SCHEMA), chunk=chunk, **how)
    assert df.columns == ["doc_id", "text", "_row", "_h1", *fim.NEW]
    got = df.withColumn("restored", fim.restored("output", "form")).collect()
    want = {r[3]: model(r[0], r[1], **how) for r in rows}
    assert len(got) == len(rows)
    for g in got:
        assert (g.n, g.form, g.prefix_chars, g.middle_chars, g.output) == want[g._row]
        assert g.restored == (g.text or "") and g._h1 == "y"
    assert {g.form for g in got} == {"plain", "psm", "spm"}


def test_functions_compose():
    """Wherever a text is cut, what its parts do one after the other is what the whole does, from every state."""
    r = random.Random(4)
    for _ in range(30):
        raw = "".join(r.choice("ab\n<>PSMé") for _ in range(r.randrange(1, 900))).encode()
        data = np.frombuffer(raw, np.uint8)
        whole = fim.scan(data, np.array([0, len(data)]))
        cut = r.randrange(len(data) + 1)
        parts = fim.scan(data, np.array([0, cut, len(data)]))
        for s in range(fim.STATES):
            mid = parts["next"][0, s]
            assert whole["next"][0, s] == parts["next"][1, mid]
            for c in ("units", "marks"):
                assert whole[c][0, s] == parts[c][0, s] + parts[c][1, mid]
        assert whole["units"][0, 0] == len(re.findall(rb"[^\n]*\n|[^\n]+", raw))
        assert whole["marks"][0, 0] == len(re.findall(rb"<[PSM]>", raw))


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_chunks_of_one_text(spark):
    text = "some line\n" * 40_000 + "end"
    got = fim.transform(spark.createDataFrame([(5, text, "", 0, "")], SCHEMA), chunk=1000).select("form", F.sha2("output", 256)).first()
    n, form, _, _, out = model(5, text)
    assert tuple(got) == (form, hashlib.sha256(out.encode()).hexdigest())
