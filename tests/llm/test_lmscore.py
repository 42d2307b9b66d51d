import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from talus.llm import lmscore, packing

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("target", T.BooleanType()), ("score", T.StringType()))])


def test_scores_equal_brute_force(spark):
    rows = [(1, "the cat sat on the mat", True, "x"), (2, "the dog ran over the hill", False, "x"), (3, None, True, "x"), (4, "", None, "x"), (None, "the cat", None, None), (2, "the dog ran over the hill", False, "x"), (7, "cat " * 30_000, True, "x")]
    enc = packing.WordEncoder(packing.tokenizer_path())
    ids = [np.frombuffer(enc.encode([r[1] or ""])[0], "<u4").tolist() for r in rows]

    def model(target, without):
        """Counts of the rows on one side, but one row, times the scale that all rows of that side give."""
        uni, hist, pair, tokens = Counter(), Counter(), Counter(), {True: 0, False: 0}
        for k, (r, t) in enumerate(zip(rows, ids)):
            tokens[bool(r[2])] += len(t)
            if bool(r[2]) == target and k != without:
                uni.update(t)
                hist.update([lmscore.START, *t][:-1] if t else [])
                pair.update(zip([lmscore.START, *t], t))
        scale = min(tokens.values()) / tokens[target]
        words = len({x for t in ids for x in t}) + 1

        def logp(a, b):
            one = (scale * uni[b] + lmscore.UNIFORM) / (scale * sum(uni.values()) + lmscore.UNIFORM * words)
            return math.log((scale * pair[a, b] + lmscore.MU * one) / (scale * hist[a] + lmscore.MU))

        return logp

    def mean(k, t):
        target, rest = model(True, k), model(False, k)
        return sum(target(a, b) - rest(a, b) for a, b in zip([lmscore.START, *t], t)) / len(t)

    want = sorted((r[0] or -1, len(t), round(mean(k, t), 4) if t else None) for k, (r, t) in enumerate(zip(rows, ids)))
    got = sorted((g.doc_id or -1, g.n_tokens, None if g.score is None else round(g.score, 4)) for g in lmscore.score(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and abs((a[2] or 0) - (b[2] or 0)) < 2e-4 for a, b in zip(got, want))


def test_empty(spark):
    assert lmscore.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_side_and_large_vocabulary(spark, tmp_path):
    out = lmscore.score(spark.createDataFrame([(-(2**63), "a b", False, "x"), (None, "c", None, "x")], SCHEMA)).collect()
    assert {o.doc_id for o in out} == {-(2**63), None} and all(math.isfinite(o.score) for o in out)
    spec = json.loads(open(packing.tokenizer_path()).read())
    spec["model"]["vocab"] |= {f"extra{k}": k for k in range(49408, 65536)}
    path = tmp_path / "large.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(Exception, match="more than 65535 ids"):
        lmscore.score(spark.createDataFrame([(1, "a b", False, "x")], SCHEMA), str(path)).collect()
