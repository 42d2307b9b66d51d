import numpy as np
import pytest
from pyspark.sql import types as T

from talus.llm import whitening


def schema(kind):
    return T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind)), T.StructField("V", T.StringType()), T.StructField("whitened", T.StringType())])


def model(vectors, top=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    d = x - s / n
    e, v = np.linalg.eigh(d.T @ d / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(top, int((e > 1e-12 * e[0]).sum()))
    return [sum(int(y) ** 2 for y in (n * r.astype(object) - s)) for r in x], d @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize(("dim", "rows"), [(3, 50), (64, 700), (70, 300), (300, 400)])
def test_equals_numpy(spark, dim, rows):
    rng = np.random.default_rng(dim)
    m = (rng.normal(size=(rows, dim)) @ rng.normal(size=(dim, dim)) * 0.1 + rng.normal(size=dim)).astype(np.float32)
    data = [(i, [float(c) for c in r], "x", "y") for i, r in enumerate(m)]
    bad = [(-1, None, "", ""), (-2, [], "", ""), (-3, [1.0] * (dim - 1) + [None], "", ""), (-4, [1.0] * (dim - 1) + [float("nan")], "", ""), (-5, [float("-inf")] * dim, "", ""), (-6, [1.0] * (dim + 1), "", ""), (None, [float(c) for c in m[0]], "x", "y")]
    out = whitening.whiten(spark.createDataFrame(data + bad, schema(T.FloatType())).repartition(5))
    assert out.columns == ["vec_id", "V", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    dev, w, explained = model([*m, m[0]])
    got = {(r.vec_id, r.component): r for r in out.collect()}
    k = w.shape[1]
    assert len(got) == (rows + 1) * k
    sign = [np.sign(got[0, c + 1].whitened * w[0, c]) for c in range(k)]
    for (i, c), r in got.items():
        at = rows if i is None else i
        assert (r.n, r.deviation, r.V) == (rows + 1, dev[at], "x")
        assert abs(r.whitened - sign[c - 1] * w[at, c - 1]) < 1e-6
        assert abs(r.explained - explained[c - 1]) < 1e-9 and r.identity_error < 1e-9
    assert r.identity_error >= 0


def test_sums_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(c) for c in r], "", "") for i, r in enumerate(rng.normal(size=(500, 40)))], schema(T.DoubleType()))
    fits = [whitening.fit(df.repartition(p).selectExpr("embedding as v"), 40) for p in (1, 3, 50)]
    for f in fits[1:]:
        assert f["sums"] == fits[0]["sums"] and (f["values"] == fits[0]["values"]).all()


def test_small_and_flat_tables(spark):
    kind = schema(T.DoubleType())
    row = lambda i, *v: (i, list(v), "", "")
    for data in ([], [row(1, 1.0, 2.0)], [row(1, 1.0, 2.0), row(2, 1.0, 2.0)], [(1, None, "", "")]):
        assert whitening.whiten(spark.createDataFrame(data, kind)).count() == 0
    got = whitening.whiten(spark.createDataFrame([row(1, 0.0, 5.0), row(1, 0.0, 5.0), row(2, 1.0, 5.0)], kind)).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_large_entries_are_exact(spark):
    data = [(i, [float(c) for c in r], "", "") for i, r in enumerate([[1e9, -3.0], [2.5e9, 4.0], [-7e8, 1e11], [0.5, 0.25]])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(data, schema(T.DoubleType()))).collect()}
    want = model([d[1] for d in data])[0]
    assert got == {i: (w if w < 2**63 else None) for i, w in enumerate(want)}
    assert whitening.product(np.array([[2**40]]), np.array([[2**41]])).tolist() == [[2**81]]
