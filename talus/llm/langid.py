"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm import worker

#: Hashed n-gram features.
DIM = 1 << 16
#: N-gram lengths in code points.
ORDERS = (1, 2, 3)
#: Labelled rows of each language that the classifier is fitted on (the bound of the sample that reaches the driver).
SAMPLE = 600
#: FTRL-proximal: learning rate, its smoothing, and the elastic net's two weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
EPOCHS = 4
SCALE = 30.0
UNKNOWN = "und"

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_STEP = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str):
    """Hashes of a text's lower-case letter n-grams, other characters as one space, in blocks; nothing for a text without letters."""
    carry = np.array([32], np.uint32)
    for lo in range(0, len(text), _STEP):
        c = np.frombuffer(text[lo : lo + _STEP].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, np.uint32(32))
        c = np.concatenate([carry, c, np.full(int(lo + _STEP >= len(text)), 32, np.uint32)])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        for n in ORDERS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h + c[k : k + len(h)]) * _MULT[k]
                    h ^= h >> np.uint32(15)
                yield (h * np.uint32(0x27D4EB2F)) >> np.uint32(16)
        carry = c[-2:]


def _labelled(docs: DataFrame) -> DataFrame:
    """Rows to learn from: text and lang given, crc32 of the id modulo 5 not 0."""
    return docs.where(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull())


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows of docs (text), and how many rows there are."""
    block = DIM // 16

    def go(batches):
        worker.claim("grams")
        df, rows = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for t in batch.column("text"):
                seen = np.zeros(DIM, bool)
                for h in grams(t.as_py() or ""):
                    seen[h] = True
                df += seen
                rows += 1
        if rows:
            yield pa.record_batch({"block": pa.array(range(17), pa.int32()), "df": pa.array([df[i * block : (i + 1) * block].tobytes() for i in range(16)] + [np.array([rows]).tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in table.column("df").to_pylist())
        return pa.table({"block": table.column("block")[:1], "df": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(go, "block int, df binary").groupBy("block").applyInArrow(add, "block int, df binary").collect()
    if not parts:
        return np.zeros(DIM, np.int64), 0
    got = {r["block"]: np.frombuffer(r["df"], np.int64) for r in parts}
    return np.concatenate([got[i] for i in range(16)]), int(got[16][0])


def least_hashed(docs: DataFrame, sample: int) -> DataFrame:
    """(order, lang, text): the sample rows of each lang with the least hash of (doc_id, text), or all rows it has.

    Rows are counted first, so only those below a bound that holds a little more than the sample are shuffled.
    """
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("order"), "lang", "text")
    rows = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    more = 1.0
    while rows:
        share = {k: more * (sample + 10 * sample**0.5 + 10) / n for k, n in rows.items()}
        upto = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, 2**63 - 1 if v >= 1 else int(v * 2**64) - 2**63)]), F.col("lang"))
        below = hashed.where(F.col("order") <= upto)
        held = {r["lang"]: r["count"] for r in below.groupBy("lang").count().collect()}
        if all(held.get(k, 0) >= min(sample, n) for k, n in rows.items()):
            place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
            return below.withColumn("place", place).where(F.col("place") <= sample).drop("place")
        more *= 2
    return hashed


def _features(batches):
    for batch in batches:
        out = []
        for t in batch.column("text"):
            count = np.zeros(DIM, np.int64)
            for h in grams(t.as_py()):
                count += np.bincount(h, minlength=DIM)
            at = np.flatnonzero(count)
            out.append((at.astype(np.uint16).tobytes(), (count[at] / max(1, count.sum())).astype(np.float32).tobytes()))
        yield pa.record_batch([batch.column("order"), batch.column("lang"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["order", "lang", "at", "tf"])


class Model:
    """Weights (feature, language) with IDF folded in, biases, languages and the calibrated temperature."""

    def __init__(self, langs, weights, bias, temperature):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n, letters = np.zeros(len(self.langs)), 0, False
        for h in grams(text) if text and self.langs else ():
            total += self.weights[h].sum(0, dtype=np.float64)
            n += len(h)
            letters = True
        if not letters or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        z = (self.bias + SCALE * total / n) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights (DIM + 1, classes) by FTRL-proximal with per-coordinate rates; the last row is the bias, without penalty."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        one = np.where(at == DIM, 0.0, L1)[:, None]
        w = -(zz - np.sign(zz) * one) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= one, 0.0, w)

    for _ in range(EPOCHS):
        for y, at, x in rows:
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            g = x[:, None] * (_softmax(x @ w) - (np.arange(classes) == y))
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return np.concatenate([weights(np.arange(k, min(k + 4096, DIM + 1))) for k in range(0, DIM + 1, 4096)])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most sample rows of each lang (least hash of doc_id first); IDF comes from all rows of docs.

    A fifth of the sample is kept to find the temperature that minimises log loss. Without rows there are no languages.
    """
    df, total = document_frequency(docs)
    picked = least_hashed(docs, sample)
    got = sorted(picked.mapInArrow(_features, "order long, lang string, at binary, tf binary").collect(), key=lambda r: (r["order"], r["lang"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = []
    for r in got:
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        rows.append((langs.index(r["lang"]), at, SCALE * np.frombuffer(r["tf"], np.float32) * idf[at]))
    kept = [r for k, r in enumerate(rows) if k % 5 == 4]
    w = ftrl([r for k, r in enumerate(rows) if k % 5 != 4], len(langs))
    logits = np.array([x @ w[at] + w[DIM] for _, at, x in kept]).reshape(-1, len(langs))
    y = np.array([k for k, _, _ in kept], int)
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).sum()
    temperature = min(np.geomspace(0.2, 5, 49), key=loss) if len(y) else 1.0
    return Model(langs, (w[:DIM] * idf[:, None]).astype(np.float32), w[DIM], float(temperature))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred and score; docs needs doc_id, text and lang; its columns stay, but for those with the names of new ones.

    Learns from rows with text and lang whose crc32(doc_id as text) modulo 5 is not 0. lang_pred is a learned lang, or und
    with score 0 where text is null or has no letter, or where there is nothing to learn from; of equal languages the first by name. A null doc_id counts as the
    empty text. Whole texts are read, in blocks; repeated rows stay repeated; an empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0
    docs = docs.drop("held_out", "lang_pred", "score").withColumns({"held_out": held, "text": F.col("text").cast("string")})
    model = fit(_labelled(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), "held_out")), sample)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def go(batches):
        worker.claim("grams")
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column("text")]
            batch = batch.append_column("lang_pred", pa.array([o[0] for o in out], pa.string()))
            yield batch.append_column("score", pa.array([o[1] for o in out], pa.float64()))

    return docs.mapInArrow(go, ", ".join([*fields, "lang_pred string", "score double"]))


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found with a calibrated score of at least least; columns as before."""
    kept = docs.drop("held_out", "lang_pred", "score")
    return identify(kept).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*kept.columns)
