"""Cross-entropy difference: matched target and background bigram models over one vocabulary score each document.

The target model counts the documents marked so, the background model all others. Counts of the larger side are scaled to
the tokens of the smaller one, so both models have the same form, constants and mass. A document is taken out of the model
that counted it before that model scores it. Tokens are the ids of a public tokenizer, so unigram tables have a fixed size;
bigram counts grow with the corpus and stay distributed: each chunk of documents asks the buckets that own its bigrams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import worker
from talus.llm.jaccard import by_bucket, chunk_id, pack, unpack
from talus.llm.packing import encoded, encoder, tokenizer_path
from talus.llm.store import buckets, stash
from talus.llm.words import mix

VOCABULARY = 1 << 16
#: The id that stands before a text's first token.
START = VOCABULARY - 1
#: Weight of the unigram model in the bigram model, in counts; and of the uniform in the unigram model.
MU, UNIFORM = 8.0, 1.0
CHUNK_BYTES = 1 << 20
#: Text bytes whose bigrams one bucket takes, about.
BUCKET_BYTES = 16 << 20


def _token_chunks(path: str):
    """Chunks of documents: ids, target flags, numbers of tokens, and the tokens as 16-bit ids."""

    def go(batches):
        enc, k, ids, flags, nulls, tokens, size = encoder(path), 0, [], [], [], [], 0
        if len(enc.ends) > START:
            raise ValueError(f"the tokenizer has more than {START} ids")

        def out():
            n = np.array([len(t) for t in tokens], np.int64)
            row = pack(ids=np.array(ids, np.int64), none=np.array(nulls, bool), target=np.array(flags, bool), n=n, tokens=np.concatenate(tokens))
            return pa.record_batch({"chunk": pa.array([chunk_id(k)], pa.int64()), "body": pa.array([row], pa.binary())})

        for batch in batches:
            for i, t, f, none in zip(batch.column("doc_id").to_pylist(), encoded(enc, batch.column("text")), batch.column("target").to_pylist(), batch.column("none").to_pylist(), strict=True):
                one = np.frombuffer(t, "<u4").astype(np.uint16)
                ids.append(i)
                flags.append(f)
                nulls.append(none)
                tokens.append(one)
                size += one.nbytes + 16
                if size >= CHUNK_BYTES:
                    yield out()
                    k, ids, flags, nulls, tokens, size = k + 1, [], [], [], [], 0
        if ids:
            yield out()

    return go


def _pairs(h: dict) -> np.ndarray:
    """The bigram of each token with the one before it, as one number."""
    tokens, n = h["tokens"].astype(np.uint64), h["n"]
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    first = (np.cumsum(n) - n)[n > 0]
    before[first] = START
    return before << np.uint64(16) | tokens


def _unigrams(batches):
    """Counts of tokens and of histories, in the background's documents and in the target's, by one row for each partition."""
    worker.claim("counts")
    held = np.zeros((4, VOCABULARY), np.int64)
    for batch in batches:
        for blob in batch.column("body").to_pylist():
            h = unpack(blob)
            pair = _pairs(h)
            on = np.repeat(h["target"], h["n"])
            for k, x in enumerate((pair & np.uint64(0xFFFF), pair >> np.uint64(16))):
                x = x.astype(np.int64)
                held[k] += np.bincount(x[~on], minlength=VOCABULARY)
                held[2 + k] += np.bincount(x[on], minlength=VOCABULARY)
    yield pa.record_batch({"k": pa.array(range(4), pa.int32()), "counts": pa.array([r.tobytes() for r in held], pa.binary())})


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
    return pa.table({"k": table.column("k")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _bigram_rows(nb: int):
    def go(batches):
        worker.claim("counts")
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
                h = unpack(blob)
                keys, back = np.unique(_pairs(h), return_inverse=True)
                on = np.repeat(h["target"], h["n"])
                target = np.bincount(back[on], minlength=len(keys)).astype(np.uint32)
                rest = np.bincount(back[~on], minlength=len(keys)).astype(np.uint32)
                out = [(b, keys[at].astype(np.uint32).tobytes(), np.stack([rest[at], target[at]]).tobytes()) for b, at in by_bucket(mix(keys), nb)]
                yield pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["bucket", "chunk", "keys", "counts"])

    return go


def scales(uni: np.ndarray) -> tuple[float, float]:
    """What background and target counts are multiplied by, so that both add up to the tokens of the smaller side."""
    rest, target = float(uni[0].sum()), float(uni[2].sum())
    low = min(rest, target)
    return (low / rest, low / target) if low else (1.0, 1.0)


def log_ratios(h: dict, pair: np.ndarray, counts: np.ndarray, uni: np.ndarray) -> np.ndarray:
    """log P(token | before) of the target model minus that of the background for each token of a chunk.

    counts: how often the background (0) and the target (1) have each token's bigram. Bigrams back off to unigrams by MU,
    those to the uniform by UNIFORM.
    """
    token, before = (pair & np.uint64(0xFFFF)).astype(np.int64), (pair >> np.uint64(16)).astype(np.int64)
    doc = np.repeat(np.arange(len(h["n"]), dtype=np.uint64), h["n"])
    own = []
    for key in (pair | doc << np.uint64(32), token.astype(np.uint64) | doc << np.uint64(32), before.astype(np.uint64) | doc << np.uint64(32)):
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        own.append(n[back])
    mine, length = np.repeat(h["target"], h["n"]), np.repeat(h["n"], h["n"])
    words = int(((uni[0] + uni[2]) > 0).sum()) + 1
    out = np.zeros(len(pair))
    for k, (sign, scale) in enumerate(zip((-1.0, 1.0), scales(uni), strict=True)):
        less = mine == bool(k)
        one = (scale * (uni[2 * k][token] - less * own[1]) + UNIFORM) / (scale * (uni[2 * k].sum() - less * length) + UNIFORM * words)
        out += sign * np.log((scale * (counts[k] - less * own[0]) + MU * one) / (scale * (uni[2 * k + 1][before] - less * own[2]) + MU))
    return out


def score(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score for each row of docs (doc_id, text, target boolean; other columns are ignored).

    score is the mean over a text's tokens of the target model's log probability minus the background's, each without what
    this row itself counts in it: the higher, the more like the target. Whole texts of all rows are counted, those with
    target true by the target model, the others by the background. Null and empty texts have no tokens and a null score;
    null target counts as false; repeated rows count and come back each; a null doc_id is kept; where one side has no
    tokens its model is uniform; texts of any length count whole; an empty table gives no rows. Tokenizers of more than 65,535 ids raise an error.
    """
    nb = buckets(docs, BUCKET_BYTES)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("target", F.lit(False)).alias("target"))
    # a null id goes along as a flag, since ids travel as plain numbers
    ids = cols.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", "target", F.col("doc_id").isNull().alias("none"))
    chunks = stash(ids.mapInArrow(_token_chunks(tokenizer_path(tokenizer)), "chunk long, body binary"), "tokens")
    held = chunks.select("body").mapInArrow(_unigrams, "k int, counts binary").groupBy("k").applyInArrow(_sum, "k int, counts binary").collect()
    uni = np.zeros((4, VOCABULARY), np.int64)
    for r in held:
        uni[r["k"]] = np.frombuffer(r["counts"], np.int64)

    def answer(table: pa.Table) -> pa.Table:
        worker.claim("counts")
        own = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint32).reshape(2, -1) for c in table.column("counts").to_pylist()], axis=1)
        _, back = np.unique(np.concatenate(own), return_inverse=True)
        total = np.stack([np.bincount(back, c) for c in counts]).astype(np.uint64)[:, back]
        cut = np.cumsum([len(k) for k in own])[:-1]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "total": pa.array([x.tobytes() for x in np.split(total, cut, axis=1)], pa.binary())})

    answers = chunks.mapInArrow(_bigram_rows(nb), "bucket int, chunk long, keys binary, counts binary").groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, total binary")

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        worker.claim("counts")
        h = unpack(left.column("body")[0].as_py())
        pair = _pairs(h)
        keys, back = np.unique(pair, return_inverse=True)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("total").to_pylist(), strict=True))
        counts = np.zeros((2, len(keys)), np.int64)
        for b, at in by_bucket(mix(keys), nb):
            counts[:, at] = np.frombuffer(got[b], np.uint64).reshape(2, -1)
        total = np.concatenate([[0], np.cumsum(log_ratios(h, pair, counts[:, back], uni))])
        end = np.cumsum(h["n"])
        n = h["n"]
        mean = (total[end] - total[end - n]) / np.maximum(n, 1)
        return pa.table({"doc_id": pa.array(h["ids"], mask=h["none"]), "n_tokens": n, "score": pa.array(mean, mask=n == 0)})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(collect, "doc_id long, n_tokens long, score double")
