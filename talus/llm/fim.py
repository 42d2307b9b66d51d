"""Fill-in-the-middle rewriting: texts are cut between units and their parts put in another order behind sentinels.

Method. A finite automaton reads UTF-8 bytes; it emits where units begin and where a sentinel ends. Blocks of a text are
scanned side by side from every state at once: each gives its state-transition function and what it emits for each start
state. Functions compose, so a scan over the blocks tells the state in which each is entered; then the k-th unit is found by
counts, and its place within one block only. Texts of more than a chunk are dealt over tasks chunk by chunk, which emit the
same functions and counts, composed once more; only the blocks that hold a cut are read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm import words as W
from talus.llm import worker
from talus.llm.store import fresh, parts, stash

#: Sentinels of prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that are scanned from every state in one go.
BLOCK = 256
#: Texts of more bytes are dealt over tasks in chunks of this size.
CHUNK = 1 << 16
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")

_PAD = 5
#: Of a packed emission the low bits count units, the others sentinels; a block has at most BLOCK of either.
_UNITS = 14


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, step): lines, and the three sentinels.

    A state is 3 * (within a line) + how much of a sentinel was read. step[8 * class + state] holds the next state in its low
    three bits and the packed emission above them. The last class is padding, which changes nothing.
    """
    kind = np.zeros(256, np.uint8)
    for k, chars in ((1, b"\n"), (2, b"<"), (3, b">"), (4, b"PSM")):
        kind[list(chars)] = k
    step = np.zeros(8 * (_PAD + 1), np.int32)
    for s in range(6):
        inside, seen = divmod(s, 3)
        for k in range(_PAD):
            now = 1 if k == 2 else 2 if k == 4 and seen == 1 else 0
            mark = k == 3 and seen == 2
            step[8 * k + s] = 3 * (k != 1) + now | (int(not inside) | int(mark) << _UNITS) << 3
        step[8 * _PAD + s] = s
    return kind, step


STATES = 6
_KIND, _STEP = automaton()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offset of each row in them."""
    _, where, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _columns(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes of the bytes by place in a block and block, the first block of each text and the end): texts begin a block."""
    first = np.concatenate([[0], np.cumsum(-(-size // BLOCK))])
    flat = np.full(first[-1] * BLOCK, _PAD, np.uint8)
    at = np.cumsum(size) - size
    flat[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - at, size)] = _KIND[data]
    return np.ascontiguousarray(flat.reshape(-1, BLOCK).T), first


def _functions(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block and start state the end state and the packed emission."""
    state = np.repeat(np.arange(STATES, dtype=np.int32)[:, None], columns.shape[1], 1)
    held = np.zeros_like(state)
    for kinds in columns:
        got = _STEP.take(kinds.astype(np.int32) * 8 + state)
        state = got & 7
        held += got >> 3
    return state.T.copy(), held.T.copy()


def _entries(ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each block and state that its text is entered in, the state in which the block is entered; the same for the ends of texts)."""
    run, place = ends.copy(), np.arange(len(ends)) - np.repeat(first[:-1], np.diff(first))
    step, most = 1, int(np.diff(first).max(initial=0))
    while step < most:  # associative: the function of the blocks up to here is composed with that of the ones before
        later = np.flatnonzero(place >= step)
        run[later] = np.take_along_axis(run[later], run[later - step], 1)
        step *= 2
    same = np.arange(STATES, dtype=run.dtype)
    entry = np.concatenate([same[None], run])[:-1] if len(run) else run
    entry[place == 0] = same
    last = np.where((np.diff(first) > 0)[:, None], np.concatenate([same[None], run])[first[1:]], same)
    return entry, last


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def scan(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """What texts (bytes data, bounds at) do to each of the states they may be entered in: next, units, marks; and their characters."""
    size = np.diff(at)
    columns, first = _columns(data, size)
    ends, held = _functions(columns)
    entry, last = _entries(ends, first)
    got = np.take_along_axis(held, entry, 1)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return {"next": last, "units": _sums(got & ((1 << _UNITS) - 1), first), "marks": _sums(got >> _UNITS, first), "chars": chars[at[1:]] - chars[at[:-1]]}


def places(data: np.ndarray, at: np.ndarray, entered: np.ndarray, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where in its text (bytes from its start) the unit of rank (from 0) of text[i] begins; the text's end if it has no such unit."""
    size = np.diff(at)
    columns, first = _columns(data, size)
    ends, held = _functions(columns)
    entry, _ = _entries(ends, first)
    state = entry[np.arange(len(entry)), np.repeat(entered, np.diff(first))]
    units = held[np.arange(len(held)), state] & ((1 << _UNITS) - 1)
    total = np.concatenate([[0], np.cumsum(units)])
    want = total[first[text]] + rank + 1
    inside = want <= total[first[text + 1]]
    out = size[text].astype(np.int64)
    block = np.searchsorted(total, want[inside], "left") - 1
    left, s, found = want[inside] - total[block], state[block], np.zeros(len(block), np.int64)
    for k, kinds in enumerate(columns[:, block]):
        got = _STEP.take(kinds.astype(np.int32) * 8 + s)
        s = got & 7
        left = left - (got >> 3 & ((1 << _UNITS) - 1))
        found[(left == 0) & (found == 0)] = k + 1
    out[inside] = (block - first[text[inside]]) * BLOCK + found - 1
    return out


def forms(n: np.ndarray, marks: np.ndarray, h: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, units of the prefix, units up to the end of the middle) by counts and the numbers h (rows of four)."""
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    plain = (n == 0) | (marks > 0) | (h[:, 2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    return form, np.minimum(one, two), np.maximum(one, two)


def assembled(text: bytes, form: str, a: int, b: int) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return text if form == "plain" else b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))


def _with(batch: pa.RecordBatch, drop: list[str], n, form, prefix, middle, output: list[bytes]) -> pa.RecordBatch:
    cols = {c: batch.column(c) for c in batch.schema.names if c not in drop}
    plain = form == "plain"
    new = (pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string()))
    return pa.record_batch(cols | dict(zip(NEW, new, strict=True)))


def _numbers(batch: pa.RecordBatch, hs: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in hs], 1)


def _whole(hs: list[str], rate: int, spm: int):
    """Rewrites texts that one task takes whole."""

    def go(batches):
        worker.claim("fim")
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            for lo, hi in W.slices(at):
                part, own, rows = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], batch.slice(lo, hi - lo)
                got = scan(part, own)
                n, chars = got["units"][:, 0], np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                form, a, b = forms(n, got["marks"][:, 0], _numbers(rows, hs), rate, spm)
                which = np.arange(hi - lo)
                cut = places(part, own, np.zeros(hi - lo, np.int64), np.concatenate([which, which]), np.concatenate([a, b])).reshape(2, -1)
                start, middle, end = chars[own[:-1]], chars[own[:-1] + cut[0]], chars[own[:-1] + cut[1]]
                raw = part.tobytes()
                out = [assembled(raw[own[i] : own[i + 1]], form[i], cut[0][i], cut[1][i]) for i in range(hi - lo)]
                yield _with(rows, hs, n, form, middle - start, end - middle, out)

    return go


def _chunks(chunk: int):
    def go(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("body"), strict=True):
                whole = text.as_buffer()
                for k in range(-(-whole.size // chunk)):
                    yield pa.record_batch({"row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int32()), "body": pa.array([whole.slice(k * chunk, min(chunk, whole.size - k * chunk)).to_pybytes()], pa.binary())})

    return go


def _summaries(batches):
    """Chunks' functions from states to states, and their counts for each start state."""
    worker.claim("fim")
    for batch in batches:
        data, at = _bytes(batch.column("body"))
        for lo, hi in W.slices(at):
            got = scan(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            lists = {c: pa.array(list(got[c].astype(np.int64)), pa.list_(pa.int64())) for c in ("next", "units", "marks")}
            yield pa.record_batch({"row": batch.column("row").slice(lo, hi - lo), "k": batch.column("k").slice(lo, hi - lo), **lists, "chars": pa.array(got["chars"], pa.int64())})


_SUMMARY = "row long, k int, next array<long>, units array<long>, marks array<long>, chars long"


def _resolved(rate: int, spm: int):
    """The counts of one text, and for each cut its chunk, the state that is entered in, the rank of the unit within and the characters before."""

    def go(table: pa.Table) -> pa.Table:
        got = table.sort_by("k")
        nxt, units, marks = (np.array(got.column(c).to_pylist()) for c in ("next", "units", "marks"))
        state = np.zeros(len(nxt) + 1, np.int64)
        for k in range(len(nxt)):
            state[k + 1] = nxt[k, state[k]]
        each = np.arange(len(nxt))
        upto = np.concatenate([[0], np.cumsum(units[each, state[:-1]])])
        n, seen = upto[-1:], marks[each, state[:-1]].sum(keepdims=True)
        h = np.array([[got.column(f"h{i}")[0].as_py() for i in range(1, 5)]])
        form, a, b = forms(n, seen, h, rate, spm)
        chars = np.concatenate([[0], np.cumsum(got.column("chars").to_numpy())])
        out = {"row": [got.column("row")[0].as_py()], "n": n.tolist(), "form": form.tolist(), "chars": [int(chars[-1])]}
        for c, want in (("a", int(a[0])), ("b", int(b[0]))):
            k = min(int(np.searchsorted(upto, want + 1, "left")) - 1, len(nxt) - 1)
            out |= {f"{c}_k": [k], f"{c}_state": [int(state[k])], f"{c}_rank": [want - int(upto[k])], f"{c}_chars": [int(chars[k])]}
        return pa.table(out, schema=_FOUND)

    return go


_FOUND = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("chars", pa.int64()), *[(f"{c}_{x}", pa.int64()) for c in "ab" for x in ("k", "state", "rank", "chars")]])
_FOUND_SQL = "row long, n long, form string, chars long, " + ", ".join(f"{c}_{x} long" for c in "ab" for x in ("k", "state", "rank", "chars"))


def _cut(chunk: int, names: dict[str, str], drop: list[str]):
    """Reads the two chunks of each text that hold its cuts and puts the text together. names: of the columns of _FOUND."""

    def go(batches):
        worker.claim("fim")
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = row.column("text")[0].as_buffer().to_pybytes()
                get = lambda c, r=row: r.column(names[c])[0].as_py()
                cuts, before = [], []
                for c in "ab":
                    k = get(f"{c}_k")
                    part = np.frombuffer(raw[k * chunk : (k + 1) * chunk], np.uint8)
                    at = int(places(part, np.array([0, len(part)]), np.array([get(f"{c}_state")]), np.array([0]), np.array([get(f"{c}_rank")]))[0])
                    cuts.append(k * chunk + at)
                    before.append(get(f"{c}_chars") + int(((part[:at] & 0xC0) != 0x80).sum()))
                form = get("form")
                yield _with(row, drop, [get("n")], np.array([form]), [before[0]], [before[1] - before[0]], [assembled(raw, form, *cuts)])

    return go


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output: texts rewritten for filling in the middle.

    docs needs doc_id and text; its other columns stay, but for those with the names of new ones. Four numbers, the first
    32-digit half of sha256('seed:doc_id') in groups of eight hex digits (null doc_id: nothing after the colon), choose the two
    cuts between the n lines, whether the text is rewritten (rate of 100) and in which order (spm of 100). prefix_chars and
    middle_chars count characters and are null where the form is plain: a null or empty text (its output is empty), one that
    holds a sentinel, one beyond rate. Rows that share a doc_id are cut by the same numbers, repeated rows alike; an empty
    table gives no rows. A text of more than chunk bytes is scanned by many tasks; the result is the same.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in NEW])
    hs = [fresh(docs, f"_h{i}") for i in range(1, 5)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    docs = docs.withColumn("text", F.col("text").cast("string")).withColumns({c: number(i) for i, c in enumerate(hs)})
    fields = [f for f in docs.schema.fields if f.name not in hs]
    out = T.StructType([*fields, *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    large = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    small = docs.where(~large).mapInArrow(_whole(hs, rate, spm), out)
    # the rows of long texts are numbered in a written table, so all that follows sees the same numbers
    row = fresh(docs, "_row")
    long_ = stash(docs.where(large).withColumn(row, F.monotonically_increasing_id()), "long")
    spark = docs.sparkSession
    bodies = long_.select(F.col(row).alias("row"), F.col("text").cast("binary").alias("body"))
    chunks = bodies.mapInArrow(_chunks(chunk), "row long, k int, body binary").repartition(parts(spark), "row", "k")
    numbers = long_.select(F.col(row).alias("row"), *[F.col(c).alias(f"h{i}") for i, c in enumerate(hs, 1)])
    found = chunks.mapInArrow(_summaries, _SUMMARY).join(numbers, "row").groupBy("row").applyInArrow(_resolved(rate, spm), _FOUND_SQL)
    names = {c: row if c == "row" else fresh(long_, f"_{c}") for c in _FOUND.names}
    found = stash(found.select(*[F.col(c).alias(to) for c, to in names.items()]), "cuts")
    # long texts grow with the documents, so this is a shuffled join at every size
    cut = long_.join(found.hint("merge"), row).mapInArrow(_cut(chunk, names, [*hs, *names.values()]), out)
    return small.unionByName(cut)


def restored(output: str, form: str):
    """The text behind an output of that form, as a column expression."""
    part = f"split({output}, '<[PSM]>', -1)"
    return F.expr(f"case {form} when 'psm' then concat({part}[1], {part}[3], {part}[2]) when 'spm' then concat({part}[2], {part}[3], {part}[1]) else {output} end")
