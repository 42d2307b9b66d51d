import test_decontam
import test_jaccard
import test_lines

import corpus_pipeline
from talus.llm import langid, packing

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, DIR), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] >= counts[0] // 2
    rows = docs.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    kept = {line.lower().strip() for r in rows for line in r.text.split("\n") if line.strip()}
    assert len(kept) == sum(1 for r in rows for line in r.text.split("\n") if line.strip())
    packed = corpus_pipeline.pack_sequences(spark, docs, DIR).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in rows}
    enc = packing.WordEncoder(packing.tokenizer_path())
    assert sum(p.length for p in packed) == sum(len(enc.encode([r.text])[0]) // 4 + 1 for r in rows)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def rows_of(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_each_stage_equals_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = rows_of(docs)

    def step(name):
        nonlocal docs
        docs = corpus_pipeline.stash(stages[name](spark, docs, DIR), name)
        return rows_of(docs)

    # language: what a plain prediction, one text at a time, takes for a language with a score of one half or more
    model = langid.fit(langid._labelled(docs.selectExpr("doc_id", "text", "lang", "crc32(cast(doc_id as string)) % 5 = 0 as held_out")))
    plain = {r[0]: model.predict(r[1]) for r in before}
    want = [r for r in before if plain[r[0]][0] != "und" and plain[r[0]][1] >= 0.5]
    before = step("language_id")
    assert before == want

    brute = test_lines.brute([r[:3] for r in before])
    want = [(i, brute[i][0], lang, source, len(brute[i][0])) for i, _, lang, source, _ in before if not brute[i][2] or brute[i][0].split()]
    before = step("line_dedup")
    assert before == want

    groups = test_jaccard.brute([r[:3] for r in before])
    want = [r for r in before if groups[r[0]][1] == r[0]]
    before = step("near_duplicates")
    assert before == want

    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    cut = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))}
    common = [r[:3] for r in before if any(cut(r[1]) & cut(t) or len((t or "").split()) < 5 for _, t in items)]  # a window that passes shares a shingle
    bad = {i for i, _ in test_decontam.brute(common, [(*i, "") for i in items])}
    want = [r for r in before if r[0] not in bad]
    before = step("decontamination")
    assert before == want and bad

    enc, placed = packing.WordEncoder(packing.tokenizer_path()).whole, {}
    ids = {r[0]: [*enc.encode(r[1], add_special_tokens=False).ids, 0] for r in before}
    for p in stages["packing"](spark, docs, DIR).collect():
        one = ids[p.doc_id][p.start : p.start + p.length]
        assert p.start == 2048 * p.piece and p.length == len(one) and (p.length == 2048 or p.start + p.length == len(ids[p.doc_id]))
        placed.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sum(n for s in placed.values() for _, n in s) == sum(map(len, ids.values()))
    for s in placed.values():
        s.sort()
        assert s[-1][0] + s[-1][1] <= 2048 and all(a == sum(n for _, n in s[:k]) for k, (a, _) in enumerate(s))


def test_stages_take_odd_rows(spark):
    """Nulls in any column, ids that repeat, empty texts and an empty table pass through every stage."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "one of a kind", None, None, 3), (None, "another one of them", "en", "x", 3), (1, "", "en", None, 0), (1, "some words that stand here once", "en", "s", 1)], docs.schema)
    for start in (docs.unionByName(odd), docs.where("false")):
        now, n = start, start.count()
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.stash(stage(spark, now, DIR), name)
            assert name == "packing" or now.count() <= n
