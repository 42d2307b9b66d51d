"""The opN_ queries over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import decontam, fim, html_text, jaccard, langid, lines, lmscore, minhash, packing, pii, sharding, spotsigs, whitening


#: Stands for the secret of spark.talus.key, where that is not set, over the invented documents.
DEMO_KEY = "invented-documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay: doc_id, text, n_lines, n_removed. See lines.dedup for nulls, ties and repeats."""
    return lines.dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links at 0.75 of five-word shingles. See jaccard.near_groups."""
    return jaccard.near_groups(_documents(spark, sf_dir))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced: doc_id, text, n_private. See pii.pseudonymize."""
    return pii.pseudonymize(_documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get("spark.talus.key", DEMO_KEY))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from rows that are not held out. See langid.identify."""
    return langid.identify(_documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page. See html_text.extract."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens. See packing.pack."""
    return packing.pack(_documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard. See sharding.shard_by_bytes."""
    out = sharding.shard_by_bytes(_documents(spark, sf_dir), carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and its edited text, and what they are like. See spotsigs.fingerprints."""
    return spotsigs.fingerprints(_documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, score of every document; the target is what labels call good. See lmscore.score."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    # labels grow with the documents, so this is a shuffled join at every size
    docs = _documents(spark, sf_dir).select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    return lmscore.score(docs)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity (six places), start_word of every benchmark item in a document. See decontam.leaks."""
    out = decontam.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("similarity", F.round("similarity", 6))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document rewritten for filling in the middle, and of the text rebuilt from it. See fim.transform."""
    out = fim.transform(_documents(spark, sf_dir).select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links at 0.8 of two-word shingles. See minhash.near_groups."""
    return minhash.near_groups(_documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable embedding. See whitening.whiten."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: The words and sets of op2, links by an inverted join, and components by following links.
_NEAR = r"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
e as (select doc_id, unnest(g) as g from s), n as (select doc_id, len(g) as n from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)), both_ as (select x, y from l union all select y, x from l),
r(doc_id, root) as (select doc_id, doc_id from s union select both_.y, r.root from r join both_ on both_.x = r.doc_id)
select doc_id, any_value(n.n) as n_shingles, min(root) as component_id from r join n using (doc_id) group by 1"""

#: The lines of op1; copies by equal words, near copies by pairs that share their first or last half, verified word by word.
_LINES = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents where text is not null),
m as (select *, doc_id * 1048576 + pos as place, list_filter(string_split_regex(lower(line), '[ \t\r\f\x0b]+'), lambda w: w <> '') as w from l),
u as (select w, len(w) as n, min(place) as first from m where len(w) > 0 group by w),
k as (select *, unnest([n, n, n - 1, n - 1]) as s, unnest(['first', 'last', 'first', 'last']) as side from u where n >= 7),
h as (select first, n, w, s, side, case side when 'first' then w[1:s // 2] else w[n - s + s // 2 + 1:n] end as h from k),
c as (select distinct a.first as early, a.w as x, b.first as late, b.w as y from h a join h b on a.s = b.s and a.side = b.side and a.h = b.h and a.first < b.first and abs(a.n - b.n) <= 1 and greatest(a.n, b.n) >= 8),
v as (select late, coalesce(nullif(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false), 0) - 1, least(len(x), len(y))) as front, coalesce(nullif(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[-i] = y[-i]), false), 0) - 1, least(len(x), len(y))) as back, greatest(len(x), len(y)) as most from c),
gone as (select m.place from m join u using (w) where m.place > u.first union select late from v where front + back >= most - 1)
select d.doc_id, case when d.text is null then null else coalesce(string_agg(m.line, chr(10) order by m.pos) filter (where m.place not in (select place from gone)), '') end as text, cast(count(m.place) as int) as n_lines, cast(count(m.place) filter (where m.place in (select place from gone)) as int) as n_removed
from documents d left join m on m.doc_id = d.doc_id group by d.doc_id, d.text"""


_SPLIT = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: The windows of op10: every one of an item's size in the documents that hold enough of it, compared on the whole sets.
_LEAKS = rf"""with i0 as (select distinct item_id, text from benchmark where text is not null), it as (select item_id, {_SPLIT.format('text')} as w from i0), total as (select count(*) as n from i0),
ig as (select item_id, len(w) as size, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as g from it where len(w) >= 5),
wt as (select g, ln(1 + (select n from total) / count(*)) as weight from ig group by g), iw as (select item_id, size, g, weight, sum(weight) over (partition by item_id) as whole from ig join wt using (g)),
d as (select doc_id, {_SPLIT.format("coalesce(text, '')")} as w from documents), dg as (select doc_id, len(w) as n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g, unnest(range(0, len(w) - 4)) as pos from d where len(w) >= 5),
hit as (select doc_id, n, item_id, size, whole, min(pos) as low, max(pos) as high from (select dg.*, item_id, size, whole, weight, row_number() over (partition by doc_id, item_id, dg.g order by pos) as k from dg join iw using (g)) group by all having sum(weight) filter (where k = 1) >= 0.7499999 * whole),
win as (select doc_id, item_id, size, whole, unnest(range(greatest(0, least(low - size + 5, n - size)), least(high, greatest(0, n - size)) + 1)) as a from hit),
inside as (select distinct win.doc_id, win.item_id, win.whole, win.a, dg.g from win join dg on dg.doc_id = win.doc_id and dg.pos between win.a and win.a + win.size - 5),
sim as (select doc_id, inside.item_id, a, coalesce(sum(weight), 0) / (inside.whole + ln(1 + (select n from total)) * count_if(weight is null)) as s from inside left join iw on iw.item_id = inside.item_id and iw.g = inside.g group by doc_id, inside.item_id, a, inside.whole),
best as (select doc_id, item_id, s, a, row_number() over (partition by doc_id, item_id order by round(s, 11) desc, a) as r from sim where s >= 0.75 - 1e-9),
short as (select doc_id, item_id, 1.0::double as s, min(a) as a from (select doc_id, item_id, d.w as dw, it.w as iw, unnest(range(0, len(d.w) - len(it.w) + 1)) as a from d, it where len(it.w) between 1 and 4 and len(d.w) >= len(it.w)) where dw[a + 1:a + len(iw)] = iw group by 1, 2)
select doc_id, item_id, round(s, 6) as similarity, a as start_word from best where r = 1 union all select doc_id, item_id, s, a from short"""


#: The lines, cuts and orders of op11, by string functions.
_FIM = r"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
k as (select doc_id, t, u, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
  array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') as p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as m, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') as s from k)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256, sha256(t) as restored_sha256 from c"""


def _near_sql() -> str:
    """op12: as op2, with two words and four fifths."""
    two = _NEAR.replace("len(w) < 5", "len(w) < 2").replace("range(1, len(w) - 3)", "range(1, len(w))").replace("w[i:i + 4]", "w[i:i + 1]").replace(">= 75 *", ">= 80 *")
    return f"select *, doc_id = component_id as kept from ({two})"


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others need a tokenizer, a trained model, keyed hashes or a parser."""
    return {"op1_line_dedup": _LINES, "op2_ngram_jaccard_join": _NEAR, "op10_benchmark_decontamination": _LEAKS, "op11_fill_in_middle": _FIM, "op12_minhash_near_dedup": _near_sql()}
