"""SpotSigs fingerprints in DataFrame operations only: chains of content words that follow common-word anchors.

A text's signatures are hashes of (anchor, three content words that follow). Fingerprints are compared by Jaccard;
partitions by set length prune pairs whose lengths alone rule out the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.store import parts

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be been but by for from had has have he in is it of on or she that the their they this to was were which will with would "
    "auf aus das dem den der des die ein eine einem einen einer für im ist mit nicht sich sind und von war wird zu zum zur "
    "au aux avec dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "al como con del el es esta este las lo los más no para pero por su sus una y"
).split()


def signatures(docs: DataFrame, text: str, to: str) -> DataFrame:
    """docs with the column to: the sorted distinct signatures of column text (null: empty).

    The start of a text counts as an anchor. Where no other anchor has a content word behind it (tables, lists, other languages),
    all chains of three content words count, so that the whole text tells. A text of anchors only has one signature of all
    its words, and a text without words one of its characters, so equal texts always have equal signatures and every text
    has one at least.
    """
    words = f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> t <> '')"
    listed = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))
    out = docs.withColumn("_t", F.expr(f"transform({words}, t -> struct(xxhash64(t) as h, t in ({listed}) as a))"))
    before = "concat(array(struct(0L as h, true as a)), slice(_t, 1, greatest(size(_t) - 1, 0)))"
    out = out.withColumn("_c", F.expr(f"filter(zip_with(_t, {before}, (x, p) -> struct(x.h as h, x.a as a, p.h as ph, p.a as pa)), x -> not x.a)"))
    out = out.withColumn("_w", F.expr("not exists(_c, x -> x.pa and x.ph <> 0L)"))
    pairs = "zip_with(_c, slice(_c, 2, greatest(size(_c), 1)), (x, y) -> struct(x.pa as pa, x.ph as ph, x.h as h, y.h as n1))"
    chains = f"zip_with({pairs}, slice(_c, 3, greatest(size(_c), 1)), (x, y) -> if(x.pa or _w, xxhash64(if(_w, 0L, x.ph), x.h, coalesce(x.n1, 1L), coalesce(y.h, 2L)) & 4294967295L, null))"
    kept = f"array_sort(array_distinct(filter({chains}, s -> s is not null)))"
    whole = f"array(xxhash64(if(size(_t) > 0, cast(transform(_t, x -> x.h) as string), coalesce({text}, ''))) & 4294967295L)"
    return out.withColumn(to, F.expr(f"if(size(_c) > 0, {kept}, {whole})")).drop("_t", "_c", "_w")


def printed(signature: str) -> Column:
    """A fingerprint as text: its signatures as eight hex digits each."""
    return F.expr(f"array_join(transform({signature}, s -> lpad(lower(hex(s)), 8, '0')), '')")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without a comparison where their lengths already keep it below least."""
    short, long_ = f"least(size({a}), size({b}))", f"greatest(size({a}), size({b}))"
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"if({short} < {least}D * {long_}, 0D, {both} / cast(size({a}) + size({b}) - {both} as double))")


def length_bands(n: Column, least: float) -> Column:
    """The band of a set length; sets whose Jaccard can reach least are in one band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(least))).cast("int")


def near_pairs(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, likeness) of classes of docs whose fingerprints are at least so alike, a < b; a class is named by its least doc_id.

    docs needs doc_id and text. Each set's rarest signatures, as many as one of a pair must share, are keys within its length
    band and the next; equal fingerprints form one class, so a group of copies is one row here. Empty tables give none.
    """
    sigs = signatures(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", "s").groupBy("s").agg(F.min("doc_id").alias("id"))
    each = sigs.select("id", F.size("s").alias("n"), F.explode("s").alias("k"))
    ranked = each.join(each.groupBy("k").agg(F.count("*").alias("f")), "k").where("f > 1")
    rare = ranked.groupBy("id", "n").agg(F.expr("array_sort(collect_list(struct(f, k)))").alias("o"))
    rare = rare.join(sigs.select("id", "s"), "id").select("id", "n", "s", F.expr(f"slice(o, 1, cast(n - ceil({least}D * n) + 1 as int))").alias("o"))
    keys = rare.select("id", "n", "s", F.explode("o.k").alias("k")).withColumn("band", length_bands(F.col("n"), least))
    one, two = keys.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), "k", F.explode(F.array("band", F.col("band") + 1)).alias("band")), keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), "k", "band")
    met = one.join(two, ["k", "band"]).where(f"a <> b and least(na, nb) >= {least}D * greatest(na, nb)")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness("sa", "sb", least).alias("likeness"))
    return met.where(F.col("likeness") >= least).dropDuplicates(["a", "b"])


def with_next(docs: DataFrame, cols: list[str], make=None) -> DataFrame:
    """docs (doc_id, text, ...) with next_<c> of the row that follows in order of doc_id and text; after the last comes the first.

    Rows are dealt to ranges of doc_id. The first row of each range closes the one before it, so no task sees more than a range.
    make adds columns of cols that docs lacks; it is given each row once, and the first ones of ranges a second time.
    """
    n = max(1, min(parts(docs.sparkSession), 1000))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    docs = docs.withColumn("_id", id_)
    cuts = docs.agg(F.percentile_approx("_id", [k / n for k in range(1, n)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.expr(f"size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c <= _id))") if cuts else F.lit(0)
    if cuts and cuts[0] == -(2**63):
        bucket = F.expr(f"size(filter(array({', '.join('(-9223372036854775807L - 1L)' if c == -(2**63) else f'{c}L' for c in cuts)}), c -> c <= _id))")
    docs = docs.withColumn("_bucket", bucket)
    heads = sorted((r["_bucket"], r["low"]) for r in docs.groupBy("_bucket").agg(F.min("_id").alias("low")).collect())
    if not heads:
        docs = make(docs) if make else docs
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in cols]).drop("_id", "_bucket")
    before = {b: heads[k - 1][0] for k, (b, _) in enumerate(heads)}
    spark = docs.sparkSession
    low = spark.createDataFrame([(b, i, before[b]) for b, i in heads], "_bucket int, _id long, _to int")
    first = docs.join(F.broadcast(low), ["_bucket", "_id"]).withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy("text"))).where("_n = 1")
    first = first.withColumns({"_bucket": F.col("_to"), "_end": F.lit(1)}).drop("_to", "_n")
    both = docs.withColumn("_end", F.lit(0)).unionByName(first)
    both = make(both) if make else both
    w = Window.partitionBy("_bucket").orderBy("_end", "_id", "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols}).where("_end = 0").drop("_end", "_id", "_bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs its fingerprint, that of its edited text, and its likeness to that and to the next document's.

    docs needs doc_id and text; other columns are ignored. The edited text has the last quarter of its code points (rounded
    down) replaced by as many first ones of the next document in order of doc_id (ties by text, null first; after the last
    row the first). Null texts count as empty. Repeated rows follow each other. Texts of any length count whole. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(own, ["text", "s"], lambda rows: signatures(rows, "text", "s"))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    cut = "cast(floor(n_chars / 4) as int)"
    both = both.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {cut}), substring(next_text, 1, {cut}))")).drop("text", "next_text")
    both = signatures(both.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "e")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", printed("s").alias("fingerprint"), printed("e").alias("edited_fingerprint"),
        likeness("s", "e").alias("near_edited"), likeness("s", "next_s").alias("near_next"),
    )
