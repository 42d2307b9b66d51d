"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is its words in lower case. Lines with equal words are copies. Two lines are near copies when one word inserted,
deleted or replaced makes them equal and that is at most one word in SHARE of the longer line's: an edit bound of
floor(words / SHARE), at most one. Of copies and near copies the earliest stays.

Near copies are found by keys: every line emits a hash of each of its variants with one word deleted (with the place and the
length, so that lines which differ in that word meet), and of itself (so that it meets the lines that have one word more).
Keys only ask for the earliest line of each group, never for pairs. Only lines that share their first or last words (nearly
half of them) with another line emit variants: one edit leaves the ones or the others as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.store import fresh, numbered, stash

#: One edit makes near copies where the longer line has at least so many words.
SHARE = 8

class Places:
    """How (doc, pos) is one number in order of both: a long where ids and lengths of texts leave room, else a decimal."""

    def __init__(self, docs: DataFrame):
        least, most, size = docs.agg(F.min("doc"), F.max("doc"), F.max(F.octet_length("text"))).first()
        bits = max(1, (size or 0).bit_length())  # a text has fewer lines than bytes, or one
        shift = 1 << bits
        if least is None or 0 <= least and most < 1 << (63 - bits):
            self.place, self.doc, self.pos = f"(doc * {shift}L + pos)", f"(place div {shift}L)", f"cast(place % {shift}L as int)"
        else:
            shift = "4294967296"
            self.place = f"((cast(doc as decimal(20,0)) + 9223372036854775808BD) * {shift}BD + pos)"
            self.doc = f"cast(cast((place - place % {shift}BD) / {shift}BD as decimal(38,0)) - 9223372036854775808BD as bigint)"
            self.pos = f"cast(place % {shift}BD as int)"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, line) of every line that has words."""
    every = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a filter on the words themselves would split every line twice
    return every.where(F.col("line").rlike("[^ \\t\\r\\f\\x0b]")).select("doc", "pos", _words("line").alias("words"))


def _words(line: str):
    """The words of a line in lower case; one empty word if it has none."""
    return F.split(F.expr(f"trim(both ' \t\r\f\x0b' from lower({line}))"), "[ \t\r\f\x0b]+")


def _run(n: str) -> str:
    """The longest run of words, of the lengths 1, 2, 3, 4, 6, 8, 12, 16 and so on, that two of in a line of n don't overlap."""
    base = f"shiftleft(1, length(bin({n} div 2)) - 1)"
    return f"if(2 * ({n} div 2) >= 3 * {base}, 3 * {base} div 2, {base})"


def _ends() -> str:
    """Keys of the first and last words of a line w of n words, by p1 of them and by p2, the run for a line of one word less."""
    both = lambda p: f"xxhash64(slice(w, 1, {p}), {p}, 'first'), xxhash64(slice(w, n - {p} + 1, {p}), {p}, 'last')"
    return f"case when n < {SHARE - 1} then null when p1 = p2 then array({both('p1')}) else array({both('p1')}, {both('p2')}) end"


def near_lines(first: DataFrame, docs: DataFrame, at_: Places) -> DataFrame:
    """Places of those first occurrences that have a near copy at an earlier place."""
    keys = first.select("place", F.posexplode("ends").alias("side", "key"))
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    some = keys.join(shared, "key").groupBy("place").agg(F.max(F.col("side") % 2 == 0).alias("first"), F.max(F.col("side") % 2 == 1).alias("last"))
    some = some.select("first", "last", F.expr(at_.doc).alias("doc"), F.expr(at_.pos).alias("pos"))
    at = some.groupBy("doc").agg(F.collect_list(F.struct("pos", "first", "last")).alias("at"))
    text = docs.join(at, "doc").select("doc", F.inline("at"), "text")
    text = text.select("doc", "pos", "first", "last", F.expr("split(text, '\n')[pos]").alias("line")).where("line is not null")
    base = stash(text.select(F.expr(at_.place).alias("place"), F.transform(_words("line"), lambda w: F.xxhash64(w)).alias("w"), "first", "last").dropDuplicates(["place"]), "near_lines")

    # where the first words are shared the edit lies behind them, where the last are, before them
    run = _run("(n - 1)")
    edits = f"filter(sequence(1, n), i -> (first and i > {run}) or (last and i <= n - {run}))"
    variant = "xxhash64(concat(slice(w, 1, i - 1), slice(w, i + 1, size(w))))"
    each = base.withColumn("n", F.size("w")).where(F.col("n") >= SHARE).select("place", "w", "n", F.explode(F.expr(edits)).alias("i")).select("place", "n", "i", F.expr(variant).alias("v"))
    rows = each.select("place", F.explode(F.expr("array(struct(xxhash64(v, i, n) as key, 2 as role), struct(xxhash64(v, 'less') as key, 1 as role))")).alias("r")).select("place", "r.key", "r.role")
    rows = rows.unionByName(base.select("place", F.expr("xxhash64(xxhash64(w), 'less')").alias("key"), F.lit(0).alias("role")))
    low = lambda k: F.min(F.when(F.col("role") == k, F.col("place")))
    groups = rows.groupBy("key").agg(low(0).alias("m0"), low(1).alias("m1"), low(2).alias("m2"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = rows.join(groups, "key").select("place", F.expr("case role when 2 then m2 when 1 then m0 else m1 end").alias("other")).where("other < place")
    pairs = met.groupBy("place").agg(F.collect_set("other").alias("others")).select("place", F.explode("others").alias("other"))
    both = pairs.join(base, "place").join(base.select(F.col("place").alias("other"), F.col("w").alias("o")), "other")
    same = lambda a, b: f"(array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false))"
    run = lambda a, b: f"if({same(a, b)} = 0, size(w), {same(a, b)} - 1)"
    alike = f"abs(size(w) - size(o)) <= 1 and {run('w', 'o')} + {run('reverse(w)', 'reverse(o)')} >= greatest(size(w), size(o)) - 1"
    return both.where(F.expr(alike)).select("place").distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text rebuilt from the lines that stay, and n_lines and n_removed; needs doc_id and text, all columns stay.

    Order is by doc_id (null first; rows that share one by hash of text), then by line. A line goes when an earlier line is
    its copy or near copy, whether that one itself stays or not. Lines without words stay where they are. Null text stays
    null with no lines; a text whose lines all go is empty. Rows with one doc_id, or none, are documents of their own: a
    repeated row loses all its lines that have words. An empty table gives no rows; texts of any length count whole. Columns named n_lines, n_removed give way.
    """
    kept = docs.drop("n_lines", "n_removed")
    doc, gone, split = (fresh(kept, c) for c in ("_doc", "_gone", "_all"))
    keyed, _ = numbered(kept, doc)
    own = keyed.select(F.col(doc).alias("doc"), F.col("text").cast("string").alias("text"))
    at = Places(own)
    lines = _lines(own).select("doc", "pos", F.transform("words", lambda w: F.xxhash64(w)).alias("w")).withColumn("n", F.size("w"))
    lines = lines.withColumns({"p1": F.expr(_run("n")), "p2": F.expr(_run("(n - 1)"))})
    found = lines.select(F.expr(at.place).alias("place"), F.xxhash64("w").alias("h1"), F.expr("xxhash64('other', w)").alias("h2"), F.expr(_ends()).alias("ends"))
    found = stash(found, "lines")
    groups = found.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("c"))
    again = found.join(groups.where("c > 1").select("h1", "h2", F.col("place").alias("low")), ["h1", "h2"]).where("place > low").select("place")
    lost = again.select("place")
    first = found.where("ends is not null").join(groups.select("place"), "place", "left_semi").select("place", "ends")
    lost = lost.unionByName(near_lines(first, own, at)).select(F.expr(at.doc).alias("doc"), F.expr(at.pos).alias("pos"))
    lost = lost.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("pos").alias(gone))
    out = keyed.join(lost, doc, "left").withColumn(split, F.split(F.col("text").cast("string"), "\n"))
    text = F.when(F.col(gone).isNull(), F.col("text").cast("string")).otherwise(F.array_join(F.expr(f"filter({split}, (x, k) -> not array_contains({gone}, k))"), "\n"))
    sizes = {"n_lines": F.coalesce(F.size(split), F.lit(0)), "n_removed": F.coalesce(F.size(gone), F.lit(0))}
    return out.withColumns({"text": text, **sizes}).select(*kept.columns, "n_lines", "n_removed")
