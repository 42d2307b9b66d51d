"""Three stages from all records to a few for every asker: shared words by a kept index, then likeness of embeddings, then a rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators import classes, evaluate, index, phrases, rank
from talus.sources.scratch import stash

C, L = F.col, F.lit
# The parts of the rubric, 100 points together; and how many signals are full confidence.
WEIGHTS = {"keyword": 15, "semantic": 25, "domain": 15, "technique": 20, "experience": 15, "activity": 10}
SIGNALS = 10


def shared_parts(askers: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what each asker asks for: query_id, term, weight; what each record has: id, term, w). A shared word counts 1, a field 5, a skill within the text 3.

    askers: id, words, fields, skills (arrays). records: id, words, fields, text. Skills are found in the texts by an automaton,
    so no asker meets a record for it.
    """
    kinds = (("words", "w:", 1), ("fields", "f:", 5))
    each = lambda df, i: [df.select(C("id").alias(i), F.explode(F.transform(F.array_distinct(c), lambda x: F.concat(L(mark), x))).alias("term"), L(n).alias("weight")) for c, mark, n in kinds]  # noqa: B023, E731
    skills = askers.select("id", F.explode(F.array_distinct(F.transform("skills", F.lower))).alias("key")).where("key <> ''")
    lexicon = stash(skills.groupBy("key").agg(F.min("id").alias("ordinal")).select("key", F.xxhash64("key").alias("ordinal")), "skills")
    met = phrases.held_keys(records.select("id", "text"), F.lower("text"), lexicon).join(lexicon, "ordinal")
    asked = [*each(askers, "query_id"), skills.select(C("id").alias("query_id"), F.concat(L("s:"), "key").alias("term"), L(3).alias("weight"))]
    has = [*each(records, "id"), met.select("id", F.concat(L("s:"), "key").alias("term"), L(3).alias("weight"))]
    union = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union(asked), union(has).select("id", "term", L(1).alias("w"))


def by_words(askers: DataFrame, records: DataFrame, k: int = 100) -> DataFrame:
    """query_id, id, score, rank: the k records with the most shared parts; where fewer share any, those with the least ids fill up.

    Askers with equal parts are one class, and so are records. A class has its least id, so a record among the k best has its class
    among the k best classes, and of a class the k least ids are enough.
    """
    q_of, q = classes.grouped(askers.select("id", "words", "fields", "skills"), ["words", "fields", "skills"], "asker")
    r_of, r = classes.grouped(records.select("id", "words", "fields", "text"), ["words", "fields", "text"], "kind")
    asked, has = shared_parts(q, r)
    found = index.top_k(index.build(has), asked, k).select(C("query_id").alias("asker"), C("id").alias("kind"), C("score").cast("long").alias("score"))
    some = stash(rank.top_k_by(r_of.select("id", "kind"), ["kind"], k, C("id")).select("id", "kind"), "members")
    found = found.join(some, "kind").select("asker", "id", "score")
    # of the 2k least ids at least k are not among those found, or there are no more
    least = records.orderBy("id").limit(2 * k).select("id")
    rest = q.select(C("id").alias("asker")).join(F.broadcast(least)).withColumn("score", L(0).cast("long"))
    both = found.unionByName(rest).groupBy("asker", "id").agg(F.max("score").alias("score"))
    best = stash(rank.top_k_by(both, ["asker"], k, C("score").desc(), C("id")), "best")
    return q_of.select(C("id").alias("query_id"), "asker").join(best, "asker").select("query_id", "id", "score", "rank")


def by_likeness(first: DataFrame, vectors: DataFrame, cosine, k: int = 30) -> DataFrame:
    """first with cosine, stage2 and place: the k best by their score and 50 times the cosine of vectors (id, v); without either vector by the score."""
    one, two = vectors.toDF("query_id", "a"), vectors.toDF("id", "b")
    met = first.join(one, "query_id", "left").join(two, "id", "left").withColumn("cosine", cosine(C("a"), C("b"))).drop("a", "b")
    met = met.withColumn("stage2", F.round(C("score") + F.coalesce(50 * C("cosine"), L(0.0)), 4))
    return rank.top_k_by(met.drop("rank"), ["query_id"], k, C("stage2").desc(), C("score").desc(), C("id")).withColumnRenamed("rank", "place")


def activity(h: Column, works: Column) -> Column:
    return 0.7 * F.least(h / 100.0, L(1.0)) + 0.3 * F.least(works / 500.0, L(1.0))


def rubric(pairs: DataFrame) -> DataFrame:
    """pairs with the points of each part, total, quality, confidence, reasons and concerns.

    pairs: words, fields, text, h, works, email, website, lab of the record; q_words, q_fields, q_skills, q_level, q_lab, q_funding of
    the asker; cosine, null where either has no embedding.
    """
    shared = F.array_intersect("q_words", "words")
    fields = F.array_intersect("q_fields", "fields")
    skills = F.filter(F.array_distinct(F.transform("q_skills", F.lower)), lambda s: (s != "") & F.contains(F.lower(C("text")), s))
    level = F.coalesce(*[F.when(C("q_level") == v, evaluate.experience_fit(v, C("h"))) for v in ("undergraduate", "masters", "phd", "postdoc")], L(7.5))
    some = lambda c: F.coalesce(c, L("")) != ""
    p = pairs.withColumns({"_shared": shared, "_fields": fields, "_skills": skills})
    part = lambda n, most, of: F.least(F.size(n) / of, L(1.0)) * WEIGHTS[most]
    p = p.withColumns({
        "keyword_points": part("_shared", "keyword", 10), "semantic_points": F.coalesce(C("cosine"), L(0.0)) * WEIGHTS["semantic"], "domain_points": part("_fields", "domain", 2),
        "technique_points": part("_skills", "technique", 3), "experience_points": level, "activity_points": activity(C("h"), C("works")) * WEIGHTS["activity"],
    })
    total = C("keyword_points") + C("semantic_points") + C("domain_points") + C("technique_points") + C("experience_points") + C("activity_points")
    reasons = (F.size("_fields") > 0).cast("int") + (F.size("_skills") > 0).cast("int") + (C("h") >= 50).cast("int")
    signals = F.least(F.size("_shared"), L(5)) + F.least(F.size("_skills"), L(5)) + reasons
    concerns = F.concat_ws(
        "|",
        F.when((C("q_lab") != "any") & (C("lab") != "unknown") & (C("q_lab") != C("lab")), F.concat(L("Lab type mismatch: you prefer "), "q_lab", L(", lab is "), "lab")),
        F.when((C("q_level") == "undergraduate") & (C("h") > 100), "Very senior PI - may have limited time for mentoring"),
        F.when(~some(C("email")) & ~some(C("website")), "No contact information available"),
        F.when((F.size("q_fields") > 0) & (F.size("fields") > 0) & (F.size("_fields") == 0), "Different research domains"),
        F.when(C("q_funding") & ~some(C("email")), "Funding availability unclear - contact professor to inquire"),
    )
    p = p.withColumn("total", F.round(total, 6))
    return p.withColumns({"quality": evaluate.quality(C("total")), "confidence": F.least(signals / float(SIGNALS), L(1.0)), "n_reasons": reasons, "concerns": concerns}).drop("_shared", "_fields", "_skills")
