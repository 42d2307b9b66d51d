"""The older matcher's three stages over the invented people, and rules that need whole tables of candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import rules, text
from talus.operators import cache, funnel, match, rank
from talus.plans.catalog import query
from talus.plans.joins import ADMITTED, _cat, admitted
from talus.plans.people import WITH, lit, people
from talus.plans.reshape import _any, _lab
from talus.sources.scratch import fresh_path, stash

C, L = F.col, F.lit

# Words of a profile's text that are no keywords.
STOPWORDS = "the a an and or but in on at to for of with by from is was are were been be have has had do does did will would could should may might must i my me we our you".split()

_tokens = lambda s: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({s}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 and w not in ({', '.join(map(lit, STOPWORDS))})))"
_parts = lambda s, m: f"list_filter(list_transform(string_split_regex(coalesce({s}, ''), '{m}'), lambda x: trim(x)), lambda x: x <> '')"
_fields = lambda s: "list_filter([" + ", ".join(f"case when {_any(s, v)} > 0 then {lit(k)} end" for k, v in rules.DOMAINS.items()) + "], lambda x: x is not null)"


def _words(c):
    """Words of three letters, digits or _ at least, without stop words."""
    w = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS)))


def _split(c: str, mark: str):
    return F.filter(F.transform(F.split(F.coalesce(c, L("")), mark), lambda x: F.trim(x)), lambda x: x != "")


@query(WITH + f", l as (select id, {_lab} as t, {_any('t', rules.WET_LAB)} as wet, {_any('t', rules.DRY_LAB)} as dry from people) select id, case when {_any('t', ['postdoc', 'post-doctoral', 'research fellow'])} > 0 then 'postdoc' when {_any('t', ['phd', 'doctoral', 'dissertation'])} > 0 then 'phd' when {_any('t', ['master', 'ms ', 'ma ', 'mba'])} > 0 then 'masters' else 'undergraduate' end as level, "
       f"case when wet > 2 * dry then 'wet' when dry > 2 * wet then 'dry' when wet > 0 or dry > 0 then 'mixed' else 'any' end as lab, array_to_string({_fields('t')}, '|') as fields, array_to_string(list_sort({_tokens('t')}), '|') as keywords from l")  # fmt: skip
def V27_profile_rules(t):
    """What rules alone tell of a profile's text where no model is asked: keywords, level, fields, kind of lab."""
    p = people(t).select("id", F.expr(_lab).alias("t"))
    return p.select("id", rules.level(C("t")).alias("level"), rules.lab_kind(C("t")).alias("lab"), F.array_join(rules.domains(C("t")), "|").alias("fields"), F.array_join(F.array_sort(_words(C("t"))), "|").alias("keywords"))


_stages = f"""{WITH}, l as (select *, {_lab} as t, lower(replace(coalesce(topics, ''), '|', ' ')) as tx, {_any('t', rules.WET_LAB)} as wet, {_any('t', rules.DRY_LAB)} as dry from people),
r as (select id, {_tokens('tx')} as words, {_fields('tx')} as fields, tx, coalesce(h_index, 0) as h, works, email, website, case when {_any('tx', rules.WET_LAB)} > 2 * {_any('tx', rules.DRY_LAB)} then 'wet' when {_any('tx', rules.DRY_LAB)} > 2 * {_any('tx', rules.WET_LAB)} then 'dry' when {_any('tx', rules.WET_LAB)} + {_any('tx', rules.DRY_LAB)} > 0 then 'mixed' else 'unknown' end as lab from l),
q as (select id as query_id, list_distinct(list_concat({_tokens('t')}, list_transform({_parts('areas', '[,;]')}, lambda x: lower(x)))) as qw, {_fields('t')} as qf, list_distinct(list_transform({_parts('techniques', '[,;]')}, lambda x: lower(x))) as qs,
case when {_any('t', ['postdoc', 'post-doctoral', 'research fellow'])} > 0 then 'postdoc' when {_any('t', ['phd', 'doctoral', 'dissertation'])} > 0 then 'phd' when {_any('t', ['master', 'ms ', 'ma ', 'mba'])} > 0 then 'masters' else 'undergraduate' end as level,
case when wet > 2 * dry then 'wet' when dry > 2 * wet then 'dry' when wet > 0 or dry > 0 then 'mixed' else 'any' end as qlab, coalesce(accepts, false) as fund from l where id % 50 = 0),
x1 as (select query_id, id, len(list_intersect(qw, words)) + 5 * len(list_intersect(qf, fields)) + 3 * len(list_filter(qs, lambda s: contains(tx, s))) as kw from q, r), s1 as (select * from (select *, row_number() over (partition by query_id order by kw desc, id) as rank from x1) where rank <= 100),
x2 as (select s1.*, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine from s1 left join embeddings a on a.vec_id = query_id left join embeddings b on b.vec_id = id), x2s as (select *, round(kw + coalesce(50 * cosine, 0.0), 4) as stage2 from x2),
s2 as (select * from (select *, row_number() over (partition by query_id order by stage2 desc, kw desc, id) as place from x2s) where place <= 30),
x3 as (select query_id, id, stage2, kw, place, cosine, h, works, email, website, lab, level, qlab, fund, qf, fields, len(list_intersect(qw, words)) as nw, len(list_intersect(qf, fields)) as nf, len(list_filter(qs, lambda s: contains(tx, s))) as ns from s2 join q using (query_id) join r using (id)),
x4 as (select *, round(least(nw / 10, 1) * 15 + coalesce(cosine, 0) * 25 + least(nf / 2, 1) * 15 + least(ns / 3, 1) * 20 + case level when 'undergraduate' then case when h > 120 then 6 when h > 80 then 10.5 else 15 end when 'masters' then 12 when 'phd' then case when h >= 40 then 15 else 9 end else case when h >= 60 then 15 else 7.5 end end
 + (0.7::double * least(h / 100, 1) + 0.3::double * least(works / 500, 1)) * 10, 6)::double as total from x3), s3 as (select *, row_number() over (partition by query_id order by total desc, place) as rank from x4) """


def records(t) -> DataFrame:
    """The people as the older matcher takes them: id, words, fields, text, h, works, email, website, lab."""
    tx = F.lower(F.replace(F.coalesce("topics", L("")), L("|"), L(" ")))
    p = people(t).withColumn("text", tx)
    kind = rules.lab_kind(C("text"))
    return p.select("id", _words(C("text")).alias("words"), rules.domains(C("text")).alias("fields"), "text", F.coalesce("h_index", L(0)).alias("h"), "works", "email", "website", F.when(kind == "any", "unknown").otherwise(kind).alias("lab"))


def askers(t) -> DataFrame:
    """Every person whose id is divisible by 50, as somebody who asks: id, words, fields, skills, level, lab, funding."""
    p = people(t).where("id % 50 = 0").withColumn("t", F.expr(_lab))
    words = F.array_distinct(F.concat(_words(C("t")), F.transform(_split("areas", "[,;]"), F.lower)))
    return p.select("id", words.alias("words"), rules.domains(C("t")).alias("fields"), _split("techniques", "[,;]").alias("skills"), rules.level(C("t")).alias("level"), rules.lab_kind(C("t")).alias("lab"), F.coalesce("accepts", L(False)).alias("funding"))


def _second(t) -> DataFrame:
    return funnel.by_likeness(funnel.by_words(askers(t), records(t)), t("embeddings").select("vec_id", "embedding"), text.cosine)


def _third(t) -> DataFrame:
    a = askers(t)
    asked = a.select(C("id").alias("query_id"), *[C(c).alias(f"q_{c}") for c in a.columns if c != "id"])
    return funnel.rubric(_second(t).join(asked, "query_id").join(records(t), "id"))


@query(_stages + "select query_id, id, kw as score, rank from s1")
def M17_first_stage(t):
    """The hundred records with most shared words, fields and skills for everybody who asks, from a kept index."""
    return funnel.by_words(askers(t), records(t))


@query(_stages + "select query_id, id, stage2 as score, place as rank from s2")
def M18_second_stage(t):
    """Of the first stage's hundred the thirty best by words and embeddings."""
    return _second(t).select("query_id", "id", C("stage2").alias("score"), C("place").alias("rank"))


@query(
    _stages + "select query_id, id, total, round(coalesce(cosine, 0) * 25, 6) as semantic, case when total >= 75 then 'excellent' when total >= 60 then 'good' when total >= 45 then 'moderate' else 'weak' end as quality, least((least(nw, 5) + least(ns, 5) + (nf > 0)::int + (ns > 0)::int + (h >= 50)::int) / 10, 1)::double as confidence, "
    "concat_ws('|', case when qlab <> 'any' and lab <> 'unknown' and qlab <> lab then 'Lab type mismatch: you prefer ' || qlab || ', lab is ' || lab end, case when level = 'undergraduate' and h > 100 then 'Very senior PI - may have limited time for mentoring' end, case when coalesce(email, '') = '' and coalesce(website, '') = '' then 'No contact information available' end, "
    "case when len(qf) > 0 and len(fields) > 0 and nf = 0 then 'Different research domains' end, case when fund and coalesce(email, '') = '' then 'Funding availability unclear - contact professor to inquire' end) as concerns from s3"
)
def M19_third_stage(t):
    """The third stage's rubric over the second's thirty: keywords 15, embeddings 25, fields 15, skills 20, experience 15, activity 10; with confidence and what may trouble."""
    return _third(t).select("query_id", "id", "total", F.round("semantic_points", 6).alias("semantic"), "quality", "confidence", "concerns")


@query(_stages + "select query_id, id, total, rank from s3 where rank <= 20 and total >= 30")
def W10_staged(t):
    """All three stages, one after the other: of all people a hundred, thirty, and the twenty best of at least 30 points."""
    return rank.top_k_by(_third(t), ["query_id"], 20, C("total").desc(), C("place")).where("total >= 30").select("query_id", "id", "total", "rank")


# --- browsing --------------------------------------------------------------------------------------------------------------

_settings = [("", "", "", ""), ("MIT", "", "", ""), ("", "biology", "", "BOSTON"), ("", "", "Physics", ""), ("MIT", "", "", "boston "), ("Harvard University", "cs", "", "NY"), ("no school", "", "", "")]


@query(
    ADMITTED + f", f as (select *, {_cat} as category, 2 * (trim(coalesce(email, '')) <> '')::int + (trim(coalesce(website, '')) <> '')::int + 0.5 * (h_index is not null)::int as priority from admitted), st as (select * from (values "
    + ", ".join(f"({k}, {', '.join(map(lit, v))})" for k, v in enumerate(_settings)) + ") v(setting, ss, sc, sd, sl)), o as (select *, case when sl in (select location from admitted where trim(coalesce(location, '')) <> '') then sl else '' end as loc from st) "
    "select setting, id, row_number() over (partition by setting order by priority desc, id) as place from o join f on (ss = '' or school = ss) and (sc = '' or category = sc) and (sd = '' or coalesce(department, '') = sd) and (loc = '' or contains(coalesce(location, ''), loc))"
)
def F1_browse(t):
    """Who is shown under several settings of the four choices; an empty choice is off, and so is a location that nobody has. By what is known of a person."""
    f = admitted(t).withColumn("category", rules.category(F.coalesce("department", L("")))).withColumn("priority", match.display_priority(C("email"), C("website"), C("h_index")))
    f = stash(f.select("id", "school", "category", "department", "location", "priority"), "shown")
    out = None
    for k, (school, category, subfield, location) in enumerate(_settings):
        one = match.browse(f, school, category, subfield, location).select(L(k).alias("setting"), "id", "priority")
        one = rank.places(one, "place", C("priority").desc(), C("id")).select("setting", "id", "place")
        out = one if out is None else out.unionByName(one)
    return out


@query(WITH + "select id, (2 * (trim(coalesce(email, '')) <> '')::int + (trim(coalesce(website, '')) <> '')::int + 0.5 * (h_index is not null)::int)::double as priority from people")
def M23_display_priority(t):
    return people(t).select("id", match.display_priority(C("email"), C("website"), C("h_index")).alias("priority"))


# --- unions and lists ------------------------------------------------------------------------------------------------------

_key = "lower(trim(coalesce(name, '')))"


@query(WITH + f", k as (select id, {_key} as key from people where {_key} <> ''), a as (select key, max(id) as id, min(id) as first from k where id % 3 <> 0 group by 1), b as (select key, min(id) as id from k where id % 3 = 0 and key not in (select key from a) group by 1) select key, id, 'left' as side from a union all select key, id, 'right' from b")
def D4_left_preferred(t):
    """One row a name of two lists: the left list's last row with it, or else the right list's first."""
    k = people(t).select("id", F.lower(F.trim(F.coalesce("name", L("")))).alias("key"))
    return rank.left_preferred(k.where("id % 3 <> 0"), k.where("id % 3 = 0"), "key", "id").select("key", "id", "side")


@query("with a as (select *, row_number() over (order by event_id) as nth from events where event_id % 2 = 0), b as (select *, row_number() over (order by event_id) as nth from events where event_id % 2 = 1) select nth, a.event_id as one, b.event_id as two, a.user_id = b.user_id as same_user from a join b using (nth)")
def J8_two_lists(t):
    """The n-th rows of two lists side by side; lists of different lengths are refused."""
    e = t("events")
    a, b = (e.where(f"event_id % 2 = {k}").select("event_id", "user_id") for k in (0, 1))
    z = rank.zipped(a.toDF("one", "ua"), b.toDF("two", "ub"), C("one"), C("two"))
    return z.select("nth", "one", "two", (C("ua") == C("ub")).alias("same_user"))


# --- sources in order, results by key ---------------------------------------------------------------------------------------

_gone = "trim(coalesce(email, '')) = ''"


@query(
    WITH + f", s1 as (select s_suppkey as id, lower(replace(s_name, '#', '')) || '@orcid.org' as e1 from supplier), s2 as (select page_id as id, 'mail@' || regexp_extract(lower(url), '^(?:[a-z]+://)?([^/?#]*)', 1) as e2 from pages where page_id % 2 = 0), s3 as (select id, c_name as n from people join customer on c_custkey = id), "
    f"k as (select id, row_number() over (order by coalesce(h_index, 0) desc, id) as k from people where {_gone}) select p.id, case when not ({_gone}) then p.email else coalesce(e1, e2, case when k.k <= 100 then lower(replace(n, '#', '')) || '@fallback.net' end) end as email, "
    f"case when not ({_gone}) then 'own' when e1 is not null then 'orcid' when e2 is not null then 'website' when k.k <= 100 then 'fallback' end as source from people p left join s1 using (id) left join s2 using (id) left join s3 using (id) left join k using (id)"
)
def V38_fill_from_sources(t):
    """Addresses from three tables in order for those without one; the last is asked for the hundred of them with the highest h-index only."""
    p = people(t).select("id", "email", F.coalesce("h_index", L(0)).alias("h"))
    none_ = p.where(F.trim(F.coalesce("email", L(""))) == "")
    asked = rank.top_k(none_.select("id", "h"), 100, C("h").desc(), C("id")).select("id")
    small = lambda c: F.lower(F.replace(C(c), L("#"), L("")))
    sources = {
        "orcid": t("supplier").select(C("s_suppkey").alias("id"), F.concat(small("s_name"), L("@orcid.org")).alias("email")),
        "website": t("pages").where("page_id % 2 = 0").select(C("page_id").alias("id"), F.concat(L("mail@"), text.domain(C("url"))).alias("email")),
        "fallback": t("customer").select(C("c_custkey").alias("id"), F.concat(small("c_name"), L("@fallback.net")).alias("email")).join(asked, "id", "left_semi"),
    }
    return rank.filled(p.select("id", "email"), "email", sources)


_keyed_text = "'Research: ' || coalesce(topics, '') || '. Keywords: ' || coalesce(techniques, '')"


@query(
    WITH + f", k as (select id, left(md5({_keyed_text}), 16) as key, length({_keyed_text}) as size from people), f as (select key, min(id) as f from k group by 1), old as (select distinct key from k where id % 3 = 0) "
    "select id, k.key, size, case when id <> f then 'run' when k.key in (select key from old) then 'table' else 'new' end as outcome from k join f using (key)"
)
def V28_two_level_cache(t):
    """What stands for each person's text, by its key: from this run, from the table that a run over every third person left, or new."""
    tx = F.concat(L("Research: "), F.coalesce("topics", L("")), L(". Keywords: "), F.coalesce("techniques", L("")))
    p = people(t).select("id", tx.alias("t")).select("id", F.left(F.md5("t"), L(16)).alias("key"), "t")
    path = fresh_path(p.sparkSession, "by-key")
    work = lambda rows: rows.select("key", F.length("t").alias("size"))
    cache.looked_up(p.where("id % 3 = 0"), path, work, False)
    return cache.looked_up(p, path, work, True).select("id", "key", C("size").cast("long").alias("size"), "outcome")


_orcid = "case c_custkey % 6 when 0 then 'see https://orcid.org/0000-000' || (c_custkey % 10) || '-1234-567X now' when 1 then c_name || ' 0000-0002-' || (1000 + c_custkey % 9000) || '-' || (1000 + c_nationkey) when 2 then '0000-0001-12-3456' when 3 then 'https://orcid.org/0000-0002-1825-009x' when 4 then '99990000-0002-1825-00971' end"


@query(f"with x as (select c_custkey, {_orcid} as t from customer) select c_custkey, coalesce(regexp_extract(t, '[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{3}}[0-9X]'), '') as orcid from x")
def T37_orcid_forms(t):
    """The first ORCID in texts that have one, have none, or have something like one."""
    x = t("customer").select("c_custkey", F.expr(_orcid).alias("t"))
    return x.select("c_custkey", F.coalesce(F.regexp_extract("t", "[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]", 0), L("")).alias("orcid"))
