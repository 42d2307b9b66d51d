"""Queries of the matcher over the invented people, with SQL that works out the same points from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import lexicon
from talus.operators import matcher, rank
from talus.plans.catalog import query
from talus.plans.people import PEOPLE, any_sql, lit, people, pick

C, L = F.col, F.lit

NOW, TODAY = 2024, "2024-01-01"
EVIDENCE = [None, "Deep learning for medical imaging", "", "Collaborative study of gene expression and the immune system", "drug discovery with graph neural networks", "statistics", "solar cells at scale"]
REQUIRED = ["", "python|sql", None, "qPCR|western blotting|facs|matlab", "py", "ngs"]
MATCHED = {
    "text": "concat_ws(' ', areas, replace(topics, '|', ' '))", "topics_text": "replace(topics, '|', ' ')", "evidence": pick(EVIDENCE, "id"), "required_text": pick(REQUIRED, "id"),
    "age_days": "case when id % 4 = 0 then null else (id * 37) % 500 end", "email_verified": "case when id % 3 = 0 then true when id % 3 = 2 then false end",
}
WANTED = ["deep learning for genomics", "natural language processing, machine learning", "qqq zzz", "solar cells and energy storage", "", "immunology of cancer", "statistics of public health", "human-computer interaction and robotics", "the study of data"]
PROFILES = {
    "id": "id", "text": pick(WANTED, "k"), "level": pick(["phd", "undergrad", ""], "k"), "intent": pick(["join_now", "explore", "mentorship", "other", ""], "k"),
    "needs_funding": "case when k % 4 = 0 then true when k % 4 = 1 then false end", "skills_text": pick(["python3|Imaging", "", None, "r|sql|PCR", "stats"], "k"),
    "remote_ok": "case when k % 3 = 1 then true when k % 3 = 2 then false end", "location": pick(["boston", "", None, "NY"], "k"),
}
_words = "list_filter(list_transform(string_split_regex(coalesce({0}, ''), '{1}'), lambda x: trim(x)), lambda x: x <> '')"
_lists = f"{_words.format('required_text', '[|]')} as required, {_words.format('techniques', '[,;]')} as tech"
PEOPLE_SQL = f"with people as (select {', '.join(f'{v} as {k}' for k, v in PEOPLE.items())} from customer), m0 as (select *, {', '.join(f'{v} as {k}' for k, v in MATCHED.items())} from people), m as (select *, {_lists} from m0) "
PROFILES_SQL = f", q0 as (select id, cast(floor(id / 50) as bigint) as k from people where id % 50 = 0), q as (select {', '.join(f'{v} as {k}' for k, v in PROFILES.items())}, {_words.format(pick(['python3|Imaging', '', None, 'r|sql|PCR', 'stats'], 'k'), '[|]')} as skills from q0) "


def matched(t) -> DataFrame:
    """The people with what the matcher needs."""
    p = people(t).selectExpr("*", *[f"{v} as {k}" for k, v in MATCHED.items()])
    part = lambda c, mark: F.filter(F.transform(F.split(F.coalesce(c, L("")), mark), lambda x: F.trim(x)), lambda x: x != "")
    return p.withColumns({"required": part(C("required_text"), "[|]"), "techniques": part(C("techniques"), "[,;]"), "last_update": F.date_sub(L(TODAY).cast("date"), C("age_days").cast("int"))})


def profiles(t) -> DataFrame:
    """Every person whose id is divisible by 50 asks, with wishes of its own."""
    q = people(t).where("id % 50 = 0").select("id", F.floor(C("id") / 50).alias("k")).selectExpr(*[f"{v} as {k}" for k, v in PROFILES.items()])
    return q.withColumn("skills", F.filter(F.split(F.coalesce("skills_text", L("")), "[|]"), lambda x: x != ""))


def listed(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def terms_sql(name: str, source: str, column: str = "text") -> str:
    """CTEs that end in name (id, term, w, most): the weighted terms of a column of source. A field is on by itself or, for two of them, by the first."""
    on = lambda k: f"contains(t, {lit(k)})" + (" or contains(t, 'machine learning')" if k in ("deep learning", "artificial intelligence") else "")
    more = ", ".join(f"case when {on(k)} then {listed(v)} else [] end" for k, v in lexicon.ONTOLOGY.items())
    return f""", {name}_t as (select id, lower(coalesce({column}, '')) as t from {source}), {name}_x as (select id, unnest(regexp_extract_all(t, '[a-z0-9]+')) as term, 10 as w from {name}_t
union all select id, unnest(list_filter({listed(lexicon.PHRASES)}, lambda p: contains(t, p))), 30 from {name}_t union all select id, unnest(flatten([{more}])), 7 from {name}_t),
{name}_s as (select id, term, sum(w)::bigint as w from {name}_x where w <> 10 or (length(term) >= 3 and term not in ({', '.join(map(lit, lexicon.STOPWORDS))})) group by 1, 2),
{name} as (select id, term, w, max(w) over (partition by id) as most from {name}_s) """


def overlap_sql(name: str, asked: str, terms: str) -> str:
    return f""", {name} as (select query_id, id, n_both, n_both / (n_q + n_e - n_both) as jaccard, dot / (most * q_w) as overlap, matched from
(select a.id as query_id, b.id, count(*) as n_both, sum(a.w * b.w)::bigint as dot, max(b.most) as most, list(a.term order by a.w desc, a.term)[1:8] as matched from {asked} a join {terms} b using (term) group by 1, 2)
join (select id as query_id, count(*) as n_q, sum(w)::bigint as q_w from {asked} group by 1) using (query_id) join (select id, count(*) as n_e from {terms} group by 1) using (id)) """


_p_terms, _q_terms = terms_sql("pt", "m"), terms_sql("qt", "q")


@query(PEOPLE_SQL + _p_terms + "select id, term, w / most as weight from pt")
def M1_terms(t):
    return matcher.all_terms(matched(t)).select("id", "term", (C("w") / C("most")).alias("weight"))


@query(PEOPLE_SQL + PROFILES_SQL + _p_terms + _q_terms + overlap_sql("o", "qt", "pt") + "select query_id, id, n_both, jaccard, overlap, array_to_string(matched, '|') as matched from o")
def M2_overlap(t):
    return matcher.all_overlaps(profiles(t), matched(t), "|")


_even = lambda x: f"cast(round_even(round({x}, 9), 0) as int)"
_topic = f"least(40, greatest({_even('(0.4::double * jaccard + 0.4::double * overlap + 0.2::double * least(1.0::double, n_both / 3)) * 28')}, case when n_both >= 2 then 8 when n_both >= 1 then 4 else 0 end))"
_skill = lambda a: f"list_distinct(list_transform({a}, lambda s: case " + " ".join(f"when lower(trim(s)) in ({', '.join(map(lit, (k, *v)))}) then {lit(k)}" for k, v in lexicon.SKILLS.items()) + " else lower(trim(s)) end))"
_rec = f"case when coalesce(last_year, 0) <= 0 then 0.0 when greatest(0, {NOW} - last_year) <= 2 then 1.0 when {NOW} - last_year <= 8 then (8 - ({NOW} - last_year)) / 6 else 0.0 end::double"
_has = lambda c: f"coalesce({c}, '') <> ''"
_scored = (
    PEOPLE_SQL + PROFILES_SQL + _p_terms + _q_terms + terms_sql("et", "m", "evidence") + overlap_sql("o", "qt", "pt") + overlap_sql("eo", "qt", "et")
    + f""", words as (select distinct id as query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as term from q),
hit as (select query_id, pt.id, count(*) as hits from words join pt using (term) where length(term) >= 3 and term not in ({', '.join(map(lit, lexicon.STOPWORDS))}) group by 1, 2),
cand as (select * from hit union all select q.id, m.id, 0 from q, m where q.id not in (select query_id from hit)),
j as (select cand.query_id, cand.hits, m.*, q.text as qtext, q.level as qlevel, q.intent as qintent, q.needs_funding as qfund, q.remote_ok as qremote, coalesce(q.location, '') as qloc, {_skill('q.skills')} as own, {_skill('m.required')} as req, {_skill('m.tech')} as pref,
len(q.skills) > 0 as qskills, o.n_both, o.jaccard, o.overlap, o.matched, coalesce(eo.overlap, 0) as covered from cand join q on q.id = cand.query_id join m on m.id = cand.id left join o on o.query_id = cand.query_id and o.id = cand.id left join eo on eo.query_id = cand.query_id and eo.id = cand.id),
k as (select *, len(list_intersect(own, req)) as rh, case when len(pref) > 0 then len(list_intersect(own, pref)) / len(pref) else 0 end as pr, coalesce(accepts = false, false) or coalesce(qremote and remote_ok = false, false) as blocked,
{_has('trim(qtext)')} and {_has('trim(text)')} as a1, {_has('evidence')} or coalesce(last_year > 0, false) or coalesce(grants > 0, false) as a2, qskills or len(required) > 0 or len(tech) > 0 as a3,
join_page is not null or openings is not null or age_days is not null or {_has('website')} or {_has('email')} as a4, {_has('qlevel')} or accepts is not null or qremote is not null or remote_ok is not null or qloc <> '' or {_has('location')} as a5,
{_has('qintent')} or qfund is not null or grants is not null or join_page is not null or openings is not null as a6, {_has('email')} or {_has('website')} or email_verified is not null as a7 from j),
p0 as (select *, case when a1 then coalesce({_topic}, 0) else 0 end as topic_points,
case when not a2 then 0 when trim(coalesce(evidence, '')) = '' then case when grants > 0 then 8 else 0 end else {_even(f'15 * least(1.0::double, 0.8::double * covered + 0.2::double * {_rec})')} end as evidence_points,
case when not a3 then 0 when len(own) = 0 and len(req) = 0 and len(pref) = 0 then 5 when len(req) > 0 then {_even('5 * least(1.0::double, 0.6::double * rh / len(req) + 0.2::double * (len(req) - rh <= 2)::int + 0.2::double * pr)')} else {_even('5 * least(1.0::double, 0.3::double + 0.5::double * pr + 0.2::double * (len(own) > 0)::int)')} end as skills_points,
case when coalesce(join_page, false) then 4 else 0 end + case when coalesce(openings, false) then 3 else 0 end + case when age_days <= 180 then 2 when age_days <= 365 then 1 else 0 end as act,
10 - 2 * (accepts is null)::int - 2 * (coalesce(qremote, false) and remote_ok is null)::int - 2 * (qloc <> '' and {_has('location')} and not contains(lower(location), lower(qloc)))::int as constraints_points,
case when not a6 then 0 else case case when {_has('qintent')} then qintent else 'join_now' end
when 'join_now' then case when coalesce(openings, false) or coalesce(join_page, false) then 5 else 2 end + case when not coalesce(qfund, false) then 3 when grants > 0 then 5 else 1 end
when 'explore' then 2 + 5 * ({_has('website')})::int + 3 * ({_has('topics_text')})::int when 'mentorship' then 2 + 5 * ({_has('email')})::int + 3 * ({_has('website')})::int
else 5 + case when coalesce(qfund, false) and grants > 0 then 3 else 0 end end end as intent_points,
case when {_has('email')} then 3 + coalesce(email_verified, false)::int else 0 end + ({_has('website')})::int as contact_points from k where not blocked),
p1 as (select *, case when not a4 then 0 when act > 0 then act else ({_has('website')})::int + ({_has('email')})::int end as action_points, 40 * a1::int + 15 * a2::int + 5 * a3::int + 10 * a4::int + 10 * a5::int + 10 * a6::int + 10 * a7::int as most_points,
7 - a1::int - a2::int - a3::int - a4::int - a5::int - a6::int - a7::int as unscored from p0),
p2 as (select *, topic_points + evidence_points + skills_points + action_points + case when a5 then constraints_points else 0 end + intent_points + contact_points as raw_total from p1),
p3 as (select *, case when most_points > 0 then least(100, greatest(0, {_even('100.0::double * raw_total / most_points')})) else 0 end as score, most_points / 100 as completeness from p2), scored as (select * from p3 where score > 0) """
)
_why = "concat_ws('; ', case when len(matched) > 0 then 'Matches: ' || array_to_string(matched[1:3], ', ') end, case when grants > 0 then grants || ' active grants' end, case when rh > 0 then 'Skills: ' || array_to_string(list_sort(list_intersect(own, req))[1:2], ', ') end)"


def _match(t, columns=matcher.GIVEN) -> DataFrame:
    return matcher.match(profiles(t), matched(t), NOW, TODAY, columns)


@query(_scored + "select query_id, id, topic_points, evidence_points, skills_points, action_points, constraints_points, intent_points, contact_points, raw_total, score, completeness::double as completeness, hits from scored")
def M12_match(t):
    """The points of every candidate of every profile; M3 to M11 are its columns."""
    return _match(t, [c for c in matcher.GIVEN if c != "explanation"])


def _component(name: str, columns: str, doc: str) -> None:
    """Registers some of the match's columns as a query of their own."""
    names = [c.strip() for c in columns.split(",")]

    def component(t):
        return _match(t, names)

    component.__name__, component.__doc__ = name, doc
    query(_scored + f"select query_id, id, {', '.join('completeness::double as completeness' if c == 'completeness' else c for c in names)} from scored")(component)


_component("M3_topic_fit", "topic_points", "Up to 40 points for shared terms.")
_component("M4_evidence", "evidence_points", "Up to 15 points for papers and grants, or for grants alone.")
_component("M5_skill_bridge", "skills_points", "Up to 5 points for skills that are asked for.")
_component("M6_contact", "contact_points", "Up to 5 of 10 points for ways to reach somebody.")
_component("M7_constraints", "constraints_points", "Ten points less two for each thing unknown or not as wished.")
_component("M8_actionability", "action_points", "Up to 10 points for signs that an answer will come.")
_component("M9_intent", "intent_points", "Up to 10 points by what is wanted.")
_component("M11_available_total", "raw_total, score, completeness", "The total over the components that can be scored, of 100.")


@query(_scored + "select query_id, id, a1 as topic, a2 as evidence, a3 as skills, a4 as action, a5 as constraints, a6 as intent, a7 as contact from scored")
def M10_availability(t):
    """Which components can be scored, for every pair that is."""
    return _match(t, [f"can_{k}" for k in matcher.MOST]).withColumnsRenamed({f"can_{k}": k for k in matcher.MOST})


@query(_scored + f"select query_id, id, case when {_why} = '' then 'General match' else {_why} end || case when completeness < 0.8 and unscored > 0 then ' (' || unscored || ' categories not scored due to missing data)' else '' end as explanation from scored")
def M26_explanation(t):
    return _match(t, ["explanation"])


@query(_scored + ", r as (select query_id, id, score, row_number() over (partition by query_id order by score desc, raw_total desc, topic_points desc, hits desc, id) as rank from scored) select * from r where rank <= 20")
def W2_three_level_sort(t):
    return matcher.best_matches(profiles(t), matched(t), NOW, TODAY, 20)


@query()
def M12_diverse(t):
    """The twenty best of each profile, diverse where there are more. Held against a loop in the tests."""
    return matcher.diverse(profiles(t), matched(t), NOW, TODAY, 20)


@query(PEOPLE_SQL + PROFILES_SQL + _p_terms + f", words as (select distinct q.id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from q), hit as (select query_id, pt.id, count(*) as hits from words join pt using (term) where length(term) >= 3 and term not in ({', '.join(map(lit, lexicon.STOPWORDS))}) group by 1, 2) select * from hit union all select q.id, m.id, 0 from q, m where q.id not in (select query_id from hit)")
def J12_candidates_or_all(t):
    """The people that share a word with a profile; all of them for a profile whose words nobody has."""
    return matcher.all_candidates(profiles(t), matched(t))


@query(PEOPLE_SQL + f"select id, array_to_string(list_sort({_skill('tech')}), '|') as skills from m")
def T34_skill_names(t):
    return matched(t).select("id", F.array_join(F.array_sort(matcher.skill_names(C("techniques"))), "|").alias("skills"))


_onto = "(values " + ", ".join(f"({lit(k)}, {lit(x)})" for k, v in lexicon.ONTOLOGY.items() for x in v) + ") o(field, term)"


@query(
    PEOPLE_SQL + f", a as (select distinct unnest(tech) as raw from m), l as (select raw, lower(trim(raw)) as low from a), r as (select raw, low as x from l union select raw, term from l join {_onto} on field = low "
    f"union select raw, field from l join {_onto} on term = low union select raw, p.term from l join {_onto} on o.term = low join {_onto.replace(' o(', ' p(')} on p.field = o.field) select raw, string_agg(x, '|' order by x) as related from r group by raw"
)
def T35_related_terms(t):
    return matched(t).select(F.explode("techniques").alias("raw")).distinct().select("raw", F.array_join(matcher.related(C("raw")), "|").alias("related"))


@query(PEOPLE_SQL + f"select id, array_to_string(list_filter({listed(lexicon.PHRASES)}, lambda p: contains(lower(text), p)), '|') as phrases from m")
def J11_lexicon(t):
    return matched(t).select("id", F.array_join(F.filter(matcher.strings(lexicon.PHRASES), lambda p: F.contains(F.lower("text"), p)), "|").alias("phrases"))


@query(f"select doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({', '.join(map(lit, lexicon.STOPWORDS))}))) as n from documents")
def T33_terms(t):
    words = F.filter(F.regexp_extract_all(F.lower("text"), L("[a-z0-9]+"), L(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*lexicon.STOPWORDS))
    return t("documents").select("doc_id", F.size(words).cast("long").alias("n"))


@query(PEOPLE_SQL + "select id, round(10 * n + 20 * a, 6) as score, rank from (select id, n, a, row_number() over (order by round(10 * n + 20 * a, 6) desc, id) as rank from (select id, 0.7 * least(coalesce(h_index, 0) / 100, 1) + 0.3 * least(works / 500, 1) as a, (contains(text, 'learning')::int + contains(text, 'data')::int + contains(text, 'cell')::int) as n from m)) where rank <= 50")
def M21_fast_match(t):
    """Shared keywords and activity, the first fifty."""
    n = sum((F.contains("text", L(w)).cast("int") for w in ("learning", "data", "cell")), L(0))
    activity = 0.7 * F.least(F.coalesce("h_index", L(0)) / 100, L(1.0)) + 0.3 * F.least(C("works") / 500, L(1.0))
    s = matched(t).select("id", F.round(10 * n + 20 * activity, 6).alias("score"))
    return rank.top_k(s, 50, C("score").desc(), C("id"))


@query(PEOPLE_SQL + f"select id from m where {any_sql('lower(text)', ['learning'])} and coalesce(accepts, true) and coalesce(remote_ok, true)")
def F11_hard_block(t):
    """What an explicit no excludes; unknown does not."""
    p = matched(t).where(F.contains(F.lower("text"), L("learning")))
    return p.where(~(C("accepts").eqNullSafe(L(False)) | C("remote_ok").eqNullSafe(L(False)))).select("id")


@query(_scored + "select query_id, id, score from scored where score >= 35")
def F12_least_score(t):
    return _match(t, ["score"]).where("score >= 35")
