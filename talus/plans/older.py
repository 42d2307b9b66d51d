"""Queries of what is left: fetched pages, search clients, the first service, embeddings' texts and preferences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import rules, text, web
from talus.operators import evaluate, match, rank, records
from talus.plans.catalog import query
from talus.plans.joins import LISTED_SQL, listed
from talus.plans.people import WITH, _words, lit, people, pick
from talus.plans.reshape import _authors, _cn, _found, _nm, _split, authors, results, split
from talus.sources import tables
from talus.sources.scratch import fresh_path

C, L = F.col, F.lit


@query(_authors + f", z as (select id, {_nm} as nm, {_cn} as cn, inst, h_index, works from au) select id, 0 as page, case when len(nm) > 0 then nm[1] else coalesce(list_filter(list_transform(co, lambda x: case when x.level >= 1 then x.name end), lambda x: x is not null)[1], '') end as first from z join (select id, co from au) using (id) where len(inst) between 1 and 15 and contains(lower(inst[1]), 'boston') and (coalesce(h_index, 0) >= 10 or coalesce(works, 0) >= 30)")
def S8_author_pages(t):
    """Authors that several pages of a list give, each once, of a school and of some weight, with the first thing they work on."""
    a = authors(t).select("*", F.explode(F.array(L(0), L(1))).alias("page"))
    one = rank.keep_first(records.good_authors(a, "Boston"), ["id"], C("page"))
    p = records.research_profile(one)
    return one.select("id", "page").join(p.select("id", F.coalesce(F.get("keywords", L(0)), L("")).alias("first")), "id")


@query(f"select page_id, case when page_id % 11 = 3 then 'unreachable' when page_id % 11 = 5 then 'gone' when length(html) = 0 then 'empty' else 'ok' end as fetched, case when page_id % 11 in (3, 5) then 0 else length(html) end as size from pages")
def S9_fetched_pages(t):
    """Pages as fetched: the status is a column, and only what came with one below 400 has a text."""
    got = F.when(C("page_id") % 11 != 3, F.when(C("page_id") % 11 == 5, 404).otherwise(200))
    p = t("pages").select("page_id", got.alias("status"), F.when(got < 400, C("html")).alias("html"))
    told = F.when(C("status").isNull(), "unreachable").when(C("status") >= 400, "gone").when(F.length("html") == 0, "empty").otherwise("ok")
    return p.select("page_id", told.alias("fetched"), F.coalesce(F.length("html"), L(0)).cast("long").alias("size"))


@query(_found + "select id, q, r, coalesce(url, '') as url, left(coalesce(content, ''), 12) as snippet, coalesce(content, '') <> '' as has_content, contains(coalesce(content, ''), 'nothing') as limited from f")
def V13_search_client(t):
    """What a provider's JSON gives as common results: texts cut to a length, and whether an error names a limit."""
    j = results(t).select("id", "q", "r", F.to_json(F.struct("url", F.struct("content").alias("body"))).alias("j"))
    c = F.coalesce(F.get_json_object("j", "$.body.content"), L(""))
    return j.select("id", "q", "r", F.coalesce(F.get_json_object("j", "$.url"), L("")).alias("url"), F.left(c, L(12)).alias("snippet"), (c != "").alias("has_content"), F.contains(c, L("nothing")).alias("limited"))


@query(_found + "select id % 2 as provider, count(*) as rows, count_if(url is null) as failed, count(distinct url) as urls from f group by 1")
def V15_provider_runs(t):
    """One run for either provider: rows, those that go to the dead letters, and different URLs."""
    r = results(t).withColumn("provider", C("id") % 2)
    return r.groupBy("provider").agg(F.count("*").alias("rows"), F.count_if(C("url").isNull()).alias("failed"), F.count_distinct("url").alias("urls"))


_v1 = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') and w not in ('and', 'or', 'the', 'a', 'an', 'in', 'on', 'at', 'to', 'for', 'of', 'with')))"


@query(f"with k as (select doc_id, unnest({_v1.format('text')}) as w from documents) select w, count(*) as postings, min(doc_id) as first from k group by 1")
def V22_postings(t):
    """The postings of the first service's keywords: how many texts have each, and the first of them."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), L(r"[\p{L}\p{N}_]+"), L(0)), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin("and", "or", "the", "a", "an", "in", "on", "at", "to", "for", "of", "with")))
    return t("documents").select("doc_id", F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("postings"), F.min("doc_id").alias("first"))


@query(WITH + f"select id, coalesce(grants, 0) as awards, array_to_string(case when id % 2 = 0 and len({_split('topics', '[|]')}) > 0 then {_split('topics', '[|]')} else {_split('areas', ';')} end, '|') as topics, coalesce(h_index, 0) as h, coalesce(nullif(school, ''), '') as school from people")
def V23_service_record(t):
    """Records as the first service takes them: awards as a number from a list or a number, topics from the list or else the areas."""
    own = F.when(C("id") % 2 == 0, split("topics", "[|]")).otherwise(F.array().cast("array<string>"))
    awards = F.when(C("id") % 3 == 0, F.size(F.array_repeat(L("x"), F.coalesce("grants", L(0)).cast("int")))).otherwise(F.coalesce("grants", L(0)))
    return people(t).select("id", awards.cast("long").alias("awards"), F.array_join(F.when(F.size(own) > 0, own).otherwise(split("areas", ";")), "|").alias("topics"), F.coalesce("h_index", L(0)).alias("h"), F.coalesce("school", L("")).alias("school"))


_asked = ["deep", "learning", "cell", "data", "energy"]


@query(
    WITH + f", x as (select id, lower(replace(coalesce(topics, ''), '|', ' ')) as tx, coalesce(h_index, 0) as h, coalesce(grants, 0) as g, coalesce(email, '') as e, coalesce(website, '') as w from people), s as (select id, round(least(50.0, 50.0 * ({' + '.join(f'contains(tx, {lit(a)})::int' for a in _asked)}) / {len(_asked)}) + case when h between 15 and 150 then 20 when h < 15 then 10 else 15 end "
    "+ case when g > 0 then 15 else 0 end + least(15, case when e <> '' then case when id % 2 = 0 then 13 else 10 end else 0 end + case when w <> '' then 2 else 0 end), 1) as score from x) select id, score::double as score, rank from (select *, row_number() over (order by score desc, id) as rank from s where score > 0) where rank <= 20"
)
def V25_service_match(t):
    """The first service over everybody: five questions, the twenty best."""
    tx, email, site = F.lower(F.replace(F.coalesce("topics", L("")), L("|"), L(" "))), F.coalesce("email", L("")) != "", F.coalesce("website", L("")) != ""
    hits = sum((F.contains(tx, L(a)).cast("int") for a in _asked), L(0))
    s = match.five_question(hits, L(len(_asked)), F.coalesce("h_index", L(0)), "phd", True, F.coalesce("grants", L(0)), email, C("id") % 2 == 0, site)
    return rank.top_k(people(t).select("id", F.round(s, 1).alias("score")).where("score > 0"), 20, C("score").desc(), C("id"))


@query(WITH + f"select id, 'Research: ' || array_to_string({_split('topics', '[|]')}[1:10], ', ') || '. Keywords: ' || array_to_string({_split('techniques', '[,;]')}[1:10], ', ') as t, left(md5('Research: ' || array_to_string({_split('topics', '[|]')}[1:10], ', ') || '. Keywords: ' || array_to_string({_split('techniques', '[,;]')}[1:10], ', ')), 16) as key from people")
def V28_embedding_text(t):
    """The text that stands for somebody in an embedding, and the key it is remembered by."""
    tx = F.concat(L("Research: "), F.array_join(F.slice(split("topics", "[|]"), 1, 10), ", "), L(". Keywords: "), F.array_join(F.slice(split("techniques", "[,;]"), 1, 10), ", "))
    return people(t).select("id", tx.alias("t")).withColumn("key", F.left(F.md5("t"), L(16)))


_prefs = "case id % 4 when 0 then '{\"techniques\": [\"pcr\", \"r\"], \"experience_level\": \"phd\", \"funding_required\": true, \"min_h_index\": 5}' when 1 then '{}' when 2 then '{\"preferred_location\": \"ma\", \"max_h_index\": 70, \"other\": 1}' end"


@query(WITH + f", p as (select id, coalesce({_prefs}, '{{}}') as j from people) select id, coalesce(array_to_string(cast(json_extract(j, '$.techniques') as varchar[]), '|'), '') as techniques, json_extract_string(j, '$.experience_level') as level, coalesce(cast(json_extract_string(j, '$.funding_required') as boolean), false) as funding, json_extract_string(j, '$.preferred_location') as location, cast(json_extract_string(j, '$.min_h_index') as int) as low, cast(json_extract_string(j, '$.max_h_index') as int) as high from p")
def V30_preferences(t):
    """Preferences of eleven fields from JSON, with what stands for a missing one."""
    schema = "research_interests array<string>, techniques array<string>, experience_level string, lab_type_preference string, preferred_location string, preferred_duration string, funding_required boolean, visa_status string, preferred_institution string, min_h_index int, max_h_index int"
    p = people(t).select("id", F.from_json(F.coalesce(F.expr(_prefs), L("{}")), schema).alias("p"))
    return p.select("id", F.coalesce(F.array_join("p.techniques", "|"), L("")).alias("techniques"), C("p.experience_level").alias("level"), F.coalesce("p.funding_required", L(False)).alias("funding"), C("p.preferred_location").alias("location"), C("p.min_h_index").alias("low"), C("p.max_h_index").alias("high"))


@query(
    WITH + LISTED_SQL + _words + ", tries as (select id, v.v as name, v.k as k from (select id, unnest(list_zip([plain, trim(first || ' ' || last), trim(last || ' ' || first), trim(left(first, 1) || ' ' || last), left(first, 1) || last, last, first], range(1, 8))) as z from parts where plain is not null), lateral (select z[1] as v, z[2] as k) v where v.v <> ''), "
    "one as (select name, min(ordinal) as ordinal from listed where name is not null group by 1), m as (select id, ordinal, k, row_number() over (partition by id order by k) as r from tries join one using (name)) select id, ordinal, case when k = 1 then 1.0 else 0.8 end::double as score from m where r = 1"
)
def V36_exact_directory(t):
    """The older look-up in a directory: spellings only, 1 for the name itself and 0.8 for any other."""
    tries = people(t).where("name is not null").select("id", F.posexplode(F.slice(text.name_variations(C("name")), 1, 7)).alias("k", "name"))
    one = listed(t).where("name is not null").groupBy("name").agg(F.min("ordinal").alias("ordinal"))
    hit = rank.keep_first(tries.join(one, "name"), ["id"], C("k"))
    return hit.select("id", "ordinal", F.when(C("k") == 0, 1.0).otherwise(0.8).alias("score"))


@query()
def T16_page_addresses(t):
    """All addresses of pages by the way they are written, and pages to look for more on. Held against a loop in the tests."""
    card = "concat('<a href=\"mailto:', coalesce(email, ''), '?subject=x\">m</a> write jane [at] beta [dot] org or lab@alpha.edu <a href=\"/contact-me\">Contact</a> <a href=\"https://www.alpha.edu/bio/', id, '\">Bio</a> <a href=\"https://else.org/contact\">Contact us</a>')"
    p = people(t).select("id", "name", F.expr(card).alias("html"))
    found = web.address_candidates(p).select("id", C("method").alias("kind"), C("email").alias("value"))
    more = p.select("id", L("contact").alias("kind"), F.explode(web.contact_pages(C("html"), F.concat(L("https://www.alpha.edu/people/"), "id"))).alias("value"))
    return found.unionByName(more)


_mail = pick(["Info@site.edu", "jane@site.edu", "team.lead@site.edu", "steppingstrong@x.org", "course@x.org"], "id")


@query(WITH + f"select id, regexp_matches(lower({_mail}), '^({'|'.join(text.GENERIC_ADDRESSES)})@') as office, ends_with(lower({_mail}), '@site.edu') as sited from people")
def V35_plain_addresses(t):
    """The older choice of addresses: offices are left out by whole local parts, hosts must be the site's, no likeness of spelling."""
    return people(t).select("id", text.generic_address(F.expr(_mail)).alias("office"), web.within_domains(F.expr(_mail), ["site.edu"]).alias("sited"))


_keys = ["learning", "cell", "language", "energy", "clinical", "data"]
_theirs = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(topics, '')), '[a-z]+'), lambda w: length(w) >= 3))"
_keyed = f"{WITH}, k as (select *, {_theirs} as kw, lower(replace(coalesce(topics, ''), '|', ' ')) as tx from people), n as (select *, len(list_intersect(kw, [{', '.join(map(lit, _keys))}])) as shared from k) "


def _shared(t):
    theirs = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("topics", L(""))), L("[a-z]+"), L(0)), lambda w: F.length(w) >= 3))
    p = people(t).withColumns({"kw": theirs, "tx": F.lower(F.replace(F.coalesce("topics", L("")), L("|"), L(" ")))})
    return p.withColumn("shared", F.size(F.array_intersect("kw", F.array(*[L(k) for k in _keys]))))


@query(
    _keyed + f"select id, round(case when len(kw) > 0 then 40.0::double * shared / least({len(_keys)}, len(kw)) else 0 end + case when coalesce(department, '') = '' then 0 when lower(department) = 'business' then 15 when contains(lower(department), 'business') then 10.5 else 0 end + case when coalesce(h_index, 0) between 15 and 150 then 15 when coalesce(h_index, 0) < 15 then 7.5 else 10.5 end "
    "+ case when coalesce(grants, 0) >= 3 then 10 when coalesce(grants, 0) >= 1 then 7 else 3 end + case when works >= 100 then 10 when works >= 50 then 8 when works >= 20 then 6 else 4 end + case when coalesce(email, '') = '' then 0 when id % 3 = 0 then 10 else 6 end, 6)::double as score from n"
)
def M14_six_factor(t):
    p = _shared(t)
    email = F.coalesce("email", L("")) != ""
    s = evaluate.six_factor(C("shared"), L(len(_keys)), F.size("kw"), "Business", C("department"), "phd", F.coalesce("h_index", L(0)), F.coalesce("grants", L(0)), C("works"), email, C("id") % 3 == 0)
    return p.select("id", F.round(s, 6).alias("score"))


@query(
    _keyed + f", m as (select id, shared + 5 * ({' + '.join(f'({" or ".join(f"contains(tx, {lit(w)})" for w in rules.DOMAINS[d])})::int' for d in ('life_sciences', 'computer_science'))}) + 3 * (contains(tx, 'deep')::int + contains(tx, 'imaging')::int) as score from n) "
    "select id, score, rank from (select *, row_number() over (order by score desc, id) as rank from m) where rank <= 100"
)
def M17_keyword_stage(t):
    """The first stage: shared keywords, shared fields and skills in what somebody works on; the hundred best."""
    p = _shared(t)
    fields = F.size(F.array_intersect(rules.domains(C("tx")), F.array(L("life_sciences"), L("computer_science"))))
    skills = F.contains("tx", L("deep")).cast("int") + F.contains("tx", L("imaging")).cast("int")
    return rank.top_k(p.select("id", evaluate.keyword_stage(C("shared"), fields, skills).alias("score")), 100, C("score").desc(), C("id"))


# --- parts that other queries hold as well, each by itself -------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_custkey = 50")
def S6_by_key(t):
    """Rows of one key; the filter reaches the scan."""
    return t("orders").where("o_custkey = 50").select("o_orderkey", "o_totalprice")


@query(WITH + "select id, coalesce(name, '') as name, coalesce(trim(location), '') as location from people")
def S10_csv_columns(t):
    """A CSV of stated columns in stated order, read again; what is empty in it comes back as nothing."""
    p = people(t).select("location", "id", "name")
    path = fresh_path(p.sparkSession, "columns")
    tables.write_csv(p, path, ["id", "name", "location"])
    back = p.sparkSession.read.csv(path, header=True, multiLine=True, escape='"')
    assert back.columns == ["id", "name", "location"]
    return back.select(C("id").cast("long").alias("id"), F.coalesce("name", L("")).alias("name"), F.trim(F.coalesce("location", L(""))).alias("location"))


@query(WITH + "select id, coalesce(split_part(lower(email), '@', 2) = 'alpha.edu' or ends_with(split_part(lower(email), '@', 2), '.alpha.edu'), false) as valid from people")
def F10_host(t):
    """Whether an address is at a host or below it."""
    return people(t).select("id", web.within_domains(C("email"), ["alpha.edu"]).alias("valid"))


@query(WITH + "select coalesce(department, '') as department, string_agg(cast(id as varchar), '|' order by id) as ids from people group by 1")
def A15_lists_by_department(t):
    g = people(t).groupBy(F.coalesce("department", L("")).alias("department")).agg(F.sort_array(F.collect_list("id")).alias("l"))
    return g.select("department", F.array_join(F.transform("l", lambda x: x.cast("string")), "|").alias("ids"))


_asks = "['pcr', 'imaging', 'python', 'statistics']"


@query(WITH + f"select id, array_to_string(list_filter({_asks}, lambda x: not list_contains(list_transform({_split('techniques', '[,;]')}, lambda y: lower(y)), x)), '|') as missing from people")
def D11_missing_skills(t):
    own = F.transform(split("techniques", "[,;]"), F.lower)
    return people(t).select("id", F.array_join(F.array_except(F.array(*[L(x) for x in ("pcr", "imaging", "python", "statistics")]), own), "|").alias("missing"))


@query()
def T5_likeness(t):
    """How alike each person's name is to three others: 1 for equal, 0.9 for one within the other, else the matching-blocks ratio. Held against a loop."""
    p = people(t).where("name is not null").select(text.plain_name(C("name")).alias("a")).distinct()
    return p.select("a", F.explode(F.array(L("jane doe"), L("al li"), L("mary smith"))).alias("b")).select("a", "b", text.seq_ratio("a", "b").alias("ratio"))


@query(WITH + f"select id, lower(concat_ws(' ', coalesce(department, ''), coalesce(areas, ''), coalesce(techniques, ''), coalesce(title, ''), array_to_string({_split('topics', '[|]')}[1:12], ' '))) as hay from people")
def T14_haystack(t):
    e = lambda c: F.coalesce(C(c), L(""))
    return people(t).select("id", F.lower(F.concat_ws(" ", e("department"), e("areas"), e("techniques"), e("title"), F.array_join(F.slice(split("topics", "[|]"), 1, 12), " "))).alias("hay"))


@query(WITH + "select id, case when contains(coalesce(techniques, ''), ';') then len(list_filter(string_split(techniques, ';'), lambda x: trim(x) <> '')) else len(list_filter(string_split(coalesce(techniques, ''), ','), lambda x: trim(x) <> '')) end as items from people")
def T32_list_parser(t):
    """How many items a list in a text has; semicolons part it if there are any, else commas."""
    return people(t).select("id", F.size(records.split_list(C("techniques"))).cast("long").alias("items"))


@query(WITH + f"select id, case when id % 3 = 0 then array_to_string({_split('topics', '[|]')}, '|') when id % 3 = 1 then coalesce(title, '') else '' end as items from people")
def T32_list_or_text(t):
    """A field of JSON records that holds a list or one text or nothing, as a list."""
    own = F.when(C("id") % 3 == 0, F.to_json(F.struct("id", split("topics", "[|]").alias("x")))).when(C("id") % 3 == 1, F.to_json(F.struct("id", C("title").alias("x")))).otherwise(F.to_json(F.struct("id")))
    return people(t).select("id", F.array_join(tables.list_or_text(own, "x"), "|").alias("items"))


@query(WITH + "select id from people where lower(trim(email)) in ('jdoe@alpha.edu', 'info@alpha.edu', 'x')")
def T39_allowed(t):
    return people(t).where(F.lower(F.trim("email")).isin("jdoe@alpha.edu", "info@alpha.edu", "x")).select("id")


@query("select 'Total' as label, count(*) as n from customer union all select c_mktsegment, count(*) from customer group by 1")
def T40_parsed_report(t):
    """The counters of a report's lines."""
    lines = tables.report(t("customer"), "Customers", "c_mktsegment")
    return tables.parse_report(t("customer").sparkSession.createDataFrame([(x,) for x in lines], "value string"))


@query("select 'kept' as what, count(*) as n from events union all select 'added', count_if(event_type = 'error') from events")
def V6_appended(t):
    """Rows appended to a log stand beside those that were there."""
    e = t("events").select("event_id", "event_type")
    spark, path = e.sparkSession, fresh_path(e.sparkSession, "log")
    e.withColumn("what", L("kept")).write.parquet(path)
    e.where("event_type = 'error'").withColumn("what", L("added")).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("what").agg(F.count("*").alias("n"))


@query(WITH + "select status, count(*) as n, round_even(100.0 * count_if(coalesce(email, '') <> '') / count(*), 1)::double as with_email, round_even(100.0 * count_if(coalesce(website, '') <> '') / count(*), 1)::double as with_website from people group by 1")
def V16_results_with_measures(t):
    """Results as JSON and CSV with their measures, read from what was written."""
    p = people(t).select("id", "status", "email", "website")
    path = fresh_path(p.sparkSession, "results")
    tables.write_export(p, path, ["id", "status"], {"n": F.count("*")})
    rate = lambda c: F.bround(100.0 * F.count_if(F.coalesce(c, L("")) != "") / F.count("*"), 1)
    return p.sparkSession.read.schema(p.schema).json(f"{path}/rows").groupBy("status").agg(F.count("*").alias("n"), rate("email").alias("with_email"), rate("website").alias("with_website"))


@query(WITH + "select id, case status when 'complete' then 2 when 'partial' then 1 when 'needs_review' then 0 else -1 end as status_rank, case lower(title) when 'professor' then 3 when 'emeritus' then 1 else -1 end as title_rank from people")
def V21_rank_maps(t):
    """States as numbers; what is in no map is -1."""
    of = lambda c, m: F.coalesce(*[F.when(c == k, v) for k, v in m.items()], L(-1))
    return people(t).select("id", of(C("status"), {"complete": 2, "partial": 1, "needs_review": 0}).alias("status_rank"), of(F.lower("title"), {"professor": 3, "emeritus": 1}).alias("title_rank"))
