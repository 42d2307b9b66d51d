"""Queries that join, filter, group and rank the invented people, with their SQL; those by likeness of names are held against loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import rules, text, web
from talus.operators import facets, names, rank
from talus.plans.catalog import query
from talus.plans.people import NAMES, WITH, _folded, any_sql, lit, people, pick, starts_sql

C, L = F.col, F.lit

LISTED = [
    "Jane Doe", "doe jane", "Jose Nunez", "J. Núñez", "Semmelhack", "ann marie o'neil smith", "ann-marie o'neil-smyth", "al li", "Susan Example", "s. example", "Mary van Dyke", "Mary Anne van Dycke", "Bob Exampel", "",
    "Jane Q Doe MD", "li", "mary-jane smith-jones", "A. Person", "Dr. Robert Example", None, "janet doe", "someone with a name", "Lovelace", "ada lovelase",
]
LISTED_SQL = f", listed as (select p_partkey as ordinal, {pick(LISTED, 'p_partkey')} as name, 'https://site.org/' || p_partkey as website, p_type as department from part) "
_key = lambda c: f"array_to_string(list_filter(string_split_regex(trim(regexp_replace({_folded.format(c)}, '[.,]', ' ', 'g')), '\\s+'), lambda w: w not in ('jr', 'sr', 'md', 'phd', 'ii', 'iii', 'iv') and w <> ''), ' ')"


def listed(t) -> DataFrame:
    return t("part").select(C("p_partkey").alias("ordinal"), F.expr(pick(LISTED, "p_partkey")).alias("name"), F.concat(L("https://site.org/"), "p_partkey").alias("website"), C("p_type").alias("department"))


def name_key(c: str):
    return F.coalesce(text.dedupe_name(text.ascii_fold(C(c))), L(""))


# --- joins -----------------------------------------------------------------------------------------------------------------


@query(WITH + LISTED_SQL + f"select id, {_key('name')} as norm from people where coalesce({_key('name')}, '') <> '' and {_key('name')} not in (select coalesce({_key('name')}, '') from listed)")
def J4_new_names(t):
    """People whose normalized name no list has; empty ones are dropped."""
    p = people(t).select("id", name_key("name").alias("norm")).where("norm <> ''")
    return p.join(listed(t).select(name_key("name").alias("norm")).distinct(), "norm", "left_anti").select("id", "norm")


@query()
def J5_first_match(t):
    """The department of the first listed name with the same last word and a matching first one, for people without a real one."""
    p = people(t).where("coalesce(department, 'Various') = 'Various'")
    return names.first_match(p, listed(t).select("name", C("department").alias("found"), "ordinal"))


@query()
def J6_fuzzy_names(t):
    """Who each person is among the listed names: by a spelling, else the most alike of at least 0.85."""
    return names.look_up(people(t), listed(t), best=True)


@query()
def J7_first_alike(t):
    """The website of the first listed name that is alike enough."""
    return names.look_up(people(t), listed(t), best=False).join(listed(t).select("ordinal", "website"), "ordinal").select("id", "website")


@query(WITH + "select p.id, coalesce(o.h, p.h_index) as h_index, case when o.h is not null then 'updated' else 'kept' end as note from people p left join (select o_custkey as id, max(cast(floor(o_totalprice / 5000) as bigint)) as h from orders where o_orderstatus = 'P' group by 1) o using (id)")
def J13_update_by_id(t):
    """New values of a field by id; what has none keeps its own."""
    new = t("orders").where("o_orderstatus = 'P'").groupBy(C("o_custkey").alias("id")).agg(F.max(F.floor(C("o_totalprice") / 5000)).alias("h"))
    return people(t).join(new, "id", "left").select("id", F.coalesce("h", "h_index").alias("h_index"), F.when(C("h").isNotNull(), "updated").otherwise("kept").alias("note"))


_known = [("Jane Doe", "u1"), ("Nunez", "u2"), ("Mary Anne van Dyke", "u3"), ("Li", "u4"), ("Ada Lovelace", "u5")]


@query(
    WITH + ", n as (select id, lower(trim(replace(name, 'Dr. ', ''))) as n from people where name is not null), k as (select * from (values " + ", ".join(f"({lit(n)}, {lit(u)}, {i})" for i, (n, u) in enumerate(_known)) + ") v(k, url, pos)), "
    "m as (select id, url, row_number() over (partition by id order by pos) as r from n join k on contains(n, lower(k)) or contains(lower(k), n)) select id, url from m where r = 1"
)
def J14_known_profiles(t):
    """The first of a few known names that holds a name or is held by it: literals, so no join."""
    n = F.lower(F.trim(F.replace(C("name"), L("Dr. "), L(""))))
    url = F.coalesce(*[F.when(F.contains(n, L(k.lower())) | F.contains(L(k.lower()), n), u) for k, u in _known])
    return people(t).select("id", url.alias("url")).where("url is not null")


_urls = "[coalesce(website, ''), 'http://www.beta.org/', '', case when id % 3 = 0 then 'https://alpha.edu/people/jdoe' else 'x.net' end]"
_norm = lambda u: f"rtrim(replace(replace(replace(lower(trim({u})), 'https://', ''), 'http://', ''), 'www.', ''), '/')"
_gold = pick(["https://ALPHA.edu/people", "beta.org", "", None, "https://harvard.edu/faculty/x/", "nowhere.org"], "id")


@query(WITH + f", x as (select id, {_norm(f'coalesce({_gold}, {chr(39) * 2})')} as g, list_filter(list_transform({_urls}, lambda u: {_norm('u')}), lambda u: true) as us, {_urls} as raw from people) select id, g <> '' and len(list_filter(range(1, len(raw) + 1), lambda i: raw[i] <> '' and (us[i] = g or contains(us[i], g) or contains(g, us[i])))) > 0 as found from x")
def J15_gold_in_urls(t):
    """Whether a known website is one of those found, or within one, or one within it."""
    us = F.array(F.coalesce("website", L("")), L("http://www.beta.org/"), L(""), F.when(C("id") % 3 == 0, "https://alpha.edu/people/jdoe").otherwise("x.net"))
    g = text.url_key(F.coalesce(F.expr(_gold), L("")))
    return people(t).select("id", ((g != "") & F.exists(us, lambda u: (u != "") & (F.contains(text.url_key(u), g) | F.contains(g, text.url_key(u))))).alias("found"))


@query(WITH + "select id, coalesce(lower(trim(email)) in ('jdoe@alpha.edu', 'doe@beta.org'), false) as allowed, coalesce(lower(trim(email)) in ('jdoe@alpha.edu', 'admin@cs.alpha.edu', 'x'), false) as found from people")
def V11_gold_email(t):
    """Whether an address is on a list (T39), and whether it is among those found, both in lower case without spaces around."""
    one = F.coalesce(F.lower(F.trim("email")), L(""))
    found = F.array(L(" JDOE@alpha.edu"), L("admin@CS.alpha.edu"), L(None).cast("string"), L("x "), L(""))
    gold = F.exists(found, lambda e: F.coalesce(F.lower(F.trim(e)), L("")) == one)
    return people(t).select("id", one.isin("jdoe@alpha.edu", "doe@beta.org").alias("allowed"), ((one != "") & gold).alias("found"))


# --- filters ---------------------------------------------------------------------------------------------------------------


@query(WITH + "select id from people where len(list_filter(string_split(lower(coalesce(techniques, '')), ','), lambda x: trim(x) = 'imaging')) > 0 or contains(',' || replace(lower(coalesce(techniques, '')), ' ', '') || ',', ',imaging,')")
def F3_technique(t):
    return people(t).where(F.array_contains(F.transform(F.split(F.lower(F.coalesce("techniques", L(""))), ","), lambda x: F.trim(x)), "imaging")).select("id")


@query(WITH + f"select id, coalesce(trim(name) <> '' and contains(trim(name), ' ') and length(trim(name)) <= 60 and not {starts_sql('lower(trim(name))', rules.SCRAPED_PREFIXES)} and not {any_sql('lower(trim(name))', rules.SCRAPED_JUNK)}, false) as ok from people")
def F6_scraped_name(t):
    return people(t).select("id", rules.scraped_name(C("name")).alias("ok"))


_school = "case " + " ".join(f"when lower(trim(coalesce(school, ''))) = {lit(k)} then {lit(v)}" for k, v in rules.SCHOOLS.items()) + " else trim(coalesce(school, '')) end"


@query(WITH + f"select id, {_school} as school from people")
def V20_school_alias(t):
    return people(t).select("id", rules.school(C("school")).alias("school"))


_valid = f"contains(trim(name), ' ') and length(trim(name)) <= 60 and not {starts_sql('lower(trim(name))', rules.NAME_PREFIXES)} and not {any_sql('lower(trim(name))', rules.NAME_JUNK)} and not regexp_matches(name, '[0-9]')"
ADMITTED = (
    WITH + f", s as (select * replace ({_school} as school) from people where coalesce({_valid}, false)), a as (select *, row_number() over (partition by lower(name), lower(school) order by id) as nth from s "
    f"where lower(school) in ({', '.join(map(lit, rules.ENABLED_SCHOOLS))}) and coalesce(department, '') <> 'Various' and not (trim(coalesce(department, '')) = '' and trim(coalesce(areas, '')) = '' and h_index is null)), admitted as (select * exclude (nth) from a where nth = 1) "
)


def admitted(t) -> DataFrame:
    """The people that are shown: valid names of enabled schools with something to go by, the first of each name and school."""
    p = people(t).withColumn("school", rules.school(C("school"))).where(rules.person_name(C("name")))
    blank = lambda c: F.trim(F.coalesce(c, L(""))) == ""
    p = p.where(F.lower("school").isin(*rules.ENABLED_SCHOOLS) & (F.coalesce("department", L("")) != "Various") & ~(blank("department") & blank("areas") & C("h_index").isNull()))
    return rank.keep_first(p.withColumns({"k1": F.lower("name"), "k2": F.lower("school")}), ["k1", "k2"], C("id")).drop("k1", "k2")


@query(ADMITTED + "select id, name, school from admitted")
def F7_admission(t):
    return admitted(t).select("id", "name", "school")


_generic = "|".join(text.GENERIC_ADDRESSES)


@query(WITH + f"select id, coalesce(regexp_matches(lower(email), '^({_generic})@'), false) as office, coalesce({starts_sql('split_part(lower(email), chr(64), 1)', text.GENERIC_LOCALS)}, false) as starts, coalesce(regexp_matches(lower(email), '@(.*[.])?(alpha[.]edu|beta[.]org)$'), false) as sited from people where contains(coalesce(email, ''), '@')")
def F9_office_addresses(t):
    """Addresses of offices by their whole local part, or by how it starts; and whether their host is one of the sites or below it."""
    p = people(t).where("contains(coalesce(email, ''), '@')")
    starts = F.exists(F.array(*[L(g) for g in text.GENERIC_LOCALS]), lambda g: F.startswith(F.substring_index(F.lower("email"), "@", 1), g))
    return p.select("id", text.generic_address(C("email")).alias("office"), starts.alias("starts"), web.within_domains(C("email"), ["alpha.edu", "beta.org"]).alias("sited"))


@query(WITH + "select id, row_number() over (order by coalesce(h_index, 0) desc, id) as place from people where coalesce(email, '') <> '' or coalesce(website, '') <> '' qualify place <= 50")
def F13_usable(t):
    """Who can be reached, highest h-index first."""
    p = people(t).where("coalesce(email, '') <> '' or coalesce(website, '') <> ''").select("id", F.coalesce("h_index", L(0)).alias("h"))
    return rank.top_k(p, 50, C("h").desc(), C("id")).select("id", C("rank").alias("place"))


@query(WITH + "select count(*) as total, count_if(coalesce(email, '') <> '') as with_email, count_if(coalesce(website, '') <> '') as with_website, count_if(coalesce(email, '') <> '' and coalesce(website, '') <> '') as with_both from people where coalesce(email, '') <> '' or coalesce(website, '') <> ''")
def F13_usable_counts(t):
    e, w = F.coalesce("email", L("")) != "", F.coalesce("website", L("")) != ""
    return people(t).where(e | w).agg(F.count("*").alias("total"), F.count_if(e).alias("with_email"), F.count_if(w).alias("with_website"), F.count_if(e & w).alias("with_both"))


_offered = ["Professor", "Lecturer", "Emeritus"]


@query(WITH + f"select id, coalesce(title in ({', '.join(map(lit, _offered))}), false) and coalesce(department in (select distinct department from people where h_index > 80), false) as valid from people")
def F14_form_answers(t):
    """Whether each answer is one of those offered: a fixed list, and what stands in a table."""
    p = people(t)
    options = p.where("h_index > 80 and department is not null").select("department").distinct().withColumn("there", L(True))
    return p.join(options, "department", "left").select("id", (F.coalesce(C("title").isin(*_offered), L(False)) & F.coalesce("there", L(False))).alias("valid"))


@query(WITH + "select id from people where coalesce(h_index, 0) >= 10 and coalesce(h_index, 0) <= 80 and coalesce(email, '') <> '' and coalesce(website, '') <> '' and coalesce(grants, 0) > 0 and contains(lower(coalesce(department, '')), 'c') and (contains(lower(replace(coalesce(topics, ''), '|', ' ')), 'learning') or contains(lower(coalesce(areas, '')), 'learning') or contains(lower(coalesce(areas, '')), 'learning'))")
def F2_attributes(t):
    """All seven filters at once; each is off when it isn't given."""
    return rules.attribute_filter(people(t), {"min_h_index": 10, "max_h_index": 80, "has_email": True, "has_website": True, "has_funding": True, "department": "C", "research_field": "Learning"}).select("id")


# --- groups ----------------------------------------------------------------------------------------------------------------


@query(WITH + "select count(*) as n, array_to_string(list_sort(list_distinct(list(department))), '|') as departments from people where coalesce(department, '') <> ''")
def A1_counts(t):
    return people(t).where("coalesce(department, '') <> ''").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("department")), "|").alias("departments"))


@query("select (select count(*) from orders) as orders, (select count(o_orderkey) from orders where o_orderstatus = 'F') as done, array_to_string((select list(o_orderkey order by o_orderdate desc, o_orderkey) from (select * from orders order by o_orderdate desc, o_orderkey limit 10)), '|') as newest")
def A12_totals(t):
    """Totals and the ten newest."""
    o = t("orders")
    ten = o.orderBy(C("o_orderdate").desc(), "o_orderkey").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(C("o_orderdate").cast("timestamp"))).alias("a"), C("o_orderkey").alias("k")))).alias("l"))
    ten = ten.select(F.array_join(F.transform("l", lambda x: x["k"].cast("string")), "|").alias("newest"))
    return o.agg(F.count("*").alias("orders"), F.count_if(C("o_orderstatus") == "F").alias("done")).crossJoin(ten)


@query(ADMITTED + "select school, department, count(*) as n, string_agg(name, '|' order by id) as names from admitted where coalesce(department, '') <> '' group by 1, 2")
def A16_nested_groups(t):
    """The records of each department of each school, in order; the first level of the map is the school."""
    g = admitted(t).where("coalesce(department, '') <> ''").groupBy("school", "department").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("l"))
    return g.select("school", "department", "n", F.array_join(F.transform("l", lambda x: x["name"]), "|").alias("names"))


@query(WITH + f"select {_school} as school, array_to_string(list_sort(list_distinct(list(trim(location)))), '|') as locations from people where trim(coalesce(location, '')) <> '' and coalesce(school, '') <> '' group by 1")
def A17_locations(t):
    p = people(t).where("trim(coalesce(location, '')) <> '' and coalesce(school, '') <> ''")
    return p.groupBy(rules.school(C("school")).alias("school")).agg(F.array_join(F.sort_array(F.collect_set(F.trim("location"))), "|").alias("locations"))


@query(WITH + "select count_if(h_index >= 40 and coalesce(email, '') = '') as no_email, count_if(h_index >= 40 and coalesce(website, '') = '') as no_website, count_if(status = 'needs_review') as low_confidence from people")
def A18_issues(t):
    e, w = F.coalesce("email", L("")) == "", F.coalesce("website", L("")) == ""
    return people(t).agg(F.count_if((C("h_index") >= 40) & e).alias("no_email"), F.count_if((C("h_index") >= 40) & w).alias("no_website"), F.count_if(C("status") == "needs_review").alias("low_confidence"))


# --- order -----------------------------------------------------------------------------------------------------------------

_prio = "2.0 * (trim(coalesce(email, '')) <> '')::int + (trim(coalesce(website, '')) <> '')::int + 0.5 * (h_index is not null)::int"


@query(ADMITTED + f"select id, row_number() over (order by {_prio} desc, id) as place from admitted")
def W3_stable_sort(t):
    """By what is known of a person, equals in stored order; the numbers are counted in ranges, not in one task."""
    has = lambda c: (F.trim(F.coalesce(c, L(""))) != "").cast("int")
    p = admitted(t).select("id", (2.0 * has("email") + has("website") + 0.5 * C("h_index").isNotNull().cast("int")).alias("priority"))
    return rank.places(p, "place", C("priority").desc(), C("id")).select("id", "place")


@query(WITH + ", w as (select id, unnest(regexp_extract_all(lower(coalesce(areas, '')), '[a-z]{3,}')) as w from people) select id, hits, row_number() over (order by hits desc, id) as rank from (select id, count(distinct w) as hits from w where w in ('learning', 'genomics', 'and', 'vision') group by 1) qualify rank <= 20")
def W6_postings(t):
    w = people(t).select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("areas", L(""))), L("[a-z]{3,}"), L(0)))).alias("w"))
    return rank.top_k(w.where(C("w").isin("learning", "genomics", "and", "vision")).groupBy("id").agg(F.count("*").alias("hits")), 20, C("hits").desc(), C("id"))


@query(WITH + ", u as (select id, unnest([coalesce(website, ''), email, 'https://a.edu/' || id, 'x']) as u, unnest([0, 1, 2, 3]) as k from people), s as (select id, u, k, case when contains(u, '.edu') then 2 else 0 end + case when contains(u, '/people/') then 3 else 0 end + case when u = 'x' then -1 else 0 end as s from u where u is not null) select id, u as best from (select *, row_number() over (partition by id order by s desc, k) as r from s) where r = 1 and s > 0")
def W7_array_argmax(t):
    """The best of each person's candidates if its score is above 0, the first of equals."""
    found = F.array_compact(F.array(F.coalesce("website", L("")), "email", F.concat(L("https://a.edu/"), "id"), L("x")))
    score = lambda u: F.when(F.contains(u, L(".edu")), 2).otherwise(0) + F.when(F.contains(u, L("/people/")), 3).otherwise(0) + F.when(u == "x", -1).otherwise(0)
    return people(t).withColumn("found", found).select("id", rank.best_of("found", score).alias("best")).where("best is not null")


@query(WITH + "select id, row_number() over (order by case when coalesce(email, '') = '' then 0 else 1 end, lower(coalesce(name, '')), id) as place from people")
def W12_missing_first(t):
    p = people(t).select("id", (F.coalesce("email", L("")) != "").cast("int").alias("has"), F.lower(F.coalesce("name", L(""))).alias("n"))
    return rank.places(p, "place", C("has"), C("n"), C("id")).select("id", "place")


@query(WITH + "select id, row_number() over (order by lower(coalesce(school, '')), lower(coalesce(name, '')), id) as place from people")
def W13_master_sort(t):
    p = people(t).select("id", F.lower(F.coalesce("school", L(""))).alias("s"), F.lower(F.coalesce("name", L(""))).alias("n"))
    return rank.places(p, "place", C("s"), C("n"), C("id")).select("id", "place")


@query(WITH + "select id, name from people where status = 'partial' order by id limit 5")
def W14_first_examples(t):
    return people(t).where("status = 'partial'").orderBy("id").limit(5).select("id", "name")


@query("select arg_max(s, (q, s)) as best from (select o_orderpriority as s, round_even(avg(o_totalprice), 3) as q from orders group by 1)")
def W15_best_group(t):
    s = t("orders").groupBy(C("o_orderpriority").alias("s")).agg(F.bround(F.avg("o_totalprice"), 3).alias("q"))
    return s.agg(F.max_by("s", F.struct("q", "s")).alias("best"))


# --- sets and ids ----------------------------------------------------------------------------------------------------------


@query(WITH + f"select min(id) as id from people where name is not null and trim(name) <> '' group by {_school}, coalesce(nullif({_key('name')}, ''), lower(trim(name)))")
def D3_keep_first(t):
    p = people(t).where("name is not null and trim(name) <> ''").select("id", rules.school(C("school")).alias("s"), F.coalesce(F.nullif(name_key("name"), L("")), F.lower(F.trim("name"))).alias("k"))
    return p.groupBy("s", "k").agg(F.min("id").alias("id")).select("id")


@query(WITH + ", e as (select id, [email, 'x@y.z', lower(email), website, email] as l from people) select id, array_to_string(list_filter(l, lambda v, i: v is not null and list_position(l, v) = i), '|') as found from e")
def D6_first_of_results(t):
    return people(t).select("id", F.array_join(F.array_distinct(F.array_compact(F.array("email", L("x@y.z"), F.lower("email"), "website", "email"))), "|").alias("found"))


@query(
    WITH + LISTED_SQL + f", n as (select id, id % 4 as dir, {_key('name')} as norm from people where coalesce({_key('name')}, '') <> ''), s as (select *, row_number() over (partition by norm order by dir, id) as nth, norm in (select {_key('name')} from listed where name is not null) as old from n) "
    "select p.dir, p.total, coalesce(s.new, 0) as new, coalesce(s.existing, 0) as existing from (select id % 4 as dir, count(*) as total from people group by 1) p left join (select dir, count_if(nth = 1 and not old) as new, count_if(nth > 1 or old) as existing from s group by 1) s using (dir)"
)
def D7_across_directories(t):
    """What each directory adds to those before it and to what is there; rows without a name are neither new nor there."""
    p = people(t).select("id", (C("id") % 4).alias("dir"), name_key("name").alias("norm"))
    old = listed(t).where("name is not null").select(name_key("name").alias("norm")).distinct().withColumn("old", L(True))
    n = p.where("norm <> ''").join(old, "norm", "left")
    first = n.groupBy("norm").agg(F.min(F.struct("dir", "id"))["id"].alias("first"))
    new = (C("id") == C("first")) & C("old").isNull()
    counts = n.join(first, "norm").groupBy("dir").agg(F.count_if(new).alias("new"), F.count_if(~new).alias("existing"))
    return p.groupBy("dir").agg(F.count("*").alias("total")).join(counts, "dir", "left").select("dir", "total", F.coalesce("new", L(0)).alias("new"), F.coalesce("existing", L(0)).alias("existing"))


_saved = "select distinct o_custkey as who, cast(floor(o_totalprice / 50000) as bigint) as what from orders where o_orderstatus = 'F'"


@query(f"with s as ({_saved}), n as (select c_custkey as who, unnest([1, 2, 2, 3]) as what from customer) select distinct who, what from n where (who, what) not in (select (who, what) from s)")
def D9_insert_if_absent(t):
    """What an insert adds that skips the pairs that are there."""
    saved = t("orders").where("o_orderstatus = 'F'").select(C("o_custkey").alias("who"), F.floor(C("o_totalprice") / 50000).alias("what")).distinct()
    new = t("customer").select(C("c_custkey").alias("who"), F.explode(F.array(L(1), L(2), L(2), L(3)).cast("array<bigint>")).alias("what")).distinct()
    return new.join(saved, ["who", "what"], "left_anti")


_parts = lambda c, mark: f"list_distinct(list_filter(list_transform(string_split_regex(lower(coalesce({c}, '')), '{mark}'), lambda x: trim(x)), lambda x: x <> ''))"


@query(WITH + f", x as (select id, {_parts('areas', '[ ,;]')} as a, {_parts('topics', '[ |]')} as b from people) select id, case when len(a) + len(b) = 0 then 0.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end as jaccard, array_to_string(list_sort(list_filter(a, lambda v: not list_contains(b, v))), '|') as missing from x")
def D10_sets(t):
    """Jaccard of two sets of words, and what one has that the other lacks."""
    split = lambda c, mark: F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(c, L(""))), mark), lambda x: F.trim(x)), lambda x: x != ""))
    a, b = split("areas", "[ ,;]"), split("topics", "[ |]")
    p = people(t).select("id", a.alias("a"), b.alias("b"))
    union = F.size(F.array_union("a", "b"))
    return p.select("id", F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("a", "b")) / union).alias("jaccard"), F.array_join(F.array_sort(F.array_except("a", "b")), "|").alias("missing"))


# --- lists of one user -----------------------------------------------------------------------------------------------------


@query(ADMITTED + f", q as (select distinct n as asked from (values {', '.join(f'({lit(n)})' for n in [*NAMES[:18], '4', '999', 'JANE DOE'] if n and n.strip())}) v(n)), b as (select lower(name) as k, max(id) as id from admitted group by 1), e as (select x.k, min(x.id) as id from (select cast(id as varchar) as k, id from admitted union all select name, id from admitted) x group by 1) select asked, coalesce(b.id, e.id) as id from q left join b on b.k = lower(asked) left join e on e.k = asked")
def V1_look_up(t):
    """An entity by name in any case, the last of equal ones; else by id or exact name, the first."""
    a = admitted(t)
    spark = a.sparkSession
    q = spark.createDataFrame([(n,) for n in dict.fromkeys([*NAMES[:18], "4", "999", "JANE DOE"]) if n and n.strip()], "asked string")
    by_name = a.groupBy(F.lower("name").alias("k")).agg(F.max("id").alias("low"))
    exact = a.select(C("id").cast("string").alias("k2"), "id").unionByName(a.select(C("name").alias("k2"), "id")).groupBy("k2").agg(F.min("id").alias("own"))
    return q.withColumns({"k": F.lower("asked"), "k2": C("asked")}).join(by_name, "k", "left").join(exact, "k2", "left").select("asked", F.coalesce("low", "own").alias("id"))


@query("select o_custkey, o_orderkey from orders where (o_custkey, o_orderkey) not in (select (o_custkey, o_orderkey) from orders where o_orderkey % 7 = 0)")
def V2_unsave(t):
    """What is left when some pairs of user and item are taken out."""
    return t("orders").select("o_custkey", "o_orderkey").join(t("orders").where("o_orderkey % 7 = 0").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "left_anti")


@query(ADMITTED + "select o_orderkey, id, name from orders join admitted on id = o_custkey")
def V3_planner(t):
    return t("orders").select("o_orderkey", C("o_custkey").alias("id")).join(admitted(t).select("id", "name"), "id").select("o_orderkey", "id", "name")


_cat = rules.rules_sql("lower(coalesce(department, ''))", rules.CATEGORY_RULES, "default")
_shown = "case category " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in rules.CATEGORY_NAMES.items()) + " end"


@query(
    ADMITTED + f", f as (select *, {_cat} as category, coalesce(department, '') as dept, case when trim(coalesce(location, '')) = '' then '' else location end as loc from admitted), "
    "g as (select *, school = 'MIT' as fs, category = 'biology' as fc, contains(loc, 'o') as fl from f) "
    f"select * from (select 'school' as facet, school as value, count(*) as n, cast(null as varchar) as shown from g where fc and fl group by school union all select 'category', category, count(*), {_shown} from g where fs and fl and dept not in ('', 'Various') and category <> 'default' group by category "
    "union all select 'subfield', dept, count(*), null from g where fs and fl and fc and dept not in ('', 'Various') group by dept union all select 'location', loc, count(*), null from g where fs and fc and loc <> '' group by loc)"
)
def M24_choices(t):
    """The values of each choice that go with all other choices made; sub-fields only within the category that is chosen."""
    loc = F.when(F.trim(F.coalesce("location", L(""))) == "", "").otherwise(C("location"))
    f = admitted(t).select("school", rules.category(F.coalesce("department", L(""))).alias("category"), F.coalesce("department", L("")).alias("dept"), loc.alias("loc"))
    fs, fc, fl = C("school") == "MIT", C("category") == "biology", F.contains("loc", L("o"))
    real = ~C("dept").isin("", "Various")
    # sub-fields are those of the category that is chosen
    offered = {"school": ("school", L(True)), "category": ("category", real & (C("category") != "default")), "subfield": ("dept", fc & real), "location": ("loc", C("loc") != "")}
    n = facets.counts(f, offered, {"school": fs, "category": fc, "location": fl})
    return n.select("facet", "value", "n", F.when(C("facet") == "category", rules.category_name(C("value"))).alias("shown"))


@query(ADMITTED + f", c as (select distinct {_cat} as category from admitted) select category, {_shown} as shown from c where {_shown} is not null")
def M25_options(t):
    """The research areas on offer: the categories that people have, by their names."""
    c = admitted(t).select(rules.category(F.coalesce("department", L(""))).alias("category")).distinct()
    return c.withColumn("shown", rules.category_name(C("category"))).where("shown is not null")


@query(ADMITTED + "select id from admitted where contains(lower(coalesce(department, '')), lower('sCi'))")
def V40_option_filter(t):
    return admitted(t).where(F.contains(F.lower(F.coalesce("department", L(""))), F.lower(L("sCi")))).select("id")
