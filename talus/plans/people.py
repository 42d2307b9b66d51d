"""A table of invented people over customer, and the queries of names, filters and reshaping on it, each with its SQL.

The people's columns are picked by key from short lists of raw values that meet every branch of the rules. The same expressions
make the table for Spark and for the SQL; what the rules make of the values is worked out on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import rules, text, web
from talus.operators import rank
from talus.plans.catalog import query

C, L = F.col, F.lit


def lit(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def pick(values: list, key: str = "c_custkey") -> str:
    """The value at a key's remainder, as an expression that both engines read alike."""
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then {lit(v)}" for k, v in enumerate(values)) + " end"


def look_up(values: list, key: str = "c_custkey") -> str:
    """The same value for Spark, from an array that is one literal: a rule that asks for it often doesn't carry all its branches along."""
    return f"get(array({', '.join(map(lit, values))}), cast({key} % {len(values)} as int))"


NAMES = [
    "Dr. Jane Doe, PhD", "José Núñez", "M. F. SEMMELHACK", "COMPUTER SCIENCE", "Department", "The Board of all", "A Committee", "Ada Lovelace 2", "please read more here", "Principal Faculty",
    "Ann-Marie O'Neil-Smith", "Prof. Al Li", "jane doe", "Sue Example Jr.", "Ring http://x now", " ", "Mary Anne van Dyke", "Li Al", "faculty & leadership", "liver diseases expand_more",
    "Bob Example III", "Jane Q. Doe", "someone with a name that has so many words that nobody would take it", None, "Office of the Dean", "J. Nunez", "Mary-Jane Smith-Jones", "Doe Jane",
    "An Apple", "technology advancement",
]
SCHOOLS = ["MIT", "massachusetts institute of technology", "Harvard University", "harvard", "BU", "Tufts University", "Stanford", "Other College", "", None, " yale "]
DEPARTMENTS = ["Computer Science", "Biochemistry", "Department of Law", "", None, "Various", "Applied Math", "Neuroscience", "Mechanical Engineering", "Climate Studies", "Earth and Planetary", "Business", "Physics"]
TITLES = ["Professor", "Adjunct Professor", "Visiting Scholar", None, "Lecturer, part-time", "Associate Professor", "Emeritus"]
LOCATIONS = ["New York, ny", "o'neil-smith, new haven, connecticut", "BOSTON", "a, b, c", "NY", "new haven, connecticut", "cambridge, ma, usa", "", None, " palo alto , ca ", "Boston", "x, y, ma", "ma", "12 main st, springfield, IL", "paris, fr", "ÉVRY, ile-de-france", "one"]
EMAILS = ["jdoe@alpha.edu", "Info@alpha.edu", "jane.doe@gmail.com", None, "", "admin@cs.alpha.edu", "nunez@beta.org", "courses@alpha.edu", "x", "li.al@other.com", "lab@alpha.edu", "laboratory@alpha.edu", "someone@notalpha.edu", "JDOE@ALPHA.EDU ", "support@nobody.net", "programs@beta.org", "doe@beta.org", "ann@sub.beta.org", "zed@unknown.io"]
WEBSITES = ["https://www.alpha.edu/people/jdoe/", None, "", "http://beta.org/~nunez", "https://harvard.edu/faculty/x", "https://lab.mit.edu/people/", "https://www.Other.com/"]
TECHNIQUES = ["PCR, western blot; imaging", "python", "", None, "Python programming , CRISPR-Cas9,  qPCR", "mass spectrometry;sequencing", "imaging,imaging , , x ray", "flow cytometry", "machine learning; deep learning", "a, b", "statistics"]
AREAS = ["machine learning for genomics", "", "organic synthesis and drug discovery", None, "quantum computing; photonics", "Collaborative Research: energy storage", "the study of data", "cancer biology and immunology, stem cells", "human-computer interaction", "evolution of revolution", "robotics, computer vision", "public health and epidemiology"]
TOPICS = ["deep learning|natural language processing|transformers", "", None, "single cell|gene expression|crispr", "solar cells|energy storage", "neural networks", "a|b|c|d|e|f|g|h", "medical imaging", "data science|statistics|", "clinical trials|clinical research"]


def _columns(pick) -> dict[str, str]:
    return {
        "id": "c_custkey", "name": pick(NAMES), "school": pick(SCHOOLS), "department": pick(DEPARTMENTS), "title": pick(TITLES), "location": pick(LOCATIONS), "email": pick(EMAILS),
        "website": pick(WEBSITES), "techniques": pick(TECHNIQUES, "(c_custkey * 5 + 1)"), "areas": pick(AREAS, "(c_custkey * 7 + c_nationkey)"), "topics": pick(TOPICS, "(c_custkey * 3 + c_nationkey)"),
        "h_index": "case when c_custkey % 9 = 4 then null else (c_custkey * 13) % 97 end", "works": "(c_custkey * 31) % 700", "grants": "case when c_custkey % 8 = 5 then null else c_custkey % 4 end",
        "accepts": "case when c_custkey % 7 = 3 then false when c_custkey % 7 = 5 then null else true end", "remote_ok": "case when c_custkey % 5 = 3 then false when c_custkey % 5 = 1 then null else true end",
        "join_page": "case when c_custkey % 6 = 0 then true when c_custkey % 6 = 1 then false end", "openings": "case when c_custkey % 10 = 0 then true when c_custkey % 10 < 4 then false end",
        "last_year": "case when c_custkey % 3 = 0 then null else 2010 + c_custkey % 16 end", "status": "case c_custkey % 3 when 0 then 'complete' when 1 then 'partial' else 'needs_review' end", "balance": "c_acctbal",
    }


PEOPLE = _columns(pick)
WITH = "with people as (select " + ", ".join(f"{v} as {k}" for k, v in PEOPLE.items()) + " from customer) "


def people(t) -> DataFrame:
    return t("customer").selectExpr(*[f"{v} as {k}" for k, v in _columns(look_up).items()])


def any_sql(s: str, parts) -> str:
    return "(" + " or ".join(f"contains({s}, {lit(p)})" for p in parts) + ")"


def starts_sql(s: str, parts) -> str:
    return "(" + " or ".join(f"starts_with({s}, {lit(p)})" for p in parts) + ")"


# --- names -----------------------------------------------------------------------------------------------------------------

_valid = f"contains(trim(n), ' ') and length(trim(n)) <= 60 and not {starts_sql('lower(trim(n))', rules.NAME_PREFIXES)} and not {any_sql('lower(trim(n))', rules.NAME_JUNK)} and not regexp_matches(n, '[0-9]')"
_names = "select 'd' || doc_id as id, text as n from documents union all select 'p' || id, name from people"


def _both(t) -> DataFrame:
    """Whole texts of documents, most of them no names, and the people's names."""
    d = t("documents").select(F.concat(L("d"), "doc_id").alias("id"), C("text").alias("n"))
    return d.unionByName(people(t).select(F.concat(L("p"), "id").alias("id"), C("name").alias("n")))


@query(WITH + f", x as ({_names}) select id, coalesce({_valid}, false) as ok from x")
def F4_person_name(t):
    return _both(t).select("id", rules.person_name(C("n")).alias("ok"))


_ingest = [p for p in rules.NAME_PREFIXES if p not in rules.ARTICLES]
_letters = "regexp_replace(trim(n), '[^\\pL]', '', 'g')"
_reason = (
    "case when n is null or trim(n) = '' then 'empty name' when not contains(trim(n), ' ') then 'single word (no space)' when length(trim(n)) > 60 then 'longer than 60 characters' "
    + " ".join(f"when starts_with(lower(trim(n)), {lit(p)}) then {lit(f'starts with "{p}"')}" for p in _ingest)
    + f" when {starts_sql('lower(trim(n))', rules.ARTICLES)} then 'starts with article \"The \"/\"A \"/\"An \"' when lower(trim(n)) in ({', '.join(map(lit, rules.JUNK_HEADINGS))}) then 'known junk phrase' "
    + " ".join(f"when contains(lower(trim(n)), {lit(p)}) then {lit(f'contains junk substring "{p}"')}" for p in rules.INGEST_JUNK)
    + f" when regexp_matches(n, '[0-9]') then 'contains digits' when {_letters} <> '' and {_letters} = upper({_letters}) and not regexp_matches(trim(n), '^([A-Z]\\.\\s*)+[A-Z][A-Z''\\-]*$') then 'all uppercase (non-person heading)' end"
)


@query(WITH + f", x as ({_names}) select id, {_reason} as reason from x")
def F5_reject_reason(t):
    return _both(t).select("id", rules.reject_reason(C("n")).alias("reason"))


_titles = "|".join(text.TITLES)
_plain = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\\b({_titles})\\b\\.?', '', 'g'), '[^\\pL0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_words = f", w as (select *, {_plain} as plain, list_filter(string_split({_plain}, ' '), lambda v: v <> '') as ws from people), parts as (select *, coalesce(ws[1], '') as first, coalesce(ws[-1], '') as last, array_to_string(ws[2:-2], ' ') as middle from w) "


@query(WITH + _words + "select id, plain from parts")
def T2_plain_name(t):
    return people(t).select("id", text.plain_name(C("name")).alias("plain"))


@query(WITH + _words + "select id, first, last, coalesce(case when len(ws) > 2 then middle end, '') as middle from parts")
def T3_name_parts(t):
    w = text.name_words(C("name"))
    middle = F.coalesce(F.when(F.size(w) > 2, F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 2, L(0))), " ")), L(""))
    return people(t).select("id", text.name_part(C("name"), False).alias("first"), text.name_part(C("name"), True).alias("last"), middle.alias("middle"))


@query(
    WITH + _words + ", v as (select id, [plain, trim(first || ' ' || last), trim(last || ' ' || first), trim(left(first, 1) || ' ' || last), left(first, 1) || last, last, first] "
    "|| case when len(ws) > 2 then [first || ' ' || middle || ' ' || last, first || ' ' || left(middle, 1) || ' ' || last, left(first, 1) || ' ' || left(middle, 1) || ' ' || last] else [] end "
    "|| case when contains(last, '-') then [split_part(last, '-', 1), split_part(last, '-', -1)] else [] end as v from parts where plain is not null) "
    "select id, array_to_string(list_filter(v, lambda x: x <> ''), '|') as variations from v"
)
def T4_name_variations(t):
    return people(t).where("name is not null").select("id", F.array_join(text.name_variations(C("name")), "|").alias("variations"))


_folded = "regexp_replace(strip_accents(lower(trim({0}))), '[^ -~]', '', 'g')"


@query(WITH + f"select id, coalesce(nullif(trim(regexp_replace({_folded.format('name')}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') as slug, coalesce(nullif(trim(regexp_replace({_folded.format('location')}, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') as file from people")
def T9_slug(t):
    return people(t).select("id", text.slug(C("name")).alias("slug"), text.slug(C("location"), "_").alias("file"))


@query()
def D8_unique_ids(t):
    """Slugs of names, numbered where they repeat; some bases end in a number themselves. Held against a loop in the tests."""
    p = people(t).select(C("id").alias("ordinal"), F.concat(text.slug(C("name")), F.when(C("id") % 30 == 12, "-2").otherwise("")).alias("base"))
    return rank.unique_ids(p, C("base"), C("ordinal")).select("ordinal", "base", "id")


# letter runs with a capital first: both engines have no such function, so the SQL goes letter by letter
_title = lambda s: f"list_reduce(list_prepend(['', ' '], list_transform(string_split({s}, ''), lambda c: [c, c])), lambda a, c: [a[1] || case when regexp_matches(a[2], '\\pL') then lower(c[1]) else upper(c[1]) end, c[1]])[1]"


@query(
    WITH + ", l as (select id, location, trim(location) as t, list_transform(string_split(trim(location), ','), lambda x: trim(x)) as p from people), "
    f"q as (select id, location, t, p, len(p) as n, p[-1] as last, list_transform(p, lambda x: {_title('x')}) as tp from l) "
    f"select id, case when coalesce(t, '') = '' then location when n = 1 then case when t = upper(t) and length(t) > 2 then tp[1] else t end "
    f"else array_to_string(tp[:-2] || [case when lower(last) in ({', '.join(map(lit, text.STATES))}) or (n = 2 and length(last) = 2) or (n > 2 and length(last) <= 2) then upper(last) else tp[-1] end], ', ') end as location from q"
)
def T10_location(t):
    return people(t).select("id", text.location(C("location")).alias("location"))


# --- choosing within a budget, pages of people -----------------------------------------------------------------------------


@query(
    WITH + ", e as (select id, h_index, h_index >= 40 as high from people where h_index >= 20 and coalesce(website, '') = ''), n as (select count_if(high) * 3 + count_if(not high) - 90 as over, count_if(not high) as others from e), "
    "r as (select *, row_number() over (partition by high order by id) as k from e) select id, h_index from r, n where high or k <= others - greatest(0, over)"
)
def W11_budget(t):
    """Who is searched for under a budget of 90 queries: three for an h-index of 40 or more, one from 20 on."""
    p = people(t).where("h_index >= 20 and coalesce(website, '') = ''").select("id", "h_index")
    return rank.within_budget(p, C("h_index") >= 40, 3, 1, 90, C("id"))


_got = "case when page_id % 11 = 3 then null when page_id % 11 = 5 then 404 else 200 end"
_site = pick(["https://harvard.edu/people/", "https://web.mit.edu/~x/", "https://www.alpha.edu/faculty/a/", "https://none.org/x/", "", "https://cs.beta.org/doe/", "https://MIT.edu/professor/", "https://other.com/staff/b/"], "page_id")
_checked = f"""{WITH}, j as (select page_id, {_site} as url, html, {_got} as status, people.* exclude (status) from pages join people on id = page_id + 1),
x as (select *, lower(url) as u, lower(html) as c, regexp_extract(lower(url), '^(?:[a-z]+://)?([^/?#]*)', 1) as d, coalesce(split_part(lower(email), '@', 2), '') as host, string_split_regex(trim(regexp_replace(name, '^Dr[.]\\s*', '', 'i')), '\\s+') as ws from j),
y as (select *, lower(ws[1]) as first, case when len(ws) >= 2 then lower(ws[-1]) else '' end as last, {any_sql('u', ['/people/', '/faculty/', '/professor/'])} as path, contains(u, '/~') as tilde from x),
v as (select page_id, url, email, case when url = '' then false when status is null then path or tilde when status >= 400 then false else coalesce(last <> '' and (contains(c, last) or contains(u, last)), false) or coalesce(host <> '' and (contains(d, host) or contains(host, d)) and (path or tilde or contains(u, '/staff/')), false)
or coalesce(department <> '' and contains(c, lower(department)) and first <> '' and contains(c, first), false) or coalesce(contains(lower(school), 'harvard') and contains(u, 'harvard') and path, false) or coalesce(contains(lower(school), 'mit') and contains(u, 'mit') and (path or tilde), false) end as ok from y) """


def _verified(t):
    j = t("pages").select("page_id", F.expr(_site).alias("url"), "html", F.expr(_got).alias("got")).join(people(t).drop("status"), F.expr("id = page_id + 1"))
    return j.select("page_id", "url", "email", web.page_of(C("url"), C("html"), C("name"), C("email"), C("department"), C("school"), C("got")).alias("ok"))


@query(_checked + "select page_id, ok from v")
def V32_page_check(t):
    return _verified(t).select("page_id", "ok")


@query(_checked + "select case when ok then 'valid' when coalesce(email, '') <> '' and url <> '' then 'fixed' else 'failed' end as status, count(*) as n from v group by 1")
def V33_page_status(t):
    """Pages that are their person's, those that another URL can be tried for (there are an email and a URL to go by), and the rest."""
    return _verified(t).groupBy(F.when(C("ok"), "valid").when((F.coalesce("email", L("")) != "") & (C("url") != ""), "fixed").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))
