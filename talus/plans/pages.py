"""Queries of the page, website and staged-matching pipelines, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import text, web
from talus.operators import rank
from talus.plans.catalog import QUERIES, query
from talus.sources.tables import table
from talus.streaming import streams

C, L = F.col, F.lit

_name = "case page_id % 3 when 0 then 'Jane Doe' when 1 then 'Sue Example' else 'Al Li' end"
_last = "case page_id % 3 when 0 then 'doe' when 1 then 'example' else 'li' end"
_first = "case page_id % 3 when 0 then 'jane' when 1 then 'sue' else 'al' end"
_title = "coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')"
_any = lambda s, parts: " or ".join(f"contains({s}, '{p}')" for p in parts)

_strip = "regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')"


@query(f"with h as (select page_id, unnest(regexp_extract_all(html, '(?s)<h[1-4][^>]*>(.*?)</h[1-4]>', 1)) as h from pages), n as (select page_id, trim({_strip.format('h')}) as name from h) select distinct page_id, name from n where contains(name, ' ') and length(name) <= 60")
def V18_heading_names(t):
    return t("pages").select("page_id", F.explode(web.heading_names(C("html"), "1-4")).alias("name"))


_mailed = "case page_id % 3 when 0 then '<a href=\"mailto:Office@alpha.edu\">us</a><a href=\"mailto:J.Doe@alpha.edu?subject=hi\">me</a>' when 1 then '<p>write to office@beta.edu<b>or</b>sue@beta.edu</p>' else '' end || ' ' || html"


@query()
def V9_page_email(t):
    """The personal address of every page, null where it has none. Held against a loop in the tests."""
    return t("pages").select("page_id", web.page_email(F.expr(_mailed)).alias("email"))


_url = "url || case page_id % 6 when 0 then '/~jane/' when 1 then '/people/example' when 2 then '/lab/' when 3 then '/people/' when 4 then '/papers/x.pdf' else '' end"
_deny = _any("u", web.DENIED_SITES + web.DENIED_PATHS)


@query(f"with x as (select page_id, lower({_url}) as u from pages) select page_id from x where not ({_deny})")
def F8_allowed_urls(t):
    return t("pages").select("page_id", F.expr(_url).alias("u")).where(~web.denied(C("u"))).select("page_id")


_kind = f"case when {_any('u', web.AGGREGATORS)} then -40 when {_any('u', web.PUBLICATION_PATHS)} then -20 when {_any('u', web.PERSONAL)} then 10 when contains(u, 'example.org') then 5 else 0 end"
_words = " + ".join(f"case when contains(b, '{w}') then 1 else 0 end" for w in web.HOMEPAGE_WORDS)
_result = f"""with x as (select page_id, lower({_url}) as u, lower({_title}) as t, lower({_title}) || ' contact and research ' || case when page_id % 2 = 0 then 'x' else 'lab' end as b, {_first} as first, {_last} as last, lower({_name}) as name from pages),
s as (select page_id, ({_kind} + case when contains(u, 'example.org') then 40 else 0 end + case when contains(u, '.edu') then 20 else 0 end
+ case when contains(u, '/~') then 35 when {_any('u', ['/people/', '/faculty/', '/profile/'])} then 20 when {_any('u', ['/lab/', '/labs/', '/group/'])} then 15 else 0 end
+ case when length(last) > 2 and contains(u, last) then 25 else 0 end + case when length(last) > 2 and contains(t, last) then 15 else 0 end + case when length(first) > 2 and contains(t, first) then 10 else 0 end
+ case when contains(t, name) then 20 else 0 end + case when {_words} >= 2 then 10 else 0 end + case when regexp_matches(rtrim(u, '/'), '/(people|faculty|directory|staff)$') then -30 else 0 end) / 100.0 as s from x) """


def _scored(t):
    about = F.concat(L("contact and research "), F.when(C("page_id") % 2 == 0, "x").otherwise("lab"))
    return t("pages").select("page_id", web.result_score(F.expr(_url), F.expr(_title), about, F.expr(_name), "example.org").alias("s"))


@query(_result + "select page_id, round(s, 4)::double as score, case when s >= 0.5 then 'high' when s >= 0.3 then 'medium' when s >= 0.15 then 'low' end as confidence from s")
def T21_result_score(t):
    return _scored(t).select("page_id", F.round("s", 4).alias("score"), web.website_confidence(C("s")).alias("confidence"))


@query(
    _result + ", g as (select page_id // 5 as who, page_id % 5 as nth, page_id, round(s + 0.05 * (10 - page_id % 5) / 10, 4) as score from s), r as (select *, row_number() over (partition by who order by score desc, nth) as k from g where score >= 0.15) select who, page_id, score::double as score from r where k = 1"
)
def T21_best_website(t):
    """Each fifth of pages is taken for one person's results; the best of at least .15 stays, the first of equals."""
    g = _scored(t).select(F.expr("page_id div 5").alias("who"), (C("page_id") % 5).alias("nth"), "page_id", F.round(web.with_rank(C("s"), C("page_id") % 5), 4).alias("score"))
    return rank.keep_first(g.where("score >= 0.15"), ["who"], C("score").desc(), C("nth")).select("who", "page_id", "score")


@query(
    f"with x as (select page_id, lower({_url}) as u, lower({_title}) as t, {_last} as last from pages), s as (select page_id, (case when contains(u, 'example.org') then 40 else 0 end + case when contains(u, last) then 25 else 0 end + case when contains(t, last) then 15 else 0 end "
    f"+ case when {_any('u', ['/~', '/people/', '/faculty/', '/profile/'])} then 20 else 0 end) / 100.0 as s from x where not ({_deny})), r as (select page_id // 5 as who, page_id, s::double as score, row_number() over (partition by page_id // 5 order by s desc, page_id) as k from s where s >= 0.3) select who, page_id, score from r where k = 1"
)
def V34_older_website(t):
    s = t("pages").where(~web.denied(F.expr(_url))).select(F.expr("page_id div 5").alias("who"), "page_id", web.four_signals(F.expr(_url), F.expr(_title), F.expr(_name), "example.org").alias("score"))
    return rank.keep_first(s.where("score >= 0.3"), ["who"], C("score").desc(), C("page_id"))


@query("select * exclude (r) from (select s_nationkey, s_suppkey, s_acctbal, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) as r from supplier) where r <= 50")
def A19_samples(t):
    s = t("supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return rank.top_k_by(s, ["s_nationkey"], 50, C("s_acctbal"), C("s_suppkey")).drop("rank")


@query("select c_mktsegment, round_even(count_if(c_acctbal > 0) / count(*), 3) as positive, count_if(c_acctbal >= 4000 and c_nationkey > 20) as lacking from customer group by 1")
def A14_coverage(t):
    found = F.coalesce(F.bround(F.try_divide(F.count_if(C("c_acctbal") > 0), F.count("*")), 3), L(0.0))
    return t("customer").groupBy("c_mktsegment").agg(found.alias("positive"), F.count_if((C("c_acctbal") >= 4000) & (C("c_nationkey") > 20)).alias("lacking"))


@query("select o_custkey as k, max(o_orderkey) as latest, arg_max(o_orderpriority, o_orderkey) as priority from orders group by 1")
def V5_latest(t):
    """The last row of each key in stored order, as an upsert leaves it."""
    return t("orders").groupBy(C("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("latest"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))


@query("select c_custkey, regexp_extract('see https://orcid.org/0000-000' || (c_custkey % 10) || '-1234-567X now', '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]') as orcid from customer")
def T37_orcid(t):
    return t("customer").select("c_custkey", F.regexp_extract(F.concat(L("see https://orcid.org/0000-000"), C("c_custkey") % 10, L("-1234-567X now")), "[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]", 0).alias("orcid"))


def G1_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten admitted events a user in any day, exact; rejected ones do not count. Tested against a plain loop."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    with streams.keyed_state(spark):
        return streams.run_once(streams.limited(stream, 10, 86400), "talus_limiter", "append")


QUERIES["G1_limiter"] = G1_limiter
