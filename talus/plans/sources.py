"""Lists that come page by page and pages as trees, with the SQL or held against loops in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import dom, text, web
from talus.operators import rank
from talus.plans.catalog import query
from talus.plans.people import WITH, people
from talus.sources import paged
from talus.sources.scratch import fresh_path

C, L = F.col, F.lit


@query(WITH + ", a as (select id, name, h_index, works, row_number() over (order by works desc, id) as nth from people) select id, name, works, h_index from a where nth <= 8000 and (coalesce(h_index, 0) >= 10 or works >= 30)")
def S8_paged_authors(t):
    """Authors of some weight from a list that comes in pages of 80, a hundred of them at most; each page is read by a task of its own."""
    p = people(t).select("id", "name", "h_index", "works")
    path = fresh_path(p.sparkSession, "authors")
    paged.write_pages(p, path, 80, C("works").desc(), C("id"))
    got = paged.read_pages(p.sparkSession, path, "id long, name string, h_index int, works long", 80)
    return got.where("coalesce(h_index, 0) >= 10 or works >= 30").select("id", "name", "works", "h_index")


@query(
    "with r as (select o_custkey as id, o_orderkey as q, l_linenumber as r, case when l_partkey % 4 = 0 then null else 'https://' || lower(replace(p_brand, '#', '')) || '.org/' || (l_partkey % 9) end as url from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey), "
    "u as (select * from (select *, row_number() over (partition by id, url order by q, r) as n from r where url is not null) where n = 1) select id, place, url from (select id, url, row_number() over (partition by id order by q, r, url) as place from u) where place <= 10"
)
def S7_paged_results(t):
    """Results of several queries for each customer that come in pages: the first ten different URLs, in order of query and place."""
    url = F.concat(L("https://"), F.lower(F.replace(C("p_brand"), L("#"), L(""))), L(".org/"), C("l_partkey") % 9)
    r = t("lineitem").join(t("orders"), C("o_orderkey") == C("l_orderkey")).join(t("part"), C("p_partkey") == C("l_partkey"))
    r = r.select(C("o_custkey").alias("id"), C("o_orderkey").alias("q"), C("l_linenumber").cast("int").alias("r"), F.when(C("l_partkey") % 4 != 0, url).alias("url"))
    path, n = fresh_path(r.sparkSession, "results"), r.count()
    each = max(200, -(-n // 100))
    paged.write_pages(r, path, each, C("id"), C("q"), C("r"), C("url"))
    got = paged.read_pages(r.sparkSession, path, "id long, q long, r int, url string", each)
    one = rank.keep_first(got.where("url is not null"), ["id", "url"], C("q"), C("r"))
    return rank.top_k_by(one, ["id"], 10, C("q"), C("r"), C("url")).select("id", C("rank").alias("place"), "url")


# --- pages as trees --------------------------------------------------------------------------------------------------------

_card = (
    "concat('<section><div class=\"Faculty-card\"><h3>', coalesce(p.name, ''), '</h3><p>Office ', p.id, '<p>see <a href=\"/people/', p.id, '\">page</a></p><ul><li>by mail <a href=\"mailto:', coalesce(p.email, ''), '?subject=hi\">write</a></ul></div>"
    "<table class=people><tr><td>', coalesce(p.name, ''), '<td><a href=\"MAILTO:x@alpha.edu\">no</a> <a href=\"mailto:', coalesce(p.email, ''), '\">m</a><tr class=\"staff\"><td><strong>Row ', coalesce(p.department, ''), '</strong> &amp; more</td><td><a href=\"mailto:office', p.id, '@beta.org\">o</a></td></table></section>')"
)


def directories(t):
    """The pages with a directory of one person and one office inserted before the footer: id, url, html."""
    j = t("pages").alias("w").join(people(t).alias("p"), F.expr("w.page_id = p.id"))
    return j.select(C("w.page_id").alias("id"), "w.url", F.replace(C("w.html"), L("<footer>"), F.concat(F.expr(_card), L("<footer>"))).alias("html"))


def _valid(email):
    return web.within_domains(email, ["alpha.edu", "beta.org"])


@query()
def V37_parsed_directory(t):
    """Who stands in each page's directory, by the entry around a link and by elements whose class tells of people. Held against a loop in the tests."""
    return dom.directory(directories(t), text.plain_name, _valid)


@query()
def V19_parsed_names(t):
    """Texts of each page's headings and links of at most 60 characters, by the tree of its elements. Held against a loop in the tests."""
    n = dom.nodes(directories(t).select("id", "html"))
    tops = n.where(C("tag").isin("h1", "h2", "h3", "h4", "a")).select("id", C("node").alias("top"), C("tag").alias("kind"))
    named = dom.texts(n, tops).join(tops, ["id", "top"])
    return named.where(F.length("text") <= 60).groupBy("id", "kind", "text").agg(F.count("*").alias("n"))
