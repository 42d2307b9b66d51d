"""Queries of the evaluation and of the older rubrics, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import text
from talus.operators import evaluate, rank
from talus.plans.catalog import query

C, L = F.col, F.lit

_found = "case page_id % 5 when 4 then '' else url end"
_known = "case page_id % 4 when 0 then upper(url) when 1 then 'http://www.example.com/x' when 2 then '' else 'https://other.org/' end"
_who = "case when page_id % 2 = 0 then 'Ada Page' else 'Bob Example' end"
_key = "rtrim(replace(replace(replace(lower(trim({0})), 'https://', ''), 'http://', ''), 'www.', ''), '/')"
_points = f"""with x as (select page_id, {_found} as found, {_known} as known, {_who} as who from pages), k as (select *, {_key.format('found')} as f, {_key.format('known')} as g from x),
p as (select page_id, case when f <> '' and g <> '' and f = g then 1.0 when f <> '' and g <> '' and regexp_extract(f, '^([^/?#]*)', 1) = regexp_extract(g, '^([^/?#]*)', 1) then 0.7
when f <> '' and g <> '' and contains(f, case when page_id % 2 = 0 then 'page' else 'example' end) then 0.5 when found <> '' then 0.2 else 0.0 end::double as points from k) """


def _website(t):
    return t("pages").select("page_id", evaluate.website_points(F.expr(_found), F.expr(_known), F.expr(_who)).alias("points"))


@query(_points + "select page_id, points from p")
def T24_website_points(t):
    return _website(t)


_list = "replace(p_type || ' ' || p_name, ' ', ' ; ') || ';;' || p_type || ';' || p_brand"


@query(f"with x as (select p_partkey, list_transform(string_split({_list}, ';'), lambda v: trim(v)) as l from part) select p_partkey, array_to_string(list_filter(l, lambda v, i: v <> '' and list_position(l, v) = i), '|') as items from x")
def D5_ordered_items(t):
    return t("part").select("p_partkey", F.array_join(evaluate.ordered_items(F.expr(_list)), "|").alias("items"))


@query("select doc_id, regexp_extract(text, '20[0-9]{2}') as year from documents")
def T27_year(t):
    return t("documents").select("doc_id", F.regexp_extract("text", "20[0-9]{2}", 0).alias("year"))
