"""Queries of sources and sinks: what is written to the shared folder and read again must be the table's own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.plans.catalog import query
from talus.plans.people import WITH, _folded, people
from talus.sources import tables
from talus.sources.scratch import fresh_path
from talus.streaming import streams

C, L = F.col, F.lit


def whole(rows: DataFrame, path: str, before: str = "", after: str = "") -> None:
    """All rows of a small table as one JSON text."""
    one = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("j"))
    one.select(F.concat(L(before), "j", L(after)).alias("value")).coalesce(1).write.text(path)


def field(name: str):
    return F.get_json_object("record", f"$.{name}")


@query("select n_nationkey as k, n_name as name, n_nationkey as ordinal from nation")
def S1_json_list(t):
    n = t("nation").select("n_nationkey", "n_name")
    path = fresh_path(n.sparkSession, "list")
    whole(n, path)
    return tables.read_json_records(n.sparkSession, path).select(field("n_nationkey").cast("int").alias("k"), field("n_name").alias("name"), "ordinal")


@query("select 'faculty' as under, n_name as name from nation union all select 'awards', r_name from region union all select 'first', r_name from region")
def S2_json_envelope(t):
    n, r = t("nation").select("n_nationkey", "n_name"), t("region").select("r_regionkey", "r_name")
    spark, path = n.sparkSession, fresh_path(n.sparkSession, "envelopes")
    whole(n, f"{path}/faculty", '{"other": [1], "faculty": ', "}")
    whole(r, f"{path}/awards", '{"note": "x", "awards": ', "}")
    whole(r, f"{path}/first", '{"note": "[x", "n": 3, "rows": ', ', "more": [5]}')
    read = lambda k, c: tables.read_json_records(spark, f"{path}/{k}").select(L(k).alias("under"), field(c).alias("name"))
    return read("faculty", "n_name").unionByName(read("awards", "r_name")).unionByName(read("first", "r_name"))


@query("select n_regionkey as k, case when n_regionkey % 2 = 0 then 'new' else 'old' end as kind, count(*) as n from nation group by 1")
def S3_enriched_twins(t):
    """Files by region; where a region has an enriched file its plain one does not count."""
    n = t("nation").select("n_regionkey", "n_name", "n_nationkey")
    rows = n.select("n_regionkey", "n_name", L("old").alias("kind"), F.concat("n_regionkey", L(".json")).alias("file"))
    more = n.where("n_regionkey % 2 = 0").select("n_regionkey", "n_name", L("new").alias("kind"), F.concat("n_regionkey", L("_enriched.json")).alias("file"))
    return tables.without_twins(rows.unionByName(more)).groupBy(C("n_regionkey").alias("k"), "kind").agg(F.count("*").alias("n"))


@query("select 2023 as year, n_name as name from nation where n_regionkey = 1 union all select 2024, n_name from nation where n_regionkey = 2 union all select 0, r_name from region")
def S4_year_folders(t):
    """Folders of years, read whatever their depth; a folder without years by its own files."""
    n, r = t("nation"), t("region").select("r_regionkey", "r_name")
    spark, path = n.sparkSession, fresh_path(n.sparkSession, "years")
    for year, region in ((2023, 1), (2024, 2), (2019, 3)):
        one = n.where(C("n_regionkey") == region).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("awards"))).alias("value"))
        tables.write_text(one, f"{path}/with/{year}/deep", ".json")
    tables.write_text(r.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*r.columns)))).alias("value")), f"{path}/without", ".json")
    named = tables.read_years(spark, f"{path}/with", [2023, 2024, 2025]).select(F.regexp_extract("path", "/(20[0-9]{2})/deep/", 1).cast("int").alias("year"), field("n_name").alias("name"))
    return named.unionByName(tables.read_years(spark, f"{path}/without", [2023, 2024, 2025]).select(L(0).alias("year"), field("r_name").alias("name")))


@query(WITH + "select id, trim(name) as name, trim(school) as school from people where trim(coalesce(name, '')) <> '' and trim(coalesce(school, '')) <> ''")
def S5_aliased_csv(t):
    """People as CSV under other column names, and back (S10); rows without a name or school go."""
    p = people(t).select(C("id").alias("ID"), C("name").alias("professor_name"), C("school").alias("Affiliation"))
    path = fresh_path(p.sparkSession, "csv")
    tables.write_csv(p, path, ["ID", "professor_name", "Affiliation"])
    back = tables.read_aliased_csv(p.sparkSession, path, {"id": ["ID"], "name": ["Name", "professor_name"], "school": ["affiliation", "Affiliation"]}, ["name", "school"])
    return back.select(C("id").cast("long").alias("id"), "name", "school")


@query(WITH + "select 'full' as sink, status, count(*) as n from people group by 2 union all select 'display', status, count(*) from people where status <> 'needs_review' group by 2 union all select 'review', status, count(*) from people where status = 'needs_review' group by 2")
def S11_status_sinks(t):
    p = people(t).select("id", "status")
    paths = tables.write_statuses(p, fresh_path(p.sparkSession, "statuses"), "status")
    read = lambda k: p.sparkSession.read.parquet(paths[k]).groupBy("status").agg(F.count("*").alias("n")).select(L(k).alias("sink"), "status", "n")
    return read("full").unionByName(read("display")).unionByName(read("review"))


@query(WITH + f"select coalesce(nullif(trim(regexp_replace({_folded.format('department')}, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') as folder, count(*) as n, min(id) as first from people group by 1")
def S12_slug_folders(t):
    p = people(t).select("id", "department")
    path = fresh_path(p.sparkSession, "slugs")
    tables.write_by_slug(p, path, "department")
    return p.sparkSession.read.json(path).groupBy(C("department_slug").alias("folder")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(WITH + "select 'rows' as part, count(*) as n, sum(id) as s from people union all select 'csv', count(*), sum(id) from people union all select 'metadata', count(*), count_if(coalesce(email, '') <> '') from people")
def S13_export(t):
    p = people(t).select("id", "name", "email")
    spark, path = p.sparkSession, fresh_path(p.sparkSession, "export")
    tables.write_export(p, path, ["id", "name"], {"n": F.count("*"), "s": F.count_if(F.coalesce("email", L("")) != "")})
    tell = lambda k, df: df.agg(F.count("*").alias("n"), F.sum(C("id").cast("long")).alias("s")).select(L(k).alias("part"), "n", "s")
    meta = spark.read.json(f"{path}/metadata").select(L("metadata").alias("part"), "n", "s")
    return tell("rows", spark.read.json(f"{path}/rows")).unionByName(tell("csv", spark.read.csv(f"{path}/csv", header=True))).unionByName(meta)


@query("select event_type, count_if(value is not null and value <= 150) as good, count_if(value is null or value > 150) as dead from events group by 1")
def S15_dead_letters(t):
    e = t("events").select("event_id", "event_type", F.when(C("value").isNull() | (C("value") > 150), F.concat(L("value "), C("value").cast("string"))).alias("error"), C("value"))
    e = e.withColumn("error", F.when(C("value").isNull(), "no value").otherwise(C("error")))
    good, dead = tables.split_failures(e, "error")
    both = good.select("event_type", L(1).alias("g"), L(0).alias("d")).unionByName(dead.select("event_type", L(0).alias("g"), L(1).alias("d")))
    return both.groupBy("event_type").agg(F.sum("g").alias("good"), F.sum("d").alias("dead"))


@query("select 'Total' as label, count(*) as n from orders union all select o_orderpriority, count(*) from orders group by o_orderpriority")
def S16_report(t):
    """A report's counters, written as text and read again."""
    o = t("orders")
    spark, path = o.sparkSession, fresh_path(o.sparkSession, "report")
    spark.createDataFrame([(x,) for x in tables.report(o, "Orders", "o_orderpriority")], "value string").coalesce(1).write.text(path)
    return tables.parse_report(spark.read.text(path))


@query(WITH + "select 'now' as part, count(*) as n from people where h_index is not null union all select 'backup', count(*) from people")
def S17_replace(t):
    """A table put in another's place, which stays beside it; one with too few valid rows is refused."""
    p = people(t).select("id", "h_index")
    spark, path = p.sparkSession, fresh_path(p.sparkSession, "table")
    tables.replace_table(p, path, C("id").isNotNull())
    old = tables.replace_table(p.where("h_index is not null"), path, C("h_index").isNotNull())
    try:
        tables.replace_table(p.select("id", L(None).cast("int").alias("h_index")), path, C("h_index").isNotNull())
    except ValueError:
        pass
    read = lambda k, at: spark.read.parquet(at).agg(F.count("*").alias("n")).select(L(k).alias("part"), "n")
    return read("now", path).unionByName(read("backup", old))


@query("select 'first' as run, count(*) as n from events where event_id % 2 = 0 union all select 'second', count(*) from events where event_id % 2 = 1 union all select 'third', 0 union all select 'all', count(*) from events")
def G5_resumed_runs(t):
    """A run takes what came since the one before it, by its checkpoint, and nothing twice (V6: what comes is appended)."""
    e = t("events").select("event_id", "user_id")
    spark, path = e.sparkSession, fresh_path(e.sparkSession, "runs")
    told = []
    for name, rows in (("first", "event_id % 2 = 0"), ("second", "event_id % 2 = 1"), ("third", None)):
        if rows:
            e.where(rows).write.mode("append").parquet(f"{path}/in")
        told.append((name, streams.resumed(spark, f"{path}/in", "*.parquet", e.schema, f"{path}/checkpoint", f"{path}/out")))
    told.append(("all", spark.read.parquet(f"{path}/out").select("event_id").distinct().count()))
    return spark.createDataFrame(told, "run string, n long")
