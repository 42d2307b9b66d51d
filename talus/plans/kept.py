"""Queries over structures that are kept: an inverted index, lexicons as tables, cells of vectors, state of streams, keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import lexicon, text
from talus.operators import index, matcher, nearest, phrases, rank
from talus.plans.catalog import SQL, query
from talus.plans.joins import LISTED_SQL, listed
from talus.plans.matching import PEOPLE_SQL, PROFILES_SQL, _p_terms, _q_terms, matched, profiles
from talus.plans.older import _v1
from talus.plans.people import WITH, people
from talus.sources import keyed
from talus.sources.scratch import fresh_path
from talus.streaming import streams

C, L = F.col, F.lit


# --- inverted index --------------------------------------------------------------------------------------------------------


def _words(df, i: str, column, least: int):
    return df.select(C(i).alias("id"), F.explode(F.array_distinct(text.tokens(column, least))).alias("term"))


@query(SQL["J12_candidates"])
def J12_index_top_k(t):
    """Candidates as J12_candidates, from a kept index of the documents' words; most postings of frequent words stay unread."""
    kept = index.build(_words(t("documents"), "doc_id", C("text"), 6).withColumn("w", L(1)))
    asked = _words(t("benchmark").where("item_id % 50 = 0"), "item_id", C("text"), 6).select(C("id").alias("query_id"), "term", L(1).alias("weight"))
    return index.top_k(kept, asked, 10).select(C("query_id").alias("item_id"), C("id").alias("doc_id"), C("score").cast("long").alias("hits"), "rank")


@query(
    WITH + ", w as (select distinct id, unnest(regexp_extract_all(lower(coalesce(areas, '') || ' ' || coalesce(topics, '')), '[a-z]{3,}')) as w from people), h as (select a.id as query_id, b.id, count(*) as hits from w a join w b using (w) where a.id % 50 = 0 group by 1, 2) "
    "select query_id, id, hits, rank from (select *, row_number() over (partition by query_id order by hits desc, id) as rank from h) where rank <= 20"
)
def W6_index_top_k(t):
    """Who shares most words of areas and topics with each person whose id is divisible by 50, that person included."""
    w = F.regexp_extract_all(F.lower("text"), L("[a-z]{3,}"), L(0))
    words = lambda df: df.select("id", F.explode(F.array_distinct(w)).alias("term"), L(1).alias("w"))
    p = people(t).select("id", F.concat(F.coalesce("areas", L("")), L(" "), F.coalesce("topics", L(""))).alias("text"))
    return index.top_k_of_all(p, p.where("id % 50 = 0"), ["text"], words, 20).select("query_id", "id", C("score").cast("long").alias("hits"), "rank")


@query(
    PEOPLE_SQL + PROFILES_SQL + _p_terms + _q_terms + ", s as (select a.id as query_id, b.id, sum(a.w * b.w)::bigint as score from qt a join pt b using (term) group by 1, 2) "
    "select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 10"
)
def M2_index_top_k(t):
    """The ten people with the largest sums of products of weights of shared terms, for every profile, by impact order."""
    terms = lambda df: matcher.term_weights(df).select("id", "term", "w")
    return index.top_k_of_all(matched(t), profiles(t), ["text"], terms, 10).select("query_id", "id", C("score").cast("long").alias("score"), "rank")


@query(f"with k as (select doc_id, unnest({_v1.format('text')}) as w from documents), q as (select item_id, unnest({_v1.format('text')}) as w from benchmark where item_id % 50 = 0) select item_id, doc_id, count(*) as shared, min(w) as least from q join k using (w) where length(w) > 5 group by 1, 2")
def V22_kept_postings(t):
    """The first service's keywords of documents, kept as postings and looked up for every item whose id is divisible by 50."""
    words = lambda df, i: df.select(C(i).alias("id"), F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), L(r"[\p{L}\p{N}_]+"), L(0)), lambda w: w.rlike("^[a-z]{6,}$")))).alias("term"))
    kept = index.build(words(t("documents"), "doc_id").withColumn("w", L(1)))
    met = index.look_up(kept, words(t("benchmark").where("item_id % 50 = 0"), "item_id").withColumnRenamed("id", "query_id"))
    return met.groupBy(C("query_id").alias("item_id"), C("id").alias("doc_id")).agg(F.count("*").alias("shared"), F.min("term").alias("least"))


# --- lexicons as tables ----------------------------------------------------------------------------------------------------

_long = "(select word, row_number() over (order by word) as ordinal from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) as word from benchmark))"


def _benchmark_words(t):
    """The words of eight letters or more of the benchmark, numbered in order."""
    w = t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), L("[a-z]{8,}"), L(0))).alias("key")).distinct()
    return rank.places(w, "ordinal", C("key")).select("ordinal", "key")


@query(WITH + ", k as (select * from (values " + ", ".join(f"('{p}')" for p in lexicon.PHRASES) + ") v(phrase)), x as (select id, lower(concat_ws(' ', areas, replace(topics, '|', ' '))) as t from people) select id, phrase from x join k on contains(t, phrase)")
def J11_lexicon_scan(t):
    """The phrases of the matcher's lexicon in what people work on, in one pass with an automaton instead of a test for each."""
    spark = t("region").sparkSession
    keys = spark.createDataFrame(list(enumerate(lexicon.PHRASES)), "ordinal long, key string")
    rows = people(t).select("id", F.lower(F.concat_ws(" ", "areas", F.replace("topics", L("|"), L(" ")))).alias("t"))
    return phrases.held_keys(rows, C("t"), keys).join(F.broadcast(keys), "ordinal").select("id", C("key").alias("phrase"))


@query(f"with k as {_long} select doc_id, count(*) as n, min(word) as first from documents join k on contains(lower(text), word) group by 1")
def J11_large_lexicon(t):
    """How many of the benchmark's long words stand anywhere in each document, and the first of them by spelling."""
    keys = _benchmark_words(t)
    met = phrases.held_keys(t("documents").select(C("doc_id").alias("id"), "text"), F.lower("text"), keys)
    return met.join(keys, "ordinal").groupBy(C("id").alias("doc_id")).agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query(f"with k as {_long} select doc_id, word from (select doc_id, word, row_number() over (partition by doc_id order by length(word) desc, ordinal) as r from documents join k on contains(lower(text), word)) where r = 1")
def J10_longest_of_lexicon(t):
    """The longest of the benchmark's long words that a document holds, of equally long ones the first."""
    keys = _benchmark_words(t)
    return phrases.longest_key(t("documents").select(C("doc_id").alias("id"), "text"), F.lower("text"), keys).join(keys, "ordinal").select(C("id").alias("doc_id"), C("key").alias("word"))


@query(WITH + LISTED_SQL + ", k as (select lower(trim(name)) as k, min(ordinal) as ordinal from listed where trim(name) <> '' group by 1), n as (select id, lower(trim(replace(name, 'Dr. ', ''))) as n from people where name is not null) select id, min(ordinal) as ordinal, count(*) as n from n join k on contains(n, k) or (n <> '' and contains(k, n)) group by 1")
def J14_known_names(t):
    """The listed names that hold a person's name or are held by it: how many, and the first."""
    names_ = listed(t).where("trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("ordinal").alias("ordinal"))
    n = people(t).where("name is not null").select("id", F.lower(F.trim(F.replace(C("name"), L("Dr. "), L("")))).alias("n"))
    return phrases.either_holds(n, C("n"), names_).groupBy("id").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n"))


# --- vectors ---------------------------------------------------------------------------------------------------------------


@query(SQL["T29_cosine_topk"])
def T29_pivot_topk(t):
    """As T29_cosine_topk, by cells around pivots and the triangle inequality instead of all pairs."""
    v = t("embeddings").select(C("vec_id").alias("id"), C("embedding").alias("v"))
    return nearest.top_k(v, v.where("id % 50 = 0"), 10).select("query_id", C("id").alias("vec_id"), "cosine", "rank")


# --- state of streams ------------------------------------------------------------------------------------------------------

_TTL = 3600


@query(
    f"""with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
r(user_id, event_id, us, n, loaded, outcome) as (select user_id, event_id, us, n, us, 'load' from e where n = 1
union all select e.user_id, e.event_id, e.us, e.n, case when e.us - r.loaded < {_TTL}000000 then r.loaded else e.us end, case when e.us - r.loaded < {_TTL}000000 then 'hit' else 'load' end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id as key, event_id, outcome, us - loaded as age_us from r"""
)
def G3_cache(t):
    """Requests to a cache whose values live an hour: which of each user's events find one, and which load it (again)."""
    e = t("events").select(C("user_id").alias("key"), "event_id", C("ts").cast("timestamp").alias("ts"))
    spark, path = e.sparkSession, fresh_path(e.sparkSession, "requests")
    # two runs' worth of files in order of time; the second batch meets the state that the first one left
    half = e.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    for k, part in enumerate((F.unix_micros("ts") <= half, F.unix_micros("ts") > half)):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        with streams.keyed_state(spark):
            streams.appended(streams.cached(stream, _TTL, "1 minute"), f"{path}/checkpoint", f"{path}/out")
    return spark.read.parquet(f"{path}/out")


@query("select user_id, event_type, count(*) over () as rows_there from (select distinct user_id, event_type from events)")
def D9_stream_guard(t):
    """Pairs of user and kind put into a table if they are not there, by two runs of a stream that remembers what came before."""
    e = t("events").select("user_id", "event_type", C("ts").cast("timestamp").alias("ts"), "event_id")
    spark, path = e.sparkSession, fresh_path(e.sparkSession, "pairs")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        streams.appended(streams.first_ones(stream, ["user_id", "event_type"], "ts", "36500 days"), f"{path}/checkpoint", f"{path}/out")
    there = spark.read.parquet(f"{path}/out").select("user_id", "event_type")
    return there.join(F.broadcast(there.agg(F.count("*").alias("rows_there"))))


# --- keyed tables ----------------------------------------------------------------------------------------------------------

_topics = "case when event_id % 7 = 0 then '' when event_id % 7 = 1 then ' , ' else coalesce(event_type, '') || ', ' || (event_id % 5) || ' ,' end"
_clean = "array_to_string(list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x <> ''), ', ')"


@query(
    f"with e as (select user_id, ts, event_id, {_clean.format(_topics)} as topics from events), p as (select user_id, min(ts) as created from e where event_id % 3 = 0 and topics <> '' group by 1), "
    "l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from e where topics <> ''), l0 as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from e where topics <> '' and event_id % 3 = 0), n as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from e where topics <> '' and event_id % 3 = 1) where r = 1) "
    "select coalesce(n.user_id, a.user_id) as user_id, coalesce(n.topics, a.topics) as topics, coalesce(a.edits, 0) + (n.user_id is not null)::int as edits, (select count(*) from e where topics = '' and event_id % 3 = 1) as refused "
    "from (select user_id, topics, 1 as edits from l0 where r = 1) a full join n using (user_id)"
)
def V5_upsert(t):
    """Profiles put in by answers, one row a user: the latest answer counts, answers without a topic are refused, edits are counted."""
    topics = F.array_join(F.filter(F.transform(F.split(F.expr(_topics.replace("|| (event_id % 5) ||", "|| cast(event_id % 5 as string) ||")), ","), lambda x: F.trim(x)), lambda x: x != ""), ", ")
    e = t("events").select("user_id", "ts", "event_id", topics.alias("topics"), L(1).alias("edits"))
    spark, path = e.sparkSession, fresh_path(e.sparkSession, "profiles")
    keyed.create(rank.keep_first(e.where("topics <> '' and event_id % 3 = 0"), ["user_id"], C("ts").desc(), C("event_id").desc()), path, ["user_id"], 16)
    refused, _ = keyed.merge(e.where("event_id % 3 = 1"), path, ["user_id"], 16, [C("ts"), C("event_id")], C("topics") != "", {"edits": C("old.edits") + 1})
    return keyed.read(spark, path).select("user_id", "topics", C("edits").cast("int").alias("edits"), L(refused).cast("long").alias("refused"))


@query("select c_custkey as label, coalesce(n.plan, 'plan-' || c_nationkey) as plan, coalesce(o.used, 0) as used, case when n.plan is not null then 'changed' else 'kept' end as state from customer left join (select o_custkey, count(*) as used from orders where o_orderstatus = 'F' group by 1) o on o_custkey = c_custkey left join (select s_suppkey, 'plan-' || s_nationkey || '-new' as plan from supplier where s_suppkey % 9 = 0) n on s_suppkey = c_custkey")
def V17_accounts_in_place(t):
    """Accounts brought up to date by label in place: new settings count, credits used stay."""
    used = t("orders").where("o_orderstatus = 'F'").groupBy(C("o_custkey").alias("label")).agg(F.count("*").alias("used"))
    a = t("customer").select(C("c_custkey").alias("label"), F.concat(L("plan-"), "c_nationkey").alias("plan")).join(used, "label", "left")
    a = a.select("label", "plan", F.coalesce("used", L(0)).alias("used"), L("kept").alias("state"))
    spark, path = a.sparkSession, fresh_path(a.sparkSession, "accounts")
    keyed.create(a, path, ["label"], 16)
    there = a.select("label")
    new = t("supplier").where("s_suppkey % 9 = 0").select(C("s_suppkey").alias("label"), F.concat(L("plan-"), "s_nationkey", L("-new")).alias("plan"), L(0).cast("long").alias("used"), L("changed").alias("state")).join(there, "label", "left_semi")
    keyed.merge(new, path, ["label"], 16, [C("plan")], L(True), {"used": F.coalesce(C("old.used"), L(0))})
    return keyed.read(spark, path)
