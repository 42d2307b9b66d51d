"""Addresses in pages, the limiter and the readers against small fixtures."""

import json
from collections import defaultdict
from datetime import timedelta

from pyspark.sql import functions as F

from talus.functions import web
from talus.plans.pages import G1_limiter
from talus.sources import tables

DIR = "/root/testdata/sf0.001"


def test_addresses_of_a_page(spark):
    page = "<script>var a='x@y.edu'</script><a href='mailto:Info@a.edu'>i</a><a href=\"mailto:jane.doe&#64;a.edu?subject=s\">me</a> j_doe [at] b [dot] edu <p>doe@c.edu</p>jd@d.edu"
    df = spark.createDataFrame([(1, "Jane Doe", page), (2, "Jane Doe", None), (3, "", "<p>doe@a.edu</p>")], "id int, name string, html string")
    got = {(r.id, r.email, r.method) for r in web.address_candidates(df).collect()}
    assert got == {(1, "info@a.edu", "mailto"), (1, "jane.doe@a.edu", "mailto"), (1, "j_doe@b.edu", "obfuscated"), (1, "doe@c.edu", "regex"), (1, "jd@d.edu", "regex"), (3, "doe@a.edu", "regex")}
    best = web.best_address(web.address_candidates(df), ["a.edu", "c.edu"]).collect()
    assert [(r.id, r.email, r.method) for r in best] == [(1, "jane.doe@a.edu", "mailto")]
    assert abs(best[0].score - 1.3) < 1e-9  # 0.5 + 0.3 + 0.2 + 0.1 is cut to 1, the link adds 0.3


def test_page_email_prefers_links(spark):
    df = spark.createDataFrame([('<a href="mailto:office@a.edu">o</a> sue@b.edu',), ('sue@b.edu <a href="mailto:Al@a.edu?x=1">o</a>',), (None,), ("",)], "html string")
    assert [r.e for r in df.select(web.page_email(F.col("html")).alias("e")).collect()] == ["sue@b.edu", "al@a.edu", None, None]


def test_limiter_equals_a_loop(spark):
    events = spark.read.parquet(f"{DIR}/events.parquet").select("user_id", "ts", "event_id").collect()
    held, want = defaultdict(list), {}
    for user, ts, event in sorted(events, key=lambda r: (r[0], r[1], r[2])):
        held[user] = [x for x in held[user] if ts - x < timedelta(days=1)]
        want[event] = len(held[user]) < 10
        if want[event]:
            held[user].append(ts)
    got = {r.event_id: r.admitted for r in G1_limiter(spark, DIR).collect()}
    assert got == want


def test_json_records(spark, tmp_path):
    for name, value in {"a": [{"n": 1}, {"n": 2}], "b": {"faculty": [{"n": 3}]}, "c": {"n": 4}, "d": {"awards": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    rows = tables.read_json_records(spark, str(tmp_path), recursive=True).collect()
    got = {(r.file, r.ordinal, json.loads(r.record)["n"]) for r in rows}
    assert got == {("a.json", 0, 1), ("a.json", 1, 2), ("b.json", 0, 3), ("c.json", 0, 4)}


def test_aliased_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Name,affiliation\n"Doe, Jane",MIT\n,MIT\nAl, \n')
    rows = tables.read_aliased_csv(spark, str(tmp_path / "x.csv"), {"name": ["Name", "professor_name"], "affiliation": [], "email": []}, ["name", "affiliation"]).collect()
    assert [tuple(r) for r in rows] == [("Doe, Jane", "MIT", None)]


def test_split_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad")], "id int, k string, error string")
    good, dead = tables.split_failures(df, "error")
    assert [r.id for r in good.collect()] == [1] and [r.id for r in dead.collect()] == [2]
    tables.write_split(df, str(tmp_path / "out"), "k")
    assert sorted(p.name for p in (tmp_path / "out").glob("k=*")) == ["k=a", "k=b"]
