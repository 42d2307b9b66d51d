"""Work whose memory in a task, or whose time, must not grow with the number of rows."""

from pyspark.sql import functions as F

from talus.functions import dom
from talus.operators import index, rank, websites
from talus.plans import catalog, reshape  # noqa: F401  (its queries)

DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_different_items(spark):
    rows = [(1, [("a", 1), (None, 2), ("b", 3), ("a", 4), ("c", 5), ("d", 6)]), (2, [(None, 1)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id long, l array<struct<k: string, n: int>>")
    got = {r.id: r.l and [tuple(x) for x in r.l] for r in df.select("id", rank.first_different(F.col("l"), "k", 3).alias("l")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("c", 5)], 2: [], 3: [], 4: None}


def test_search_results_are_not_sorted(spark):
    """all results of a file were sorted in the one task that reads it."""
    for name in ("S7_search_results", "V10_result_emails", "V7_evaluation"):
        plan = plan_of(catalog.QUERIES[name](spark, DIR))
        assert "Sort" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_websites_are_looked_for_once_for_equal_names(spark, monkeypatch):
    """200 people of three names, one of them without a spelling; URLs are made for the contents, and all people have their rows."""
    kinds = [("Jane Doe", "MIT", "Biology", "jane@mit.edu", None), ("Al Li", "Harvard", None, None, "http://a.b/1"), ("Al", "MIT", "", None, "http://gone/")]
    people = spark.createDataFrame([(i, *kinds[i % 3]) for i in range(200)], "id long, name string, school string, department string, email string, website string")
    fed, candidates = [], websites.candidates
    monkeypatch.setattr(websites, "candidates", lambda p: fed.append(p.count()) or candidates(p))
    of, tries = websites.by_name(people)
    assert fed == [3] and tries.select("id").distinct().count() == 2
    assert of.join(tries.withColumnRenamed("id", "named"), "named").select("id").distinct().count() == 134
    fetched = spark.createDataFrame([("http://a.b/1", 200, "x"), ("http://gone/", 404, None), ("https://web.mit.edu/doe/www/", 200, "x doe")], "url string, status int, html string")
    got = {(r.id, r.url, r.state, r.n_tried) for r in websites.validated(people, fetched).collect()}
    want = [("https://web.mit.edu/doe/www/", "fixed", 3), ("http://a.b/1", "valid", 0), (None, "failed", 0)]
    assert got == {(i, *want[i % 3]) for i in range(200)}
    assert fed[1:] == [2]  # those of the people without a website that answers


def test_postings_are_sorted_in_parts_of_bounded_size(spark, monkeypatch):
    """The number of sorts follows the number of postings, not the setting alone."""
    monkeypatch.setattr(index, "SORTED", 100)
    rows = spark.range(3000).selectExpr("id div 3 as id", "concat('t', id % 3) as term", "1 as w")
    kept = index.build(rows)
    of = kept.postings.selectExpr("_metadata.file_name as f").distinct().selectExpr("split_part(f, '-', 2) as task").distinct().count()
    assert of >= 25 and kept.forward.count() == 1000 and kept.postings.count() == 3000
    met = index.look_up(kept, spark.createDataFrame([(7, "t1"), (8, "t1"), (8, "t2")], "query_id long, term string"))
    assert met.rdd.getNumPartitions() == 30 and met.distinct().count() == met.count() == 3000
    none = index.look_up(kept, spark.createDataFrame([(7, "t9")], "query_id long, term string"))
    assert none.count() == 0


def test_pages_are_parsed_once(spark):
    """each use of the nodes parsed all pages again."""
    pages = spark.createDataFrame([(1, "http://a.b/c", "<div class=person><h3>Jane Doe</h3><a href='mailto:j@a.b'>m</a></div>")], "id long, url string, html string")
    got = dom.directory(pages, F.lower, lambda e: e.isNotNull())
    assert {(r.key, r.email) for r in got.collect()} >= {("jane doe", "j@a.b")}
    assert "MapInArrow" not in plan_of(got)
