"""Queries over whole tables against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from talus.functions import text
from talus.operators import rank
from talus.plans import catalog, files, joins, matching, older, pages, people, reshape, scores  # noqa: F401

DIR = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("rows", [[], [(5, 1)], [(None, 4), (3, 2), (-1, 7), (10**12, 1)], [(k * k, k % 7) for k in range(300)]])
def test_running_sum_equals_a_loop(spark, rows):
    df = spark.createDataFrame(rows, "k long, v long")
    at, want = 0, {}
    for k, v in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        at += v
        want[k] = at
    assert {r.k: r.total for r in rank.running_sum(df, "v", "k").collect()} == want


def page_email(html):
    linked = [a.strip().lower() for a in re.findall(r"""(?i)href\s*=\s*["']?mailto:([^"'?>]*)""", html)]
    linked = [a for a in linked if a and a.split("@")[0] not in text.GENERIC_LOCALS]
    seen = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
    found = re.findall(text.EMAIL, re.sub("<[^>]*>", " ", seen).lower(), re.ASCII)
    return next(iter(linked + [a for a in found if not a.startswith(tuple(text.GENERIC_LOCALS))]), None)


def test_page_email_has_every_page(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", F.expr(pages._mailed).alias("html")).collect()}
    got = {r.page_id: r.email for r in catalog.QUERIES["V9_page_email"](spark, DIR).collect()}
    assert got == {i: page_email(h) for i, h in html.items()}
    assert any(i % 3 == 2 for i in got)


@pytest.mark.parametrize("name", ["T29_cosine_topk", "W9_mmr"])
def test_every_50th_vector_is_searched_for(spark, name):
    """The ids divisible by 50, each with ten rows."""
    rows = lambda df: {tuple(r) for r in df.collect() if r.query_id % 50 == 0}
    got = rows(catalog.QUERIES[name](spark, DIR))
    ids = {r.vec_id for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 50 == 0}
    assert len(ids) > 4 and len(got) == 10 * len(ids)
    assert {r[0] for r in got} == ids


def test_every_50th_item_is_searched_for(spark):
    items = spark.createDataFrame([(i, f"planet{i} common{i % 7} the tion") for i in range(120)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"planet{d} common{d % 7}") for d in range(120)], "doc_id long, text string")
    t = {"benchmark": items, "documents": docs}.get
    got = {(r.item_id, r.rank): (r.doc_id, r.hits) for r in catalog.J12_candidates(t).collect()}
    want = {}
    for i in (0, 50, 100):
        near = [d for d in range(120) if d % 7 == i % 7]
        for k, d in enumerate([i] + [d for d in near if d != i][:9]):
            want[i, k + 1] = (d, 2 if d == i else 1)
    assert got == want
