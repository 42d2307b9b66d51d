"""Addresses in web pages, scores of search results and checks of a page against a person, as column expressions."""

from __future__ import annotations

import html
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talus.functions import text
from talus.functions.rules import any_of
from talus.operators.match import points
from talus.operators.rank import keep_first

# Sites and paths that hold no personal page, sites that only list others' work, and where people's pages are.
DENIED_SITES = "facebook.com twitter.com x.com instagram.com linkedin.com tiktok.com youtube.com doi.org pubmed.ncbi.nlm.nih.gov arxiv.org biorxiv.org wikipedia.org amazon.com".split()
DENIED_PATHS = "/login /signin /auth /course/ /courses/ /news/article /press-release .pdf .doc .ppt /search? /tag/ /category/ /event/".split()
AGGREGATORS = "research.com researchgate.net academia.edu semanticscholar.org scholar.google.com aminer.org".split()
PUBLICATION_PATHS = ["/pubs", "/publications/", "/papers/"]
PERSONAL = ["/~", "/people/", "/faculty/", "/profile/", "/lab/", "/labs/", "/group/", "people.", "scholar.", "/person/", "/staff/"]
HOMEPAGE_WORDS = ["publications", "research", "teaching", "cv", "curriculum vitae", "students", "lab", "group", "contact", "about", "bio", "projects"]

# What each way of finding an address adds to its score.
METHOD_BOOST = {"mailto": 0.3, "regex": 0.2, "obfuscated": 0.1, "contact_page": 0.15}

_SPELLED = r"([A-Za-z0-9._%+-]+)(?:\s*\[\s*at\s*\]\s*|\s*\(\s*at\s*\)\s*|\s+at\s+)([A-Za-z0-9.-]+)(?:\s*\[\s*dot\s*\]\s*|\s*\(\s*dot\s*\)\s*|\s+dot\s+)([A-Za-z]{2,})"


@F.arrow_udf(StringType())
def unescaped(source: pa.Array) -> pa.Array:
    """Text with its character references decoded."""
    return pa.array([None if s is None else html.unescape(s) for s in source.to_pylist()], pa.string())


def visible_text(page: Column) -> Column:
    """The text of a page: tags become spaces so that words beside them stay apart; scripts, styles and comments go."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]*>", " "), r"\s+", " "))


def mailto_addresses(page: Column) -> Column:
    """Addresses of mailto links in lower case, in order; without what follows a question mark."""
    found = F.regexp_extract_all(page, F.lit(r"""(?i)href\s*=\s*["']?mailto:([^"'?>]*)"""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda e: F.lower(F.trim(e))), lambda e: e != ""))


def spelled_addresses(source: Column) -> Column:
    """Addresses written with at and dot as words or in brackets."""
    found = F.regexp_extract_all(source, F.lit("(?i)" + _SPELLED), F.lit(0))
    return F.array_distinct(F.transform(found, lambda e: F.lower(F.regexp_replace(e, "(?i)^" + _SPELLED + "$", "$1@$2.$3"))))


def generic_local(email: Column) -> Column:
    return F.substring_index(F.lower(email), "@", 1).isin(*text.GENERIC_LOCALS)


def page_email(page: Column) -> Column:
    """The first mailto address that no office uses, else the first personal address in the text."""
    linked = F.filter(mailto_addresses(page), lambda e: ~generic_local(e))
    return F.coalesce(F.get(linked, F.lit(0)), F.get(text.emails(visible_text(page)), F.lit(0)))


def address_candidates(pages: DataFrame) -> DataFrame:
    """(id, name, email, method) of pages (id, name, html); references in the page are decoded first."""
    p = pages.select("id", "name", unescaped("html").alias("html")).withColumn("text", visible_text(F.col("html")))
    ways = {"mailto": mailto_addresses(F.col("html")), "regex": F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0)), F.lower)), "obfuscated": spelled_addresses(F.col("text"))}
    named = lambda m: lambda e: F.struct(e.alias("email"), F.lit(m).alias("method"))
    each = p.select("id", "name", F.explode(F.concat(*[F.transform(a, named(m)) for m, a in ways.items()])).alias("c"))
    return each.select("id", "name", "c.email", "c.method")


def email_name_score(email: Column, name: Column, fuzzy: bool = True) -> Column:
    """How well an address suits a name, 0 to 1: last name .5, first name .3, a usual pattern .2, a similar spelling .1."""
    local = F.substring_index(F.lower(email), "@", 1)
    first, last = text.name_part(name, False), text.name_part(name, True)
    one, within = F.left(first, F.lit(1)), lambda *p: F.contains(local, F.concat(*p))
    usual = within(one, last) | within(last, one) | within(first, last)
    for mark in "_.":
        usual = usual | within(one, F.lit(mark), last) | within(first, F.lit(mark), last) | within(last, F.lit(mark), first)
    out = F.when((F.length(last) > 2) & within(last), 0.5).otherwise(0.0) + F.when((F.length(first) > 2) & within(first), 0.3).otherwise(0.0) + F.when(usual, 0.2).otherwise(0.0)
    if fuzzy:
        out = out + F.when(text.seq_ratio(local, F.concat(first, last)) > 0.7, 0.1).otherwise(0.0)
    return F.when((F.coalesce(email, F.lit("")) == "") | (F.coalesce(F.trim(name), F.lit("")) == ""), 0.0).otherwise(F.least(F.lit(1.0), out))


def within_domains(email: Column, domains: list[str]) -> Column:
    host, out = F.split_part(F.lower(email), F.lit("@"), F.lit(2)), F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def best_address(candidates: DataFrame, domains: list[str], fuzzy: bool = True) -> DataFrame:
    """(id, email, method, score): for each id the address with the highest score among those of its domains that suit the name.

    An address suits with a name score of .35 (.25 for a mailto link) or a total of .4. Of equals the first by address.
    """
    boost = F.coalesce(*[F.when(F.col("method") == m, v) for m, v in METHOD_BOOST.items()], F.lit(0.0))
    scored = candidates.where(within_domains(F.col("email"), domains) & ~text.generic_address(F.col("email"))).withColumn("fit", email_name_score(F.col("email"), F.col("name"), fuzzy))
    scored = scored.withColumn("score", F.round(F.col("fit") + boost, 4))
    good = scored.where((F.round("fit", 4) >= F.when(F.col("method") == "mailto", 0.25).otherwise(0.35)) | (F.col("score") >= 0.4))
    return keep_first(good, ["id"], F.col("score").desc(), F.col("email"), F.col("method")).select("id", "email", "method", "score")


def denied(url: Column) -> Column:
    return any_of(F.lower(url), DENIED_SITES + DENIED_PATHS)


def page_type(url: Column, site: str) -> Column:
    u = F.lower(url)
    return (
        F.when(any_of(u, AGGREGATORS), "aggregator").when(any_of(u, PUBLICATION_PATHS), "publications").when(any_of(u, PERSONAL), "personal")
        .when(F.lit(bool(site)) & F.contains(u, F.lit(site)), "department").otherwise("unknown")
    )


def result_score(url: Column, title: Column, description: Column, name: Column, site: str) -> Column:
    """The additive score of a search result as a person's website, without the bonus for its rank. In hundredths inside."""
    u, t, both = F.lower(url), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    first, last = text.name_part(name, False), text.name_part(name, True)
    kind = page_type(url, site)
    base = F.when(kind == "aggregator", -40).when(kind == "publications", -20).when(kind == "personal", 10).when(kind == "department", 5).otherwise(0)
    place = F.when(F.contains(u, F.lit("/~")), 35).when(any_of(u, ["/people/", "/faculty/", "/profile/"]), 20).when(any_of(u, ["/lab/", "/labs/", "/group/"]), 15).otherwise(0)
    words = points(*[(F.contains(both, F.lit(w)), 1) for w in HOMEPAGE_WORDS])
    long_ = lambda n: F.length(n) > 2
    terms = points(
        (F.lit(bool(site)) & F.contains(u, F.lit(site)), 40), (F.contains(u, F.lit(".edu")), 20), (long_(last) & F.contains(u, last), 25), (long_(last) & F.contains(t, last), 15),
        (long_(first) & F.contains(t, first), 10), (F.contains(t, F.lower(name)), 20), (words >= 2, 10), (F.regexp_replace(u, "/+$", "").rlike("/(people|faculty|directory|staff)$"), -30),
    )
    return (base + place + terms) / 100.0


def with_rank(score: Column, at: Column) -> Column:
    """The score with the bonus for the place among the results, from 0."""
    return score + 0.05 * (10 - at) / 10


def website_confidence(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.3, "medium").when(score >= 0.15, "low")


def four_signals(url: Column, title: Column, name: Column, site: str) -> Column:
    """The older score of a search result: site .4, last name in URL .25 and in title .15, path of a person .2."""
    u, last = F.lower(url), text.name_part(name, True)
    return points((F.lit(bool(site)) & F.contains(u, F.lit(site)), 40), (F.contains(u, last), 25), (F.contains(F.lower(title), last), 15), (any_of(u, ["/~", "/people/", "/faculty/", "/profile/"]), 20)) / 100.0


def page_of(url: Column, content: Column, name: Column, email: Column, department: Column, school: Column, status: Column) -> Column:
    """Whether a page is a person's. status: the HTTP status, null where the page could not be had.

    A page is if it or its URL has the last name; if the email's host is its site's and its path is a person's; if it has the
    department and the first name; or if its URL has the school and a person's path. One that could not be had is by its path.
    """
    u, c, low = F.lower(url), F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(school, F.lit("")))
    words = F.split(F.trim(F.regexp_replace(name, "(?i)^Dr\\.\\s*", "")), "\\s+")
    first, last = F.lower(F.get(words, F.lit(0))), F.when(F.size(words) >= 2, F.lower(F.element_at(words, -1))).otherwise("")
    host, at = F.split_part(F.lower(email), F.lit("@"), F.lit(2)), text.domain(url)
    # Paths of persons.
    paths = ["/people/", "/faculty/", "/professor/"]
    named = (last != "") & (F.contains(c, last) | F.contains(u, last))
    sited = (host != "") & (F.contains(at, host) | F.contains(host, at)) & any_of(u, [*paths, "/~", "/staff/"])
    placed = (F.coalesce(department, F.lit("")) != "") & F.contains(c, F.lower(department)) & (first != "") & F.contains(c, first)
    schooled = (F.contains(low, F.lit("harvard")) & F.contains(u, F.lit("harvard")) & any_of(u, paths)) | (F.contains(low, F.lit("mit")) & F.contains(u, F.lit("mit")) & any_of(u, [*paths, "/~"]))
    had = reduce(lambda x, y: x | y, [F.coalesce(x, F.lit(False)) for x in (named, sited, placed, schooled)])
    return F.when(F.coalesce(url, F.lit("")) == "", False).when(status.isNull(), any_of(u, [*paths, "/~"])).otherwise((status < 400) & had)


def candidate_urls(forms: list[Column], templates: list[str]) -> Column:
    """Each spelling of a name in each template ({} stands for it), without repeats, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.concat(F.lit(t.split("{}")[0]), f, F.lit(t.split("{}")[1])) for f in forms for t in templates])))


def heading_names(page: Column, levels: str = "2-4", longest: int = 60) -> Column:
    """Texts of headings that can be names: with a space and not longer than the limit; without repeats, in order."""
    inner = F.regexp_extract_all(page, F.lit(rf"(?s)<h[{levels}][^>]*>(.*?)</h[{levels}]>"), F.lit(1))
    plain = F.transform(inner, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")))
    return F.array_distinct(F.filter(plain, lambda h: F.contains(h, F.lit(" ")) & (F.length(h) <= longest)))


# What tells of a page with addresses, in a link's target and in its text; and how many such pages are looked at.
CONTACT_TARGETS = (
    "/contact", "/about", "/email", "/bio", "/profile", "/cv", "/home", "biography", "personal", "/people/", "/faculty/", "/staff/", "/directory/", "/info", "/reach",
    "/connect", "?page=contact", "?view=contact", "?tab=contact",
)
CONTACT_WORDS = ("contact", "email", "reach", "about me", "bio")
MOST_CONTACT_PAGES = 7


def contact_pages(page: Column, url: Column) -> Column:
    """Pages of the same host that a page links to as contact pages, in order, and those that usually are; seven at most."""
    parts = F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"']?([^\"'> ]*)[^>]*>.*?</a>"), F.lit(1))
    words = F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"']?[^\"'> ]*[^>]*>(.*?)</a>"), F.lit(1))
    host, root = text.domain(url), F.regexp_extract(url, "^([a-z]+://[^/?#]*)", 1)
    whole = lambda h: F.when(h.rlike("(?i)^[a-z]+://"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(F.regexp_replace(url, "[^/]*$", ""), h))
    links = F.zip_with(parts, words, lambda h, w: F.struct(h.alias("h"), F.lower(w).alias("w")))
    some = F.filter(links, lambda x: ~F.lower(x["h"]).startswith("mailto:") & (any_of(F.lower(x["h"]), CONTACT_TARGETS) | any_of(x["w"], CONTACT_WORDS)))
    there = F.filter(F.transform(some, lambda x: whole(x["h"])), lambda u: F.contains(text.domain(u), host) & (u != url))
    base = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    usual = F.array(F.concat(base, F.lit("/contact")), F.concat(root, F.lit("/contact")), F.concat(base, F.lit("?tab=contact")))
    return F.slice(F.array_distinct(F.concat(there, usual)), 1, MOST_CONTACT_PAGES)


def link_names(page: Column, longest: int = 60) -> Column:
    """Texts of links that can be names, as heading_names."""
    inner = F.regexp_extract_all(page, F.lit(r"(?s)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    plain = F.transform(inner, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")))
    return F.array_distinct(F.filter(plain, lambda h: F.contains(h, F.lit(" ")) & (F.length(h) <= longest)))


def directory_entries(pages: DataFrame) -> DataFrame:
    """(name, email, website) of directory pages (page, html): the first six words before each mailto link since the one before it, its
    address, and the first web link behind it. A later page, and a later place in it, overwrites an earlier one of the same name."""
    part = F.split(F.col("html"), r"(?i)<a\b[^>]*href\s*=\s*[\"']?mailto:", -1)
    each = pages.select("page", F.posexplode(part).alias("at", "part"), F.col("html"))
    before = F.lag("part").over(Window.partitionBy("page").orderBy("at"))
    each = each.withColumn("before", before).where("at > 0")
    email = F.lower(F.trim(F.regexp_extract("part", r"^([^\"'>?]*)", 1)))
    # what follows the link before this one up to the end of its entry belongs to that
    own = F.when(F.col("at") > 1, F.regexp_replace("before", r"(?s)^.*?</(?:div|li|tr|p)>", "")).otherwise(F.col("before"))
    words = F.filter(F.split(visible_text(own), r"\s+"), lambda w: w != "")
    site = F.regexp_extract("part", r"(?i)<a\b[^>]*href\s*=\s*[\"']?(https?://[^\"'> ]*)", 1)
    found = each.select("page", "at", F.array_join(F.slice(words, 1, 6), " ").alias("name"), email.alias("email"), site.alias("website")).where("email <> '' and name <> ''")
    last = Window.partitionBy(F.lower("name")).orderBy(F.col("page").desc(), F.col("at").desc())
    return found.withColumn("n", F.row_number().over(last)).where("n = 1").select("name", "email", "website")
