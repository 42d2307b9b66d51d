"""Rubrics that score entities against profiles, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import rules


# Words of a kind of work that tell nothing.
WORK_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "using", "based", "into", "through", "between", "over", "such", "also", "more", "than", "has", "are", "was", "were",
    "been",
)


def points(*terms: tuple[Column, int]) -> Column:
    """The sum of the points whose condition holds; null counts as not."""
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in terms])


def url_score(url: Column, domain: Column, path: Column, first: Column, last: Column, primary: list[str], secondary: list[str], rejected: list[str]) -> Column:
    trust = F.when(rules.any_of(domain, primary), 100).when(rules.any_of(domain, secondary), 80).when(domain.endswith(".edu"), 40).otherwise(0)
    # Paths of profile pages.
    profile = ["/people/", "/person/", "/profile/", "/profiles/", "/faculty/", "/directory/", "/bios/", "/find-a-doctor", "/provider", "/team/", "/member-detail"]
    low = F.lower(url)
    return trust + points((rules.any_of(path, profile), 30), ((F.length(last) > 0) & F.contains(low, last), 20), ((F.length(first) > 0) & F.contains(low, first), 10), (rules.any_of(domain, rejected), -50), (path.endswith(".pdf"), -30), (F.contains(path, F.lit("/search")) | F.contains(path, F.lit("/results")), -20))


def email_score(email: Column, first: Column, last: Column, primary: list[str], secondary: list[str]) -> Column:
    """Points of an address as a person's: trust in its host, the name in it; less for junk, for others' addresses and foreign hosts."""
    e = F.lower(F.trim(email))
    local, dom = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    # Junk senders.
    junk = rules.any_of(local, ["admin", "support", "noreply", "no-reply", "donotreply", "helpdesk", "webmaster", "postmaster", "info"])
    # Hosts that give anybody an address.
    free = dom.isin("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "protonmail.com", "scispace.com")
    has = lambda name: (name != "") & F.contains(local, name)
    foreign = ~dom.endswith(".edu") & ~rules.any_of(dom, primary + secondary)
    trust = F.when(rules.any_of(dom, primary), 100).when(rules.any_of(dom, secondary), 80).when(dom.endswith(".edu"), 30).otherwise(0)
    out = trust + points((has(last), 20), ((first != "") & local.startswith(F.left(first, F.lit(1))), 10), (free | junk, -100), (~has(last) & ~has(first) & junk & foreign, -100), ((last != "") & ~has(last) & foreign, -50))
    return F.when(F.contains(e, F.lit("@")), out).otherwise(0)


def five_question(hits: Column, keywords: Column, h: Column, level: str, needs_funding: bool, grants: Column, email: Column, verified: Column, website: Column) -> Column:
    """Five questions, 100 points: research 50, level 20, funding 15, contact 15."""
    # The range of h-index that suits each level.
    low, high = {"undergrad": (5, 60), "masters": (10, 100), "phd": (15, 150), "postdoc": (20, 200)}[level]
    research = F.when(keywords > 0, F.least(F.lit(50.0), hits / keywords * 50)).otherwise(25.0)
    fit = F.when(h.between(low, high), 20.0).when(h < low, 10.0).otherwise(15.0)
    funding = F.when(grants > 0, 15.0).otherwise(0.0) if needs_funding else F.lit(10.0)
    contact = F.least(F.lit(15), points((email, 10), (email & verified, 3), (website, 2)))
    return research + fit + funding + contact


def action_points(join_page: Column, openings: Column, days: Column, website: Column, email: Column) -> Column:
    base = points((join_page, 4), (openings, 3)) + F.when(days <= 180, 2).when(days <= 365, 1).otherwise(0)
    return F.when(base == 0, points((website, 1), (email, 1))).otherwise(base)


def tag_score(department: Column, haystack: Column, title: Column, key: str, display: str, work: str, involvement: str, year: str) -> Column:
    """Four answers, 100 points: research area 40, kind of work 30, involvement 20, year 10."""
    area = F.when(rules.category(department) == key, 40).when(F.contains(haystack, F.lit(display.lower())), 24).when(F.contains(haystack, F.lit(key)), 16).otherwise(0)
    words = [w for w in work.lower().split() if len(w) > 2 and w not in WORK_STOPWORDS]
    kind = F.when(F.contains(haystack, F.lit(work.lower())), 30).when(rules.any_of(haystack, words), 18).otherwise(0)
    bucket = rules.involvement(title)
    time = F.when(bucket == involvement, 20).when(F.lit(involvement == "flexible") & (bucket == "part_time"), 8).otherwise(0)
    graduate = year == "Graduate"
    # What tells of a student's year.
    hints = ["phd", "ph.d", "doctoral", "graduate", "master", "postdoc"] if graduate else ["undergraduate", "ug ", "course", "summer"]
    return area + kind + time + F.when(rules.any_of(haystack, hints), 10).otherwise(4 if graduate else 5)


def term_search(df: DataFrame, terms: list[str], weights: dict[str, int]) -> Column:
    """Points for each term in each column that contains it."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower())), w).otherwise(0) for t in terms for c, w in weights.items()])


def display_priority(email: Column, website: Column, h: Column) -> Column:
    """What is known of a person: an email 2, a website 1, an h-index one half."""
    some = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")
    return 2.0 * some(email) + some(website) + 0.5 * h.isNotNull().cast("int")


def browse(people: DataFrame, school: str = "", category: str = "", subfield: str = "", location: str = "") -> DataFrame:
    """people (school, category, department, location) that go with all choices made; an empty one is off, as is a location that nobody has."""
    given = lambda c: F.coalesce(c, F.lit(""))
    if location and people.where(F.col("location") == location).isEmpty():
        location = ""
    for c, value in (("school", school), ("category", category), ("department", subfield)):
        if value:
            people = people.where(given(F.col(c)) == value)
    return people.where(F.contains(given(F.col("location")), F.lit(location))) if location else people
