"""Found values held against known ones, and the older additive rubrics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions import text
from talus.operators.match import points

# The range of h-index that suits each level.
LEVEL_RANGES = {"undergrad": (5, 60), "masters": (10, 100), "phd": (15, 150), "postdoc": (20, 200)}


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def website_points(found: Column, known: Column, name: Column) -> Column:
    """1 for the known page, 0.7 for its domain, 0.5 for a URL with the last name, 0.2 for any; 0 for none."""
    f, k = text.url_key(found), text.url_key(known)
    both = given(f) & given(k)
    last = text.name_part(name, True)
    return (
        F.when(both & (f == k), 1.0).when(both & (text.domain(f) == text.domain(k)), 0.7)
        .when(both & given(last) & F.contains(f, last), 0.5).when(given(found), 0.2).otherwise(0.0)
    )


def email_points(found: Column, known: Column) -> Column:
    """1 for the known address, 0.5 for its domain, 0.2 for any; 0 for none."""
    f, k = F.lower(F.trim(found)), F.lower(F.trim(known))
    both = given(f) & given(k)
    host = lambda e: F.when(F.contains(e, F.lit("@")), F.split_part(e, F.lit("@"), F.lit(2)))
    return F.when(both & (f == k), 1.0).when(both & (host(f) == host(k)), 0.5).when(given(f), 0.2).otherwise(0.0)


def ordered_items(joined: Column) -> Column:
    """The items of a list joined by ; without blanks and repeats, in order."""
    items = F.transform(F.split(joined, ";"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def six_factor(shared: Column, own: Column, theirs: Column, wanted: str | None, department: Column, level: str | None, h: Column, grants: Column, works: Column, email: Column, verified: Column) -> Column:
    """Six factors, 100 points: research 40, department 15, level 15, funding 10, output 10, contact 10."""
    research = F.coalesce(F.try_divide(40.0 * shared, F.least(own, theirs)), F.lit(0.0))
    want, dept = F.lit((wanted or "").lower()), F.lower(department)
    place = F.when((want == "") | ~given(dept), 0.0).when(want == dept, 15.0).when(F.contains(dept, want), 10.5).otherwise(0.0)
    low, high = LEVEL_RANGES.get(level or "", (None, None))
    fit = F.lit(12.0) if low is None else F.when(h.between(low, high), 15.0).when(h < low, 7.5).otherwise(10.5)
    funding = F.when(grants >= 3, 10.0).when(grants >= 1, 7.0).otherwise(3.0)
    output = F.when(works >= 100, 10.0).when(works >= 50, 8.0).when(works >= 20, 6.0).otherwise(4.0)
    contact = F.when(email & verified, 10.0).when(email, 6.0).otherwise(0.0)
    return research + place + fit + funding + output + contact


def experience_fit(level: str, h: Column) -> Column:
    """How well an h-index suits a level, of 15 points."""
    if level == "undergraduate":
        return F.when(h > 120, 6.0).when(h > 80, 10.5).otherwise(15.0)
    if level == "phd":
        return F.when(h >= 40, 15.0).otherwise(9.0)
    if level == "postdoc":
        return F.when(h >= 60, 15.0).otherwise(7.5)
    return F.lit(12.0 if level == "masters" else 7.5)


def quality(total: Column) -> Column:
    return F.when(total >= 75, "excellent").when(total >= 60, "good").when(total >= 45, "moderate").otherwise("weak")


def keyword_stage(shared: Column, domains: Column, techniques: Column) -> Column:
    """The score of the first of three stages: shared keywords, five for each shared domain, three for each technique."""
    return shared + 5 * domains + 3 * techniques


def email_signals(email: Column, first: Column, last: Column) -> Column:
    """How much an address looks like a person's: last name 10, first name 5, either with the other's initial 8, .edu 3."""
    local = F.split_part(email, F.lit("@"), F.lit(1))
    one = F.substring(first, 1, 1)
    return points((F.contains(local, last), 10), (F.contains(local, first), 5), (F.contains(local, F.concat(one, last)), 8), (F.contains(local, F.concat(last, one)), 8), (F.contains(email, F.lit(".edu")), 3))


def best_email(source: Column, first: Column, last: Column) -> Column:
    """The personal address in a text with the highest signals, the first of equals; null where there is none."""
    scored = F.transform(text.emails(source), lambda e, i: F.struct(email_signals(e, first, last).alias("s"), (-i).alias("i"), e.alias("e")))
    return F.array_max(scored)["e"]


def website_flags(found: Column, known: Column, name: Column) -> dict[str, Column]:
    """Whether a found page is the known one, of its domain, or has the last word of the name in its URL; the first is all of them."""
    f, k = text.url_key(F.coalesce(found, F.lit(""))), text.url_key(F.coalesce(known, F.lit("")))
    both, words = (f != "") & (k != ""), F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    last = F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise("")
    exact = both & (f == k)
    return {"website_exact": exact, "website_domain": both & (text.domain(f) == text.domain(k)), "website_name": exact | (both & (last != "") & F.contains(f, last))}


def email_flags(found: Column, known: Column) -> dict[str, Column]:
    """Whether a found address is the known one, or at its host."""
    f, k = F.lower(F.trim(F.coalesce(found, F.lit("")))), F.lower(F.trim(F.coalesce(known, F.lit(""))))
    both, host = (f != "") & (k != ""), lambda e: F.split_part(e, F.lit("@"), F.lit(2))
    return {"email_exact": both & (f == k), "email_domain": both & ((f == k) | (F.contains(f, F.lit("@")) & F.contains(k, F.lit("@")) & (host(f) == host(k))))}


def outcome(exact: Column, domain: Column, found: Column, what: str) -> Column:
    """What is said of one search: exact, domain, found or none."""
    return F.when(exact, f"{what} EXACT").when(domain, f"{what} domain").when(given(found), f"{what} found").otherwise(f"No {what.lower()}")
