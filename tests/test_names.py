"""Names, ids and diversity against plain loops."""

import difflib
import random
import re
import unicodedata

import pytest

from talus.functions import text
from talus.operators import matcher, names, rank
from talus.plans import catalog, joins, matching, older, people, scores  # noqa: F401

DIR = "/root/testdata/sf0.001"


def tables(spark):
    return lambda name: spark.read.parquet(f"{DIR}/{name}.parquet")


def plain(name):
    n = name.lower().strip()
    for t in text.TITLES:
        n = re.sub(rf"\b{t}\.?\b", "", n)
    return " ".join(re.sub(r"[^\w\s-]", " ", n).split())


def variations(name):
    w = plain(name).split()
    if not w:
        return []
    first, last, middle = w[0], w[-1], " ".join(w[1:-1])
    out = [" ".join(w), f"{first} {last}", f"{last} {first}", f"{first[0]} {last}", first[0] + last, last, first]
    if middle:
        out += [f"{first} {middle} {last}", f"{first} {middle[0]} {last}", f"{first[0]} {middle[0]} {last}"]
    if "-" in last:
        out += [last.split("-")[0], last.split("-")[-1]]
    return [v.strip() for v in out if v.strip()]


def alike(a, b):
    if a == b:
        return 1.0
    return 0.9 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


def look_up(name, listed, best):
    """listed: names by ordinal."""
    first = {}
    for k, n in listed:
        first.setdefault(n, k)
    for v in variations(name):
        if v in first:
            return first[v]
    key, found = plain(name), None
    if not key:
        return None
    for k, n in listed:
        if plain(n):
            r = alike(key, plain(n))
            if r >= 0.85 and (found is None or (best and r > found[1])):
                found = (k, r)
    return found and found[0]


@pytest.mark.parametrize("query, best", [("J6_fuzzy_names", True), ("J7_first_alike", False)])
def test_look_up_equals_a_loop(spark, query, best):
    t = tables(spark)
    asked = [(r.id, r.name) for r in people.people(t).collect() if r.name is not None]
    listed = sorted((r.ordinal, r.name) for r in joins.listed(t).collect() if r.name is not None)
    want = {i: k for i, n in asked if (k := look_up(n, listed, best)) is not None}
    if best:
        assert {r.id: r.ordinal for r in catalog.QUERIES[query](spark, DIR).collect()} == want
    else:
        assert {r.id: r.website for r in catalog.QUERIES[query](spark, DIR).collect()} == {i: f"https://site.org/{k}" for i, k in want.items()}
    assert len(set(want.values())) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_no_alike_pair_is_lost(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])))
    keys = [" ".join(word() for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(120)] + ["smith", "jane elizabeth smith", "", "a", "ab"]
    for _ in range(120):
        k = list(r.choice(keys))
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randrange(len(k) + 1)
            k[at : at + r.choice([0, 1])] = r.choice(["", "a", "b", " "])
        keys.append("".join(k).strip())
    a, b = keys[::2], keys[1::2]
    got = {(o.id, o.ordinal): o.ratio for o in names.like_names(spark.createDataFrame(list(enumerate(a)), "id long, key string"), spark.createDataFrame(list(enumerate(b)), "ordinal long, key string")).collect()}
    want = {(i, j): alike(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and alike(x, y) >= 0.85}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def bare(s):
    return re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).strip().lower())


def first_names_match(x, y):
    a, b = ((bare(re.sub(r"^Dr\.?\s+", "", n.strip())).split() or [""])[0] for n in (x, y))
    if not a or not b:
        return False
    c, d = a.rstrip("."), b.rstrip(".")
    return a == b or (len(c) == 1 and d.startswith(c)) or (len(d) == 1 and c.startswith(d)) or difflib.SequenceMatcher(None, a, b).ratio() >= 0.8


def test_first_match_equals_a_loop(spark):
    t = tables(spark)
    listed = sorted((r.ordinal, r.name, r.department) for r in joins.listed(t).collect() if r.name)
    want = {}
    for p in people.people(t).collect():
        if p.department in (None, "Various") and (p.name or "").strip():
            last = bare(p.name).split()[-1]
            hit = next((d for _, n, d in listed if n.strip() and bare(n).split()[-1] == last and first_names_match(p.name, n)), None)
            if hit is not None:
                want[p.id] = hit
    assert {r.id: r.found for r in catalog.QUERIES["J5_first_match"](spark, DIR).collect()} == want and want


def test_unique_ids_equal_a_loop(spark):
    got = sorted((r.ordinal, r.base, r.id) for r in catalog.QUERIES["D8_unique_ids"](spark, DIR).collect())
    seen, want = set(), []
    for k, b, _ in got:
        one, i = b, 2
        while one in seen:
            one, i = f"{b}-{i}", i + 1
        seen.add(one)
        want.append((k, b, one))
    assert got == want and len(seen) == len(got)
    assert any(re.search(r"-2-\d+$", i) for _, _, i in got)


def mmr(rows, k, weight, alike_):
    """rows: (score, place, id, value), the best first."""
    pool, out = sorted(rows, key=lambda r: (-r[0], r[1], r[2])), []
    if len(pool) <= k:
        return [r[2] for r in pool]
    while pool and len(out) < k:
        value = lambda r: round(weight * r[0] / 100 - (1 - weight) * max((max(0.0, alike_(r[3], s[3])) for s in out), default=0.0), 12)
        best = max(pool, key=value)
        out.append(best)
        pool.remove(best)
    return [r[2] for r in out]


def test_diverse_matches_equal_a_loop(spark):
    t = tables(spark)
    got = {}
    for r in catalog.QUERIES["M12_diverse"](spark, DIR).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    who = matching.matched(t)
    terms = {}
    for r in matcher.term_weights(who.selectExpr("id", "concat_ws(' ', text, topics_text) as text")).collect():
        terms.setdefault(r.id, set()).add(r.term)
    jaccard = lambda a, b: len(a & b) / (len(a | b) or 1)
    pool = {}
    for r in matcher.best(matching._match(t), 100).collect():
        pool.setdefault(r.query_id, []).append((r.score, r.rank, r.id, terms.get(r.id, set())))
    assert got == {q: mmr(rows, 20, 0.75, jaccard) for q, rows in pool.items()}
    assert any(len(rows) > 20 for rows in pool.values())


def test_vector_diversity_equals_a_loop(spark):
    r = random.Random(3)
    rows = [(q, i, float(r.randint(0, 100)), [r.gauss(0, 1) for _ in range(4)]) for q in (1, 2) for i in range(30 if q == 1 else 4)]
    got = {}
    for o in rank.mmr(spark.createDataFrame(rows, "query_id long, id long, score double, vector array<double>"), 8).orderBy("query_id", "rank").collect():
        got.setdefault(o.query_id, []).append(o.id)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    assert got == {q: mmr([(s, 0, i, v) for p, i, s, v in rows if p == q], 8, 0.75, cosine) for q in (1, 2)}


def test_first_words_equal_a_loop(spark):
    t = tables(spark)
    word = lambda n: (bare(re.sub(r"^Dr\.?\s+", "", n.strip())).split() or [""])[0]
    a = {word(r.name) for r in people.people(t).collect() if r.name is not None}
    b = {word(n) for n in ["Jane", "J.", "Josè", "Anne-Marie", "Al", "Lee", "Robert", "Bobby"]}
    got = {(r.a, r.b) for r in catalog.QUERIES["T6_first_names"](spark, DIR).collect()}
    assert got == {(x, y) for x in a for y in b if first_names_match(x, y)} and len(got) > 5


def test_spelling_of_addresses_equals_a_loop(spark):
    from talus.functions import web

    offers = scores._offers_of(tables(spark))
    rows = offers.select("name", "email", web.email_name_score(offers["email"], offers["name"], fuzzy=False).alias("a"), web.email_name_score(offers["email"], offers["name"]).alias("b")).distinct().collect()
    for r in rows:
        w = plain(r.name).split() or [""]
        bonus = 0.1 if alike(r.email.split("@")[0], w[0] + w[-1]) > 0.7 and w[0] else 0.0
        assert abs(min(1.0, r.a + bonus) - r.b) < 1e-9, (r, bonus)
    assert any(r.a != r.b for r in rows)


def test_directory_entries_equal_a_loop(spark):
    want = {}
    for r in sorted(people.people(tables(spark)).collect(), key=lambda r: (r.id % 9, r.id)):
        email = (r.email or "").strip().lower()
        words = f"{r.name or ''} Office {r.id}".split()[:6]
        if email:
            want[" ".join(words).lower()] = (" ".join(words), email, f"https://site.org/{r.id}")
    got = {r.name.lower(): (r.name, r.email, r.website) for r in catalog.QUERIES["V37_directory"](spark, DIR).collect()}
    assert got == want


def test_page_addresses_equal_a_loop(spark):
    from talus.functions import web

    want = set()
    for r in people.people(tables(spark)).collect():
        site = f"https://www.alpha.edu/people/{r.id}"
        email = (r.email or "").strip().lower()
        if email:
            want.add((r.id, "mailto", email))
        want |= {(r.id, "obfuscated", "jane@beta.org"), (r.id, "regex", "lab@alpha.edu")}
        pages = ["https://www.alpha.edu/contact-me", f"https://www.alpha.edu/bio/{r.id}", f"{site}/contact", "https://www.alpha.edu/contact", f"{site}?tab=contact"]
        want |= {(r.id, "contact", p) for p in pages[: web.MOST_CONTACT_PAGES]}
    assert {(r.id, r.kind, r.value) for r in catalog.QUERIES["T16_page_addresses"](spark, DIR).collect()} == want


def test_likeness_equals_a_loop(spark):
    for r in catalog.QUERIES["T5_likeness"](spark, DIR).collect():
        assert abs(r.ratio - (alike(r.a, r.b) if r.a else 0.0)) < 1e-12


@pytest.mark.parametrize("k", [3, 10, 36])
def test_phrases_equal_a_loop(spark, k):
    rows = sorted((r.id, r.techniques or "", r.areas or "") for r in people.people(tables(spark)).collect())
    raw = {}
    for _, techniques, areas in rows:
        for source in (techniques, areas):
            if source is techniques or len(raw) < 2 * k:
                for part in re.split("[,;]", source):
                    if 4 <= len(part.strip()) <= 120:
                        raw[part.strip()] = raw.get(part.strip(), 0) + 1
    want = [p for p, _ in sorted(raw.items(), key=lambda x: (-x[1], x[0].lower(), x[0]))[:k]]
    split = lambda c: f"filter(transform(split(coalesce({c}, ''), '[,;]'), x -> trim(x)), x -> x <> '')"
    df = people.people(tables(spark)).selectExpr("id", f"{split('techniques')} as first", f"{split('areas')} as second")
    assert [r.phrase for r in rank.top_phrases(df, k).orderBy("rank").collect()] == want
