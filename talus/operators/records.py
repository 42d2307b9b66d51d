"""Records between layouts: the nested one, the flat ones that are matched and shown, and what pipelines and author lists give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import rules, text
from talus.sources.tables import whole_number

C, L = F.col, F.lit

#: Places of schools whose own rows name none.
PLACES = {
    "Harvard University": "Cambridge, MA", "Massachusetts Institute of Technology": "Cambridge, MA", "Tufts University": "Medford, MA", "Boston University": "Boston, MA",
    "Northeastern University": "Boston, MA", "Stanford University": "Stanford, CA", "Yale University": "New Haven, CT", "Princeton University": "Princeton, NJ",
}
#: An author counts from one of these on, and with at most so many institutions.
LEAST_H, LEAST_WORKS, MOST_INSTITUTIONS = 10, 30, 15
SMALL_WORDS = ("and", "of", "the", "in", "for", "on", "at", "to", "a", "an")


def none() -> Column:
    return F.array().cast("array<string>")


def text_or(c: Column, other: str = "") -> Column:
    return F.coalesce(c, L(other))


def filled(*columns: Column) -> Column:
    """The first of some texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, L("")) for c in columns])


def trimmed(items: Column) -> Column:
    """A list's items without spaces around, without empty ones."""
    return F.filter(F.transform(F.coalesce(items, none()), lambda x: F.trim(x)), lambda x: F.coalesce(x, L("")) != "")


def split_list(value: Column) -> Column:
    """A text as a list, by semicolons if it has one, else by commas."""
    own = text_or(value)
    return trimmed(F.when(F.contains(own, L(";")), F.split(own, ";")).otherwise(F.split(own, ",")))


def joined_areas(items: Column) -> Column:
    """A list of research areas as one text: no very long ones, no titles of joint grants, ten at most."""
    return F.array_join(F.slice(F.filter(trimmed(items), lambda s: (F.length(s) < 200) & ~s.startswith("Collaborative Research:")), 1, 10), "; ")


def flat_for_matching(v2: DataFrame) -> DataFrame:
    """The nested layout as the matcher takes it; a missing h-index counts as 0, an address is verified where its confidence is HIGH."""
    quality = F.when(C("contact.email_confidence") == "HIGH", "verified").otherwise("uncertain")
    return v2.select(
        text_or(C("id")).alias("id"), text_or(C("name")).alias("name"), text_or(C("affiliation.school")).alias("school"), text_or(C("affiliation.department")).alias("department"),
        text_or(C("affiliation.title")).alias("title"), text_or(C("contact.email")).alias("email"), quality.alias("email_quality"), text_or(C("contact.website")).alias("website"),
        F.coalesce("metrics.h_index", L(0)).alias("h_index"), text_or(C("research.areas")).alias("research_areas"), F.coalesce("research.topics", none()).alias("research_topics"),
        F.coalesce("research.techniques", none()).alias("lab_techniques"), F.coalesce("funding.nsf_grants_count", L(0)).alias("nsf_awards"),
    )


def flat_for_browsing(v2: DataFrame) -> DataFrame:
    """The nested layout as it is shown: five topics, techniques as one text, places in their usual form."""
    place = lambda c: F.when(text_or(c) == "", "").otherwise(text.location(c))
    return v2.select(
        text_or(C("id")).alias("id"), text_or(C("name")).alias("name"), text_or(C("affiliation.school")).alias("school"), place(C("affiliation.location")).alias("location"),
        place(filled(C("affiliation.specific_location"), C("affiliation.location"))).alias("specific_location"), C("metrics.h_index").alias("h_index"),
        F.slice(F.coalesce("research.topics", none()), 1, 5).alias("research_topics"), F.array_join(F.coalesce("research.techniques", none()), ", ").alias("lab_techniques"),
    )


def flat_from_old(old: DataFrame) -> DataFrame:
    """Older rows (id, name, school, institution, email list, areas list, techniques, topics, department, location) as they are shown."""
    areas = F.array_join(F.slice(F.coalesce("areas", none()), 1, 5), ", ")
    return old.select(
        F.coalesce("id", "name").alias("id"), text_or(C("name")).alias("name"), rules.school(F.coalesce("school", "institution")).alias("school"), F.trim(text_or(C("department"))).alias("department"),
        F.when(text_or(C("location")) == "", "").otherwise(text.location(C("location"))).alias("location"), text_or(F.get("email", L(0))).alias("email"),
        F.when(areas != "", areas).otherwise(F.array_join(F.slice(F.coalesce("topics", none()), 1, 5), ", ")).alias("research_areas"),
        F.array_join(trimmed(F.split(text_or(C("techniques")), ",")), ", ").alias("lab_techniques"),
    )


def number(c: Column) -> Column:
    """A whole number of a text; 0 counts as none."""
    return F.nullif(whole_number(c), L(0))


def to_v2(rows: DataFrame, source: str) -> DataFrame:
    """Rows of any layout in the nested one; h-index from the scholar's page, else the row's own, else the author list's."""
    own, scholar, listed = number(C("h_index")), number(C("h_index_scholar")), number(C("h_index_openalex"))
    school, department = rules.school(filled(C("school"), C("institution"))), F.trim(text_or(C("department")))
    department = F.when(department == "Various", "").otherwise(department)
    email = F.trim(text_or(C("email")))
    made = F.concat(F.replace(F.lower(school), L(" "), L("-")), L("-"), F.replace(F.replace(F.lower(F.coalesce(F.nullif("name", L("")), L("unknown"))), L(" "), L("-")), L("."), L("")))
    page = F.when((text_or(C("scholar_id")) != "") & (text_or(C("scholar_url")) == ""), F.concat(L("https://scholar.google.com/citations?user="), "scholar_id")).otherwise(text_or(C("scholar_url")))
    topics = F.when(F.size(split_list(C("topics"))) > 0, split_list(C("topics"))).otherwise(split_list(C("areas")))
    sources = F.array_compact(F.array(L(source), F.when(C("listed"), "openalex"), F.when((text_or(C("scholar_id")) != "") | (text_or(C("scholar_url")) != ""), "google_scholar"), F.when(C("grants") > 0, "nsf")))
    return rows.select(
        L("2.0").alias("schema_version"), F.coalesce(F.nullif("id", L("")), made).alias("id"), F.trim(text_or(C("name"))).alias("name"),
        F.struct(school.alias("school"), department.alias("department"), rules.category(department).alias("department_category"), F.trim(text_or(C("title"))).alias("title"), F.trim(text_or(C("location"))).alias("location"), F.trim(text_or(filled(C("specific_location"), C("location")))).alias("specific_location")).alias("affiliation"),
        F.struct(email.alias("email"), F.coalesce(F.nullif("email_confidence", L("")), F.when(F.contains(email, L("@")), "HIGH")).alias("email_confidence"), F.trim(text_or(filled(C("website"), C("profile_url")))).alias("website"), text_or(C("scholar_id")).alias("google_scholar_id"), page.alias("google_scholar_url")).alias("contact"),
        F.struct(F.coalesce(scholar, own, listed).alias("h_index"), F.when(scholar.isNotNull(), "google_scholar").when(own.isNotNull(), F.coalesce(F.nullif("h_index_source", L("")), L("openalex"))).when(listed.isNotNull(), "openalex").alias("h_index_source")).alias("metrics"),
        F.struct(F.trim(text_or(C("areas"))).alias("areas"), F.slice(topics, 1, 20).alias("topics"), trimmed(F.split(text_or(C("techniques")), ",")).alias("techniques")).alias("research"),
        F.struct(F.coalesce("grants", L(0)).alias("nsf_grants_count")).alias("funding"),
        F.struct(F.when(email != "", "HIGH").otherwise("MEDIUM").alias("confidence"), sources.alias("sources")).alias("data_quality"),
    )


def upper_confidence(c: Column) -> Column:
    return F.upper(F.trim(text_or(c)))


def from_master(rows: DataFrame) -> DataFrame:
    """Rows of the master table (name, university, website, email, status, their confidences) in the nested layout, without ids."""
    place = text_or(rules.mapped(F.trim(text_or(C("university"))), PLACES))
    site, mail = upper_confidence(C("website_confidence")), upper_confidence(C("email_confidence"))
    return rows.select(
        "ordinal", F.trim(text_or(C("name"))).alias("name"), F.struct(F.trim(text_or(C("university"))).alias("school"), place.alias("location")).alias("affiliation"),
        F.struct(F.trim(text_or(C("email"))).alias("email"), F.nullif(mail, L("")).alias("email_confidence"), F.nullif(site, L("")).alias("website_confidence")).alias("contact"),
        F.struct(F.lower(F.trim(text_or(C("status")))).alias("status"), filled(site, mail, L("UNKNOWN")).alias("confidence")).alias("data_quality"),
    )


def merged(first: Column, n: int, second: Column, m: int) -> Column:
    """The first n of one list and of the first m of another those that are not among them."""
    return F.filter(F.concat(F.slice(first, 1, n), F.array_except(F.slice(second, 1, m), F.slice(first, 1, n))), lambda x: F.coalesce(x, L("")) != "")


def for_website(rows: DataFrame, prefix: str, school: str, place: str, *keep: str) -> DataFrame:
    """What the pipeline gives (name, author_id, topics, keywords, concepts, fields, h_index, summary) as the website takes it, after the columns to keep."""
    areas = F.array_join(F.slice(merged(C("topics"), 10, C("keywords"), 5), 1, 5), ", ")
    techniques = F.array_join(F.slice(merged(F.array_distinct(C("concepts")), 10, F.array_distinct(C("keywords")), 10), 1, 10), ", ")
    own = F.when(text_or(C("author_id")) != "", F.substring_index("author_id", "/", -1)).otherwise(F.left(F.replace(F.replace(F.lower("name"), L(" "), L("-")), L("."), L("")), L(30)))
    return rows.select(
        *keep, F.concat(L(f"{prefix}-"), own).alias("id"), "name", F.coalesce(F.get("fields", L(0)), L("Various")).alias("department"), L(school).alias("school"), L(place).alias("location"),
        F.coalesce(filled(F.coalesce("summary", areas), areas), L("Research information not available")).alias("research_areas"),
        F.coalesce(F.nullif(techniques, L("")), L("Not specified")).alias("lab_techniques"), F.when(F.coalesce("h_index", L(0)) == 0, "0").otherwise(C("h_index").cast("string")).alias("h_index"),
    )


def department_name(name: Column) -> Column:
    """A department's name with capitals: words in lower case get one, small words after the first lose theirs; a known cut-off name is mended."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    one = lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).when((w == F.lower(w)) & (F.lower(w) != F.upper(w)), F.concat(F.upper(F.left(w, L(1))), w.substr(L(2), F.length(w)))).otherwise(w)
    return F.when(text_or(name) == "", "Various").when(F.lower(F.trim(name)).isin("and optics", "optics"), "Physics and Astronomy").otherwise(F.array_join(F.transform(words, one), " "))


def good_authors(authors: DataFrame, school: str) -> DataFrame:
    """Authors (institutions, h_index, works) of some weight whose first institution has a word of the school's name and who have not too many."""
    first = F.lower(text_or(F.get("institutions", L(0))))
    named = F.exists(F.array(*[L(w) for w in school.lower().split()]), lambda w: F.contains(first, w))
    strong = (F.coalesce("h_index", L(0)) >= LEAST_H) | (F.coalesce("works", L(0)) >= LEAST_WORKS)
    return authors.where((F.size(F.coalesce("institutions", none())) > 0) & named & (F.size("institutions") <= MOST_INSTITUTIONS) & strong)


def author_entity(authors: DataFrame) -> DataFrame:
    """Authors (id, topics [name, field, subfield], concepts [name, level]) as entities: department, areas, keywords, techniques."""
    named = lambda a, f: F.filter(F.transform(F.slice(C(a), 1, 15), lambda x: x[f]), lambda x: F.coalesce(x, L("")) != "")
    names, fields, parts = named("topics", "name"), F.array_distinct(named("topics", "field")), F.array_distinct(named("topics", "subfield"))
    concepts = F.filter(F.transform(F.slice("concepts", 1, 10), lambda x: x["name"]), lambda x: F.coalesce(x, L("")) != "")
    keywords = F.when(F.size(names) > 0, F.slice(names, 1, 15)).otherwise(F.slice(concepts, 1, 15))
    department = department_name(F.coalesce(F.get(fields, L(0)), F.get(concepts, L(0)), L("Various")))
    areas = F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, 5), "; ")).when(F.size(fields) > 0, F.array_join(F.slice(fields, 1, 3), ", ")).otherwise("Research information not available")
    techniques = F.slice(F.array_distinct(F.concat(F.slice(parts, 1, 5), concepts, keywords)), 1, 10)
    return authors.select("id", department.alias("department"), areas.alias("research_areas"), F.array_join(keywords, "|").alias("keywords"), F.coalesce(F.nullif(F.array_join(techniques, ", "), L("")), L("Not specified")).alias("lab_techniques"))


def research_profile(authors: DataFrame) -> DataFrame:
    """(id, topics, fields, keywords): fifteen topics with scores, the five top-level concepts, and keywords from topics, else from other concepts."""
    real = lambda a: F.filter(a, lambda x: F.coalesce(x["name"], L("")) != "")
    topics, concepts = real(F.slice("topics", 1, 15)), real(F.slice("concepts", 1, 10))
    fields = F.slice(F.transform(F.filter("concepts", lambda x: x["level"] == 0), lambda x: text_or(x["name"])), 1, 5)
    low = F.slice(F.transform(F.filter(concepts, lambda x: x["level"] >= 1), lambda x: x["name"]), 1, 15)
    return authors.select("id", F.transform(topics, lambda x: F.concat_ws(":", x["name"], F.bround(x["score"], 3).cast("string"))).alias("topics"), fields.alias("fields"), F.when(F.size(topics) > 0, F.transform(topics, lambda x: x["name"])).otherwise(low).alias("keywords"))


def snippet(areas: Column, topics: Column) -> Column:
    """What is shown of somebody's research: areas, else four topics, else a dash; cut to 160 characters."""
    own = F.when(F.trim(text_or(areas)) != "", F.trim(areas)).when(F.size(F.coalesce(topics, none())) > 0, F.array_join(F.slice(topics, 1, 4), ", ")).otherwise("—")
    return F.when(F.length(own) > 160, F.concat(F.left(own, L(157)), L("…"))).otherwise(own)


def json_array(said: Column) -> Column:
    """The JSON array in a text, from its first bracket to its last; null where that is no JSON."""
    found = F.nullif(F.regexp_extract(said, r"(?s)\[.*\]", 0), L(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)
