"""Ordered rules as one CASE: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Department categories in order, each with the substrings that select it.
CATEGORY_RULES = [
    ("cs", ["computer", "computing", "informatics", "data science"]),
    ("engineering", ["engineer", "mechanical", "aerospace", "aeronautic", "nuclear", "biomedical eng", "biological eng"]),
    ("biology", ["biology", "biological", "biochem", "genetic", "molecular", "microbio", "agricultural"]),
    ("chemistry", ["chemistry", "chemical"]),
    ("physics", ["physics", "astro", "quantum"]),
    ("math", ["math", "statistic"]),
    ("medicine", ["medicine", "medical", "health", "pharma", "nursing", "immuno"]),
    ("neuro", ["neuro", "brain", "cognitive"]),
    ("social", ["social", "politic", "sociology", "anthropo", "linguist", "psycho"]),
    ("economics", ["econom", "finance"]),
    ("materials", ["material"]),
    ("earth", ["earth", "planet", "geo", "ocean", "atmospher"]),
    ("business", ["business", "management", "account"]),
    ("arts", ["art", "music", "theater", "literature", "humanit", "history", "philosoph"]),
    ("env", ["environment", "ecology", "climate", "sustainab"]),
    ("energy", ["energy"]),
]

# Research fields of awards in order, substrings of the upper-case text.
FIELD_RULES = [
    ("Biology & Life Sciences", ["BIO", "BIOLOG", "LIFE"]),
    ("Computer Science & Engineering", ["CISE", "COMPUTER", "CS", "AI "]),
    ("Engineering", ["ENG", "ENGINEER"]),
    ("Earth & Environmental Sciences", ["GEO", "EARTH", "ENVIRON"]),
    ("Mathematics & Physical Sciences", ["MPS", "MATH", "PHYSICS", "CHEM"]),
    ("Social & Behavioral Sciences", ["SBE", "SOCIAL", "ECON", "BEHAV"]),
    ("Education", ["EDU", "EDUCATION"]),
]

# Titles that tell how involved a person is.
INVOLVEMENT_RULES = [("part_time", ["adjunct", "part-time", "part time"]), ("flexible", ["visiting", "emeritus", "lecturer", "instructor"])]

# What shows that a row is no person.
NAME_PREFIXES = (
    "department", "division", "school", "center", "institute", "program", "office", "faculty", "administration", "clinical", "students", "technology", "principal",
    "research", "application", "deadlines", "about", "contact", "news", "events", "curriculum", "admission", "staff", "committee", "board", "council", "library",
    "services", "resources", "the ", "a ", "an ", "affiliated", "emeritus", "visiting",
)
NAME_JUNK = (
    "expand_more", "expand_less", "read more", "learn more", "view all", "load more", "show more", "see all", "click here", "privacy", "more about", "database list",
    "timeline & faq", "policy award", "follow us", "health law", "http", ".edu", ".com", ".org",
)
# The same for rows that come in, where articles are a rule of their own, and headings that are known.
ARTICLES = ("the ", "a ", "an ")
INGEST_JUNK = (
    "expand_more", "expand_less", "read more", "learn more", "view all", "load more", "show more", "see all", "click here", "http://", "https://", ".edu", ".com", ".org",
)
JUNK_HEADINGS = (
    "principal faculty", "principal faculty by research interest", "administration & operations", "clinical & translational research core", "faculty & leadership",
    "students, fellows & scholars", "technology advancement", "liver diseases expand_more", "musculoskeletal diseases expand_more", "nervous system diseases expand_more",
    "skin diseases expand_more",
)


# What a scraped name does not start with or contain.
SCRAPED_PREFIXES = (
    "administration", "clinical", "faculty", "students", "technology", "principal", "research", "application", "deadlines", "program", "department", "office", "center",
    "institute", "about", "contact", "news", "events", "curriculum", "admission",
)
SCRAPED_JUNK = ("expand_more", "expand_less", "read more", "learn more", "view all", "load more", "show more", "see all")
# Schools by the names they go under, and those that are shown.
SCHOOLS = {
    "harvard": "Harvard University", "harvard university": "Harvard University", "harvard medical school": "Harvard University", "broad institute": "Harvard University",
    "broad institute of mit and harvard": "Harvard University", "mit": "MIT", "massachusetts institute of technology": "MIT", "bu": "Boston University",
    "boston university": "Boston University", "northeastern": "Northeastern University", "northeastern university": "Northeastern University", "tufts": "Tufts University",
    "tufts university": "Tufts University", "stanford": "Stanford University", "stanford university": "Stanford University", "yale": "Yale University",
    "yale university": "Yale University", "princeton": "Princeton University", "princeton university": "Princeton University",
}
ENABLED_SCHOOLS = (
    "harvard university", "mit", "boston university", "northeastern university", "tufts university", "stanford university", "yale university", "princeton university",
)
# What tells of a field, and of work at a bench or a computer.
DOMAINS = {
    "life_sciences": ("biology", "biochemistry", "genetics", "genomics", "cell", "molecular", "neuroscience", "immunology", "microbiology", "ecology", "evolution"),
    "physical_sciences": ("physics", "chemistry", "materials", "quantum", "optics", "thermodynamics"),
    "engineering": ("engineering", "robotics", "systems", "design", "optimization", "control"),
    "computer_science": ("computer", "algorithm", "software", "programming", "data", "computing"),
    "social_sciences": ("psychology", "economics", "sociology", "political", "anthropology"),
}
WET_LAB = ("pcr", "western blot", "cell culture", "microscopy", "chromatography", "electrophoresis", "cloning", "transfection", "immunostaining")
DRY_LAB = ("python", "r", "matlab", "machine learning", "data analysis", "statistical analysis", "bioinformatics", "computational modeling")
# What tells of a level, the first that is found.
LEVELS = [("postdoc", ["postdoc", "post-doctoral", "research fellow"]), ("phd", ["phd", "doctoral", "dissertation"]), ("masters", ["master", "ms ", "ma ", "mba"])]
# Categories as they are shown.
CATEGORY_NAMES = {
    "cs": "Computer Science", "engineering": "Engineering", "biology": "Biology & Life Sciences", "chemistry": "Chemistry", "physics": "Physics & Astronomy",
    "math": "Mathematics & Statistics", "medicine": "Medicine & Health", "neuro": "Neuroscience", "social": "Social Sciences", "economics": "Economics & Finance",
    "materials": "Materials Science", "earth": "Earth & Planetary Sciences", "business": "Business & Management", "arts": "Arts & Humanities", "env": "Environmental Science",
    "energy": "Energy",
}


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether text contains one of the parts; null text contains none."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    out = F.when(any_of(text, rules[0][1]), rules[0][0])
    for name, parts in rules[1:]:
        out = out.when(any_of(text, parts), name)
    return out.otherwise(default)


def rules_sql(text: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    """The same decision as ANSI SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"when {' or '.join(f'contains({text}, {quoted(p)})' for p in parts)} then {quoted(name)}" for name, parts in rules)
    return f"case {cases} else {quoted(default)} end"


def category(department: Column) -> Column:
    return first_rule(F.lower(department), CATEGORY_RULES, "default")


def research_field(text: Column) -> Column:
    return first_rule(F.upper(text), FIELD_RULES, "Research")


def involvement(title: Column) -> Column:
    return first_rule(F.lower(title), INVOLVEMENT_RULES, "full_time")


def person_name(name: Column) -> Column:
    """Whether a value can be a person's name: two parts, at most 60 characters, no digit, no institutional prefix, no page furniture."""
    n = F.trim(name)
    low = F.lower(n)
    prefix = F.lit(False)
    for p in NAME_PREFIXES:
        prefix = prefix | low.startswith(p)
    return F.coalesce(F.contains(n, F.lit(" ")) & (F.length(n) <= 60) & ~prefix & ~any_of(low, NAME_JUNK) & ~n.rlike("[0-9]"), F.lit(False))


def count_of(text: Column, parts: Sequence[str]) -> Column:
    """How many of the parts a text contains."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p)))


def level(text: Column) -> Column:
    return first_rule(F.lower(text), LEVELS, "undergraduate")


def lab_kind(text: Column) -> Column:
    """wet or dry where words of one outnumber the other's twice over, mixed where there are any."""
    wet, dry = count_of(F.lower(text), WET_LAB), count_of(F.lower(text), DRY_LAB)
    return F.when(wet > dry * 2, "wet").when(dry > wet * 2, "dry").when((wet > 0) | (dry > 0), "mixed").otherwise("any")


def domains(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(F.lower(text), list(v)), k) for k, v in DOMAINS.items()]))


def scraped_name(name: Column) -> Column:
    """Whether a heading or link of a page can be a name."""
    n = F.trim(name)
    low, prefix = F.lower(n), F.lit(False)
    for p in SCRAPED_PREFIXES:
        prefix = prefix | low.startswith(p)
    return F.coalesce(F.contains(n, F.lit(" ")) & (F.length(n) <= 60) & ~prefix & ~any_of(low, SCRAPED_JUNK), F.lit(False))


def mapped(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def school(name: Column) -> Column:
    """A school by the name it is shown under; any other without spaces around, null as empty."""
    own = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(mapped(F.lower(own), SCHOOLS), own)


def category_name(key: Column) -> Column:
    return mapped(key, CATEGORY_NAMES)


def attribute_filter(df: DataFrame, wanted: dict) -> DataFrame:
    """The rows that meet all that is wanted of: min_h_index, max_h_index, has_email, has_website, has_funding, department, research_field."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    within = lambda c, x: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(x.lower()))
    h = F.coalesce("h_index", F.lit(0))
    rules_ = {
        "min_h_index": lambda x: h >= x, "max_h_index": lambda x: h <= x, "has_email": lambda x: ~blank("email") if x else F.lit(True), "has_website": lambda x: ~blank("website") if x else F.lit(True),
        "has_funding": lambda x: F.coalesce("grants", F.lit(0)) > 0 if x else F.lit(True), "department": lambda x: within("department", x), "research_field": lambda x: within("topics", x) | within("areas", x),
    }
    for name, value in wanted.items():
        if value is not None and value != "":
            df = df.where(rules_[name](value))
    return df


def reject_reason(name: Column) -> Column:
    """Why a name is not admitted, by the first rule that fails; null for admitted names.

    A name in capitals is a heading, unless it is initials with dots and one word.
    """
    n = F.trim(name)
    low, letters = F.lower(n), F.regexp_replace(n, r"\P{L}", "")
    prefix = F.coalesce(*[F.when(low.startswith(p), p) for p in NAME_PREFIXES if p not in ARTICLES])
    junk = F.coalesce(*[F.when(F.contains(low, F.lit(p)), p) for p in INGEST_JUNK])
    capitals = (letters != "") & (letters == F.upper(letters)) & (letters != F.lower(letters)) & ~n.rlike(r"^([A-Z]\.\s*)+[A-Z][A-Z'\-]*$")
    article = low.startswith(ARTICLES[0]) | low.startswith(ARTICLES[1]) | low.startswith(ARTICLES[2])
    return (
        F.when(n.isNull() | (n == ""), "empty name").when(~F.contains(n, F.lit(" ")), "single word (no space)").when(F.length(n) > 60, "longer than 60 characters")
        .when(prefix.isNotNull(), F.concat(F.lit('starts with "'), prefix, F.lit('"'))).when(article, 'starts with article "The "/"A "/"An "')
        .when(low.isin(*JUNK_HEADINGS), "known junk phrase").when(junk.isNotNull(), F.concat(F.lit('contains junk substring "'), junk, F.lit('"')))
        .when(n.rlike("[0-9]"), "contains digits").when(capitals, "all uppercase (non-person heading)")
    )


def confidence(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score > 0, "low").otherwise("none")


def status(website: Column, email: Column) -> Column:
    both = website.isNotNull() & email.isNotNull()
    return F.when(both, "complete").when(website.isNotNull() | email.isNotNull(), "partial").otherwise("needs_review")
