"""Scalar transforms of names, URLs, emails and locations."""

from __future__ import annotations

import difflib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Fixed values.
NAME_SUFFIXES = ["jr", "sr", "md", "phd", "ii", "iii", "iv"]
TITLES = ("dr", "prof", "professor", "mr", "mrs", "ms", "phd", "md", "jr", "sr", "iii", "ii", "iv")
GENERIC_LOCALS = (
    "info", "contact", "admin", "office", "support", "help", "webmaster", "department", "dept", "program", "general", "inquiry", "team", "staff", "hr",
    "communications", "admissions", "registrar",
)
GENERIC_ADDRESSES = (
    "info", "contact", "admin", "office", "department", "dept", "general", "inquiries", "support", "help", "webmaster", "web", "communications", "media", "press",
    "news", "events", "editor", "subscribe", "noreply", "hr", "careers", "admissions", "registrar", "alumni", "development", "giving", "contedu", "programs?",
    "courses?", "steppingstrong", "statistics", "math", "chemistry", "physics", "biology", "economics", "psychology", "sociology", "ogephd", "dms", "hms", "lab",
    "research", "faculty", "staff", "graduate", "undergraduate",
)
STATES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne",
    "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc", "pr", "vi",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


@F.arrow_udf(StringType())
def ascii_fold(text: pa.Array) -> pa.Array:
    """NFKD without what is not ASCII."""
    return pa.array([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in text.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def seq_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """1 for equal names, 0.9 where one contains the other, else the matching-blocks ratio; 0 for empty or null."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if not x or not y:
            out.append(0.0)
        elif x == y:
            out.append(1.0)
        else:
            out.append(0.9 if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio())
    return pa.array(out, pa.float64())


def dedupe_name(folded: Column) -> Column:
    """The key two spellings of a name share: lower case, no punctuation, no suffixes. Takes an ASCII-folded name."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), "[.,]", " "), "\\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*NAME_SUFFIXES)), " ")


def plain_name(name: Column) -> Column:
    """Lower case without titles; other punctuation than hyphens is a space."""
    out = F.regexp_replace(F.lower(F.trim(name)), rf"(?U)\b(?:{'|'.join(TITLES)})\b\.?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s-]", " "), r"(?U)\s+", " "))


def name_words(name: Column) -> Column:
    return F.filter(F.split(plain_name(name), " "), lambda w: w != "")


def name_part(name: Column, last: bool) -> Column:
    """The first or last word of a name without titles; empty for a name without words. One word is both."""
    return F.coalesce(F.try_element_at(name_words(name), F.lit(-1 if last else 1)), F.lit(""))


def name_variations(name: Column) -> Column:
    """Spellings of a name in the order they are tried: seven, three more with a middle name, two more with a hyphen in the last."""
    w, first, last = name_words(name), name_part(name, False), name_part(name, True)
    middle = F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), " ")
    one, mid = F.left(first, F.lit(1)), F.left(middle, F.lit(1))
    j = lambda *p: F.trim(F.concat_ws(" ", *p))
    base = F.array(plain_name(name), j(first, last), j(last, first), j(one, last), F.concat(one, last), last, first)
    more = F.when(middle != "", F.array(j(first, middle, last), j(first, mid, last), j(one, mid, last)))
    parts = F.when(F.contains(last, F.lit("-")), F.array(F.substring_index(last, "-", 1), F.substring_index(last, "-", -1)))
    none = F.array().cast("array<string>")
    return F.filter(F.concat(base, F.coalesce(more, none), F.coalesce(parts, none)), lambda v: v != "")


def url_key(url: Column) -> Column:
    """Lower case, without scheme, any www. and closing slashes."""
    u = F.replace(F.replace(F.replace(F.lower(F.trim(url)), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("www."), F.lit(""))
    return F.regexp_replace(u, "/+$", "")


def domain(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), "^(?:[a-z]+://)?([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), "^(?:[a-z]+://)?[^/?#]*([^?#]*)", 1)


def slug(text: Column, mark: str = "-") -> Column:
    """Lower-case ASCII letters and digits of a text, accents folded, with one mark for each run of anything else; unknown if there are none."""
    out = F.regexp_replace(F.regexp_replace(ascii_fold(F.lower(F.trim(text))), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "unknown").otherwise(out)


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first: a letter after an apostrophe or a hyphen is one as well."""
    marked = F.split(F.regexp_replace(F.lower(text), r"(?<!\p{L})(?=\p{L})", "\u0001"), "\u0001")
    return F.array_join(F.transform(marked, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), p.substr(F.lit(2), F.length(p)))), "")


def location(text: Column) -> Column:
    """City, ST: parts with capitals first, and the last of several parts in capitals if it is a state or that short.

    Of two parts that takes two letters, of more at most two. A single part changes if it is in capitals and over two letters.
    """
    t = F.trim(text)
    p = F.transform(F.split(t, ","), lambda x: F.trim(x))
    n, last = F.size(p), F.element_at(p, -1)
    short = F.lower(last).isin(*STATES) | F.when(n == 2, F.length(last) == 2).otherwise(F.length(last) <= 2)
    head = F.transform(F.slice(p, 1, F.greatest(n - 1, F.lit(1))), title_case)
    several = F.array_join(F.concat(head, F.array(F.when(short, F.upper(last)).otherwise(title_case(last)))), ", ")
    one = F.when((t == F.upper(t)) & (F.length(t) > 2), title_case(t)).otherwise(t)
    return F.when(F.coalesce(t, F.lit("")) == "", text).when(n == 1, one).otherwise(several)


def generic_address(email: Column) -> Column:
    """Whether an address is an office's, by its whole local part."""
    return F.coalesce(F.lower(email).rlike(f"^(?:{'|'.join(GENERIC_ADDRESSES)})@"), F.lit(False))


def emails(text: Column) -> Column:
    """Personal addresses in a text, in order: generic local parts are left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(EMAIL), F.lit(0))

    def own(e: Column) -> Column:
        local, keep = F.substring_index(e, "@", 1), F.lit(True)
        for g in GENERIC_LOCALS:
            keep = keep & ~local.startswith(g)
        return keep

    return F.filter(found, own)


def any_email(text: Column) -> Column:
    """The first personal address of a text that has .edu in it, else the first; null for none."""
    found = emails(text)
    return F.coalesce(F.get(F.filter(found, lambda e: F.contains(e, F.lit(".edu"))), F.lit(0)), F.get(found, F.lit(0)))


def instant(text: Column) -> Column:
    """The time that an ISO 8601 text names, in UTC where it names no zone; null for anything else."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def tokens(text: Column, least: int = 3) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for empty, unequal or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
