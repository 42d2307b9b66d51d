"""Web pages as tables of their elements and texts, so that rules about what stands where are joins and column expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.sources.scratch import stash

C, L = F.col, F.lit
TEXT = "#text"
# Elements without an end, and for elements that end by themselves the ones that end them and the ones that hold those.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDED_BY = {"p": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody tfoot", "td": "td th tr tbody tfoot", "th": "td th tr tbody tfoot", "option": "option optgroup", "thead": "tbody tfoot", "tbody": "tbody tfoot"}
ENDED_BY = {k: frozenset(v.split()) for k, v in ENDED_BY.items()}
HELD_BY = frozenset("ul ol dl table select html body".split())
SILENT = frozenset(("script", "style", "template", "noscript"))
#: Nodes that a batch sent back to Spark holds, about.
AT_ONCE = 20_000

_PLACE = [T.StructField("node", T.IntegerType()), T.StructField("tag", T.StringType())]
_NODE = [*_PLACE, *[T.StructField(c, T.StringType()) for c in ("class", "href", "text")], T.StructField("path", T.ArrayType(T.StructType(_PLACE)))]


class _Walk(HTMLParser):
    """Collects (node, tag, class, href, text, path); path: the elements that a node stands in, from the outermost."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def _add(self, tag, attrs=(), text=None):
        a = dict(attrs)
        self.out.append((len(self.out), tag, a.get("class"), a.get("href"), text, tuple(self.open)))

    def _close(self, at: int) -> None:
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        for at in range(len(self.open) - 1, -1, -1):
            above = self.open[at][1]
            if tag in ENDED_BY.get(above, ()):
                self._close(at)
            elif above in HELD_BY or above not in ENDED_BY and above in ("div", "article", "section", "td", "th"):
                break
        self._add(tag, attrs)
        if tag not in VOID:
            self.open.append((len(self.out) - 1, tag))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][1] == tag:
                return self._close(at)

    def handle_data(self, data):
        if data.strip() and not any(t in SILENT for _, t in self.open):
            self._add(TEXT, text=" ".join(data.split()))


def walked(source: str) -> list[tuple]:
    w = _Walk()
    w.feed(source)
    w.close()
    return w.out


def nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each element and text of pages (id, html): node (its place in the page), tag (#text for a text), class, href, text, path.

    path lists the elements that it stands in, from the outermost. Texts of scripts and styles are left out, white space is one
    space, references are decoded. Null and empty pages have no rows; a page without markup is one text.
    """
    id_ = pages.schema["id"]

    def go(batches):
        out = []
        for batch in batches:
            for i, source in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                out += [(i, *n) for n in walked(source or "")]
                if len(out) >= AT_ONCE:
                    yield rows(out)
                    out = []
        yield rows(out)

    kinds = pa.list_(pa.struct([("node", pa.int32()), ("tag", pa.string())]))

    def rows(out):
        col = lambda k: [r[k] for r in out]
        paths = pa.array([[{"node": n, "tag": t} for n, t in r[6]] for r in out], kinds)
        id_type = pa.int64() if isinstance(id_.dataType, T.LongType) else pa.int32() if isinstance(id_.dataType, T.IntegerType) else pa.string()
        return pa.record_batch([pa.array(col(0), id_type), pa.array(col(1), pa.int32()), *[pa.array(col(k), pa.string()) for k in (2, 3, 4, 5)], paths], names=["id", "node", "tag", "class", "href", "text", "path"])

    return pages.select("id", C(html).alias("html")).mapInArrow(go, T.StructType([id_, *_NODE]))


def nearest(tags: list[str]) -> Column:
    """The innermost of the elements that a node stands in with one of these tags; null for none."""
    return F.try_element_at(F.filter("path", lambda p: p["tag"].isin(*tags)), L(-1))["node"]


def within(nodes_: DataFrame, some: DataFrame) -> DataFrame:
    """(id, top, ...) for each node that stands in an element named in some (id, top), with the node's own columns."""
    up = nodes_.select("*", F.explode("path.node").alias("top"))
    return up.join(some.select("id", "top").distinct(), ["id", "top"])


def texts(nodes_: DataFrame, some: DataFrame) -> DataFrame:
    """(id, top, text): the texts in each element named in some (id, top), joined by spaces; elements without text have no row."""
    inside = within(nodes_.where(C("tag") == TEXT).select("id", "node", "text", "path"), some)
    return inside.groupBy("id", "top").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), " ").alias("text"))


# What holds an entry of a directory, by tag and by class; what names it; and where people's pages are.
ENTRY, CONTAINER, NAMED = ["tr", "div", "li", "article", "section"], ["div", "article", "li", "tr"], ["h2", "h3", "h4", "a", "strong"]
CLASSES, PERSONAL = "(?i)faculty|person|profile|member|staff|people", ["/people/", "/faculty/", "/profile/", "/person/"]


def directory(pages: DataFrame, key, valid) -> DataFrame:
    """(id, key, email, website) of directory pages (id, url, html): who stands there, by a name's key.

    A mailto link belongs to the first six words of the innermost entry around it. An element whose class tells of people is
    named by its first heading, link or strong text, and has the first mailto link and the first link to a person's page in it.
    Of several for one key in a page the last counts, and those of elements with such a class over all others; addresses that
    valid (email -> Column) refuses and keys of up to three characters are left out. key: a name as a Column -> Column.
    """
    n = stash(nodes(pages), "nodes")  # read nine times below, parsed once
    links = n.where((C("tag") == "a") & C("href").isNotNull())
    email = F.lower(F.trim(F.split_part(F.substring(C("href"), L(8), F.length("href")), L("?"), L(1))))
    mail = links.where(C("href").startswith("mailto:")).withColumn("email", email)
    # by the entry around a link
    near = mail.where(valid(C("email"))).withColumn("top", nearest(ENTRY)).where("top is not null").select("id", "node", "top", "email")
    six = texts(n, near).select("id", "top", F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("name"))
    one = near.join(six, ["id", "top"]).select("id", key(C("name")).alias("key"), L(0).alias("way"), "node", "email", L(None).cast("string").alias("website"))
    # by elements whose class tells
    tops = n.where(C("tag").isin(*CONTAINER) & C("class").rlike(CLASSES)).select("id", C("node").alias("top"))
    first = lambda c: F.min_by(c, "node").alias(c)
    named = within(n.where(C("tag").isin(*NAMED)).select("id", "node", "path"), tops).groupBy("id", "top").agg(F.min("node").alias("named"))
    name = texts(n, named.select("id", C("named").alias("top")).distinct()).select("id", C("top").alias("named"), C("text").alias("name"))
    named = named.join(name, ["id", "named"]).select("id", "top", key(C("name")).alias("key"))
    to = within(mail.select("id", "node", "email", "path"), tops).groupBy("id", "top").agg(first("email"))
    # an address that is refused hides no later one of another element, but has none of its own
    to = to.withColumn("email", F.when(valid(C("email")), C("email")))
    person = F.lit(False)
    for p in PERSONAL:
        person = person | F.contains("href", L(p))
    site = within(links.where(person).select("id", "node", "href", "path"), tops).groupBy("id", "top").agg(first("href"))
    root, base = F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1), F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", "")
    whole = F.when(C("href").rlike("^[a-zA-Z]+:"), C("href")).when(C("href").startswith("//"), F.concat(F.regexp_extract("url", "^([a-zA-Z]+:)", 1), "href")).when(C("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(base, "href"))
    site = site.join(pages.select("id", "url"), "id").select("id", "top", whole.alias("website"))
    two = named.join(to, ["id", "top"], "left").join(site, ["id", "top"], "left").select("id", "key", L(1).alias("way"), C("top").alias("node"), "email", "website").where("email is not null or website is not null")
    both = one.unionByName(two).where(F.length("key") > 3).withColumn("at", F.struct("way", "node"))
    last = lambda c: F.max_by(c, F.when(C(c).isNotNull(), C("at"))).alias(c)
    return both.groupBy("id", "key").agg(last("email"), last("website"))
