"""Main text of web pages: flat text blocks, shallow features, a decision tree fitted to a small labelled table."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A tag's name, and the rest of it: a quote opens a value only right after an equals sign.
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_ATTR = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WORD = re.compile(r"[a-z0-9]+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_RAW = set("script style title textarea xmp noscript iframe noembed noframes template".split())
_DROPPED = set("head svg math object applet audio video canvas map select option optgroup datalist button textarea fieldset legend dialog".split())
_CHROME_TAGS = set("nav header footer aside form menu".split())
_CHROME_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
_CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer copyright sidebar aside widget widgets "
    "related recommended recommendations share sharing social follow cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login form search comment comments commentlist respond reply replies disqus discussion "
    "pagination pager skip toolbar outbrain taboola".split()
)
# Words that tell nothing: a class name of these and furniture words is furniture, one with any other word isn't.
_PLAIN_WORDS = set(
    "area bar block body box bottom button buttons center col column component container content desktop element entries entry fixed global group groups holder "
    "icon icons inner item items l label large left link links list main mobile module news outer page pages panel post posts primary r region right row rail secondary "
    "section sections site slot small stories sticky story tertiary text the title top unit us view wrap wrapper you more also by for to of area1 area2".split()
)
# Headings of readers' comments; a section of an article may be called Discussion, Responses or Replies.
_COMMENTS = re.compile(r"\d+\s+(?:reader\s+)?(?:comments?|replies|responses)|(?:reader\s+)?(?:comments?|replies|responses|discussion)\s*\(\d+\):?|(?:reader\s+)?comments:?|leave a (?:comment|reply)|join the (?:conversation|discussion)|post a comment", re.I)
#: Which open elements an opening tag ends, at which of them it stops looking, and which hide them from it.
_ENDS = {
    "li": ({"li"}, {"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"tr"}, {"table"}), "td": ({"td", "th"}, {"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"thead", "tbody"}, {"table"}),
}
_MAIN_WORDS = set("article articlebody story storybody maincontent".split())
_MAIN_PAIRS = [{"main", "content"}, {"post", "content"}, {"post", "body"}, {"entry", "content"}, {"article", "content"}, {"article", "body"}, {"story", "body"}]
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

#: What a block's features are: within page furniture by tag or label; within the article (1), on a page that marks none (0),
#: outside it (-1); link density and words; link density of the block before and after, words of these; heading.
FEATURES = ("furniture", "inside", "links", "words", "links_before", "links_after", "words_before", "words_after", "heading")

#: Labelled blocks, made up for this purpose: the features in order, then 1 for main text.
LABELLED = [
    (0, 1, 0.0, 60, 1.0, 0.0, 1, 80, 0, 1), (0, 1, 0.0, 12, 0.0, 0.0, 5, 60, 1, 1), (0, 1, 0.0, 2, 0.0, 0.0, 70, 90, 0, 1), (0, 1, 0.0, 1, 0.0, 0.0, 40, 0, 0, 1), (0, 1, 0.2, 30, 0.0, 0.0, 45, 50, 0, 1),
    (0, 1, 0.0, 4, 1.0, 0.0, 1, 3, 1, 1), (0, 1, 1.0, 8, 0.0, 0.0, 50, 60, 0, 1), (0, 1, 0.0, 3, 0.0, 0.0, 2, 4, 0, 1), (0, 1, 0.5, 6, 0.0, 0.0, 20, 30, 0, 1), (0, 1, 0.05, 150, 0.0, 0.0, 10, 9, 0, 1),
    (0, 1, 0.0, 25, 0.0, 0.0, 8, 0, 0, 1), (0, 1, 1.0, 2, 0.0, 0.0, 60, 40, 0, 1), (0, 1, 1.0, 2, 1.0, 1.0, 2, 3, 0, 0), (0, 1, 1.0, 1, 1.0, 1.0, 3, 2, 0, 0), (0, 1, 1.0, 4, 1.0, 1.0, 2, 2, 0, 0),
    (1, -1, 0.0, 10, 1.0, 0.0, 2, 11, 0, 0), (1, -1, 0.0, 40, 0.0, 0.0, 12, 30, 0, 0), (1, -1, 1.0, 2, 1.0, 1.0, 2, 2, 0, 0), (1, -1, 0.1, 15, 0.0, 0.0, 70, 0, 0, 0), (1, 1, 0.0, 12, 0.0, 0.0, 60, 55, 0, 0),
    (1, 1, 0.0, 35, 0.0, 0.0, 80, 40, 0, 0), (1, 1, 1.0, 3, 0.0, 0.0, 60, 50, 0, 0), (1, 1, 0.0, 5, 0.0, 0.0, 30, 20, 1, 0), (1, 1, 0.0, 90, 0.0, 0.0, 20, 30, 0, 0), (1, 1, 0.0, 20, 0.0, 0.0, 3, 5, 0, 0),
    (1, 0, 0.0, 50, 0.0, 0.0, 2, 60, 0, 0), (1, 0, 0.0, 12, 0.0, 0.0, 40, 70, 0, 0), (1, 0, 1.0, 2, 1.0, 1.0, 1, 3, 0, 0), (0, -1, 0.0, 10, 0.0, 0.0, 30, 40, 0, 0), (0, -1, 0.0, 60, 1.0, 0.0, 3, 9, 0, 0),
    (0, -1, 0.0, 5, 1.0, 0.0, 2, 60, 1, 0), (0, -1, 1.0, 3, 0.0, 1.0, 40, 3, 0, 0), (0, -1, 0.0, 25, 0.0, 0.0, 60, 0, 0, 0), (0, -1, 0.0, 1, 0.0, 0.0, 1, 1, 0, 0), (0, 0, 0.0, 45, 0.0, 0.0, 6, 60, 0, 1),
    (0, 0, 0.1, 80, 0.0, 0.0, 50, 70, 0, 1), (0, 0, 0.0, 18, 0.0, 0.5, 90, 5, 0, 1), (0, 0, 0.1, 14, 1.0, 0.0, 4, 40, 0, 1), (0, 0, 0.0, 3, 0.0, 0.0, 60, 70, 0, 1), (0, 0, 0.0, 5, 0.0, 0.0, 45, 30, 0, 1),
    (0, 0, 0.0, 7, 1.0, 0.0, 2, 50, 1, 1), (0, 0, 0.0, 6, 0.0, 0.0, 40, 60, 1, 1), (0, 0, 1.0, 2, 1.0, 1.0, 3, 2, 0, 0), (0, 0, 0.9, 3, 0.0, 1.0, 60, 2, 0, 0), (0, 0, 0.9, 25, 1.0, 0.8, 3, 20, 0, 0),
    (0, 0, 0.7, 12, 1.0, 1.0, 5, 8, 0, 0), (0, 0, 0.0, 4, 1.0, 1.0, 2, 3, 0, 0), (0, 0, 0.0, 5, 0.0, 0.0, 3, 2, 0, 0), (0, 0, 0.0, 3, 1.0, 0.0, 2, 1, 1, 0), (0, 0, 0.0, 4, 0.0, 0.0, 6, 0, 0, 0),
    (0, 1, 0.0, 19, 0.0, 0.0, 3, 2, 0, 1), (0, 1, 0.0, 40, 0.0, 0.0, 1, 1, 0, 1), (0, 1, 0.0, 2, 0.0, 0.0, 2, 1, 0, 1), (0, 1, 0.3, 9, 1.0, 1.0, 3, 2, 0, 1), (0, 1, 0.0, 5, 1.0, 0.0, 2, 3, 1, 1),
    (0, 1, 0.0, 7, 0.0, 1.0, 60, 2, 0, 1), (0, 1, 1.0, 3, 0.0, 1.0, 40, 20, 0, 1), (0, 1, 1.0, 5, 1.0, 0.0, 4, 60, 0, 1),
    (0, 0, 0.0, 19, 0.0, 0.0, 3, 1, 0, 1), (0, 0, 0.0, 1, 0.0, 0.0, 19, 19, 0, 1), (0, 0, 0.0, 19, 0.0, 1.0, 1, 1, 0, 1), (0, 0, 0.0, 3, 1.0, 0.0, 1, 19, 1, 1), (0, 0, 0.0, 22, 1.0, 1.0, 2, 2, 0, 1),
    (0, 0, 0.0, 100, 0.0, 0.0, 0, 0, 0, 1), (0, 0, 0.0, 30, 0.0, 0.0, 4, 5, 0, 1), (0, 0, 1.0, 1, 0.0, 1.0, 0, 1, 0, 0), (0, 0, 1.0, 1, 1.0, 0.0, 1, 3, 0, 0), (0, 0, 1.0, 1, 0.0, 0.0, 19, 0, 0, 0),
    (0, 0, 0.0, 4, 0.0, 0.0, 0, 0, 0, 1), (0, 0, 0.0, 1, 0.0, 0.0, 0, 0, 0, 1), (0, 0, 0.0, 12, 0.0, 0.0, 0, 0, 0, 1), (0, 0, 0.2, 8, 0.0, 0.0, 0, 0, 0, 1), (0, 0, 1.0, 3, 0.0, 0.0, 0, 0, 0, 0),
    (0, 0, 0.0, 15, 0.0, 0.0, 2, 2, 0, 1), (0, -1, 0.0, 19, 0.0, 0.0, 3, 1, 0, 0), (0, -1, 0.0, 120, 0.0, 0.0, 30, 40, 0, 0), (0, 0, 1.0, 9, 1.0, 1.0, 8, 9, 0, 0),
]


#: The features of text and links alone; the first splits of the tree are between these.
SHALLOW = tuple(FEATURES.index(f) for f in ("links", "words", "links_before", "links_after", "words_before", "words_after"))
SHALLOW_DEPTH = 2


def fit_tree(rows: list[tuple], depth: int = 8, shallow: int = SHALLOW_DEPTH):
    """A binary classification tree by least Gini impurity: (feature, threshold, left, right), or 0 or 1.

    The first shallow levels divide blocks by words and link density of the block and its neighbours only.
    """
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in SHALLOW if shallow else range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            t = (lo + hi) / 2
            score = 0.0
            for side in ([r for r in rows if r[f] <= t], [r for r in rows if r[f] > t]):
                p = sum(r[-1] for r in side) / len(side)
                score += len(side) * p * (1 - p)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, t)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, t = best
    return f, t, *(fit_tree(side, depth - 1, max(0, shallow - 1)) for side in ([r for r in rows if r[f] <= t], [r for r in rows if r[f] > t]))


@lru_cache(maxsize=1)
def tree():
    return fit_tree(LABELLED)


def decide(node, x: tuple) -> int:
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def _labels(tag: str, raw: str) -> tuple[bool, bool, bool]:
    """(never text, furniture, article) by an element's tag and attributes."""
    furniture, main = tag in _CHROME_TAGS, tag in ("article", "main")
    if not raw or raw.isspace():
        return tag in _DROPPED, furniture, main
    attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTR.findall(raw)}
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    names = [set(_WORD.findall(x)) for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()]
    words = set().union(*names)
    role = attrs.get("role", "").lower()
    if tag not in ("html", "body"):
        main |= role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody" or bool(words & _MAIN_WORDS) or any(p <= words for p in _MAIN_PAIRS)
        chrome = any(n & _CHROME_WORDS and all(w in _CHROME_WORDS or w in _PLAIN_WORDS or w.isdigit() for w in n) for n in names)
        furniture |= role in _CHROME_ROLES or chrome and tag not in ("article", "main")
    return tag in _DROPPED or hidden, furniture, main


@lru_cache(maxsize=64)
def _close(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, heading, furniture, inside the article) of each flat run of text between block tags, in page order."""
    out: list[tuple[str, float, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    linked: list[str] = []
    links, at, size, heading = 0, 0, len(page), False
    cdata, open_ = True, Counter()

    def push(tag: str, *flags: bool) -> None:
        stack.append((tag, *flags))
        open_[tag] += 1

    def cut(k: int) -> None:
        open_.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def state() -> tuple[bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False)

    def flush() -> None:
        nonlocal heading
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            inner = " ".join(entities.unescape(" ".join(linked)).split())
            _, furniture, main = state()
            out.append((text, min(1.0, len(inner) / len(text)), heading, furniture, main))
        held.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not state()[0]:
            held.append(text)
            if links:
                linked.append(text)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", lt) and cdata:
            end = page.find("]]>", lt + 9)
            cdata = end >= 0
            if cdata:
                add(page[lt + 9 : end].replace("&", "&amp;"))
                at = end + 3
                continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            add("<")
            at = lt + 1
            continue
        rest = _REST.match(page, m.end())
        if rest.end() == size:  # the page ends within a tag
            break
        at = rest.end() + 1
        tag, closing, raw = m[2].lower(), m[1] == "/", rest[0]
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in _INLINE or tag == "span":
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if open_[tag] else None
                if tag != "span" or (k is not None and (stack[-1][1:] != (stack[k - 1][1:] if k else (False,) * 3))):
                    flush()
                if k is not None:
                    cut(k)
                if tag in _HEADINGS:
                    heading = False
            continue
        if tag in _RAW and not raw.rstrip().endswith("/"):
            end = _close(tag).search(page, at)
            gt = page.find(">", end.end()) if end else -1
            at = gt + 1 if gt >= 0 else size
            continue
        if tag == "a":
            links += 1
        if tag == "br":
            held.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _INLINE and tag != "span":
            continue
        drop, furniture, main = _labels(tag, raw)
        if tag == "span":
            if not (drop or furniture):
                push(tag, *state())
                continue
        flush()
        if tag != "span":
            links = 0
            ends, last, stops = _ENDS.get(tag, ((), (), ()))
            lowest = len(stack)
            for k in range(len(stack) - 1, -1, -1) if any(open_[x] for x in ends) else ():
                if stack[k][0] in stops:
                    break
                if stack[k][0] in ends:
                    lowest = k
                if stack[k][0] in last:
                    break
            cut(lowest)
            k = len(stack)
            while k and stack[k - 1][0] == "span":
                k -= 1
            if k and stack[k - 1][0] == "p":
                cut(k - 1)
        up = state()
        push(tag, up[0] or drop, up[1] or furniture, up[2] or main)
        heading = tag in _HEADINGS
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, for pages without a letter or digit and where no block counts as main text."""
    found = blocks(page or "")
    if not any(c.isalnum() for b in found for c in b[0]):
        return ""
    marked = any(b[4] for b in found)
    n = [len(b[0].split()) for b in found]
    keep, talk = [], False
    for i, (text, links, heading, furniture, main) in enumerate(found):
        if heading:  # what follows are readers' comments, up to the next heading
            talk = _COMMENTS.fullmatch(text) is not None
        before = (n[i - 1], found[i - 1][1]) if i else (0, 0.0)
        after = (n[i + 1], found[i + 1][1]) if i + 1 < len(found) else (0, 0.0)
        x = (int(furniture or talk), (1 if main else -1) if marked else 0, links, n[i], before[1], after[1], before[0], after[0], int(heading))
        if decide(tree(), x):
            keep.append(text)
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html; other columns are ignored).

    A null page counts as an empty one and has the empty text. Repeated rows stay repeated; null ids and urls are kept;
    an empty table gives no rows; pages of any length count whole. n_chars counts code points.
    """

    def go(batches):
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(go, "page_id long, url string, text string, n_chars long")
