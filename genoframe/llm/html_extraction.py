"""Operator 7, HTML extraction: flat text blocks, classified by a decision tree over shallow features.

A page is cut into blocks at block-level tags. A block's features are its own, its predecessor's and its
successor's word count and link density, whether it stands in an article, and whether an enclosing element
is named for something else (menu, advert, comments, ...). A decision tree, grown on the small labelled
table below, marks the blocks of the main text.

Null, empty and tagless-empty pages give an empty text; unclosed tags, comments and raw elements run to the end, but li, tr
and td to their next sibling; deep or very long pages are read in one pass, in linear time; a quote that never closes ends with its tag; equal pages give equal rows; page_id and url pass through, null or not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common

# Names of the HTML standard and usual names of page parts.
RAW = set("script style noscript template title textarea iframe object svg select".split())
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article aside blockquote body details dialog div dl fieldset figure footer form header li main nav ol section table td tr ul".split())
#: Start tag -> open containers that it closes, unless one of the others has been opened since.
SIBLINGS = {"li": (("li",), tuple(sorted(CONTAINERS - {"li", "div"}))), "td": (("td",), ("tr", "table")), "tr": (("tr", "td"), ("table",))}
OTHER_TAGS = set("nav aside footer form dialog".split())
OTHER_NAMES = set("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Names of a page's top; inside an article they are those of its own headings.
TOP_NAMES = {"header", "masthead"}
#: Words that go with a part's name and don't change what it is.
NEUTRAL = set("area articles aside bar block bottom box button buttons cell column container content foot form global group holder icons inner item items left line link links list main message module outer overlay page panel policy posts primary rail right row secondary section signup site slot stories stream sub text thread top unit wrap wrapper zone".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Rest of a tag: ">" within a quoted value doesn't end it. PLAIN: it does.
REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')|=)*+)>""")
PLAIN = re.compile(r"([^>]*+)>")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

FEATURES = ["place", "other", "words", "links", "prev_words", "prev_links", "next_words", "next_links"]
#: place: 0 outside the page's article, 1 inside it, 2 the page has none. other: within a part named for something else.
LABELLED = """
place other words links prev_words prev_links next_words next_links main
1 0 8 0.0 6 0.0 40 0.0 1
1 0 1 0.0 40 0.0 60 0.0 1
1 0 60 0.0 1 0.0 45 0.0 1
1 0 45 0.05 60 0.0 3 0.0 1
1 0 120 0.2 45 0.0 9 0.0 1
1 0 3 0.0 80 0.1 5 0.0 1
1 0 5 1.0 80 0.0 70 0.0 1
1 1 2 1.0 2 1.0 2 1.0 0
1 1 7 0.0 30 0.0 2 1.0 0
1 1 35 0.0 60 0.0 12 0.0 0
1 1 50 0.1 35 0.0 0 0.0 0
0 1 1 1.0 0 0.0 1 1.0 0
0 1 1 1.0 1 1.0 1 1.0 0
0 1 1 1.0 1 1.0 9 0.0 0
0 1 9 0.0 1 1.0 8 0.0 0
0 1 40 0.0 1 1.0 8 0.0 0
0 1 10 0.0 70 0.0 0 0.0 0
0 0 25 0.1 70 0.0 0 0.0 0
0 0 12 0.0 3 1.0 50 0.0 0
0 0 6 0.5 50 0.0 10 0.0 0
0 0 80 0.0 12 0.0 6 0.5 0
0 0 1 0.0 0 0.0 1 1.0 0
2 0 50 0.0 8 0.0 65 0.0 1
2 0 65 0.05 50 0.0 40 0.0 1
2 0 30 0.1 65 0.0 22 0.0 1
2 0 8 0.0 2 1.0 50 0.0 1
2 0 6 0.0 65 0.0 40 0.0 1
2 0 14 0.0 40 0.0 30 0.1 1
2 0 2 1.0 0 0.0 2 1.0 0
2 0 2 1.0 2 1.0 8 0.0 0
2 0 4 0.9 30 0.0 2 1.0 0
2 0 20 0.7 4 0.9 6 0.8 0
2 0 45 0.6 20 0.7 6 0.8 0
2 0 3 0.0 2 1.0 2 1.0 0
2 0 7 0.0 4 0.9 0 0.0 0
2 1 40 0.0 50 0.0 30 0.0 0
2 1 9 0.0 50 0.0 2 1.0 0
2 1 1 1.0 1 1.0 1 1.0 0
1 0 5 0.0 3 0.0 4 0.0 1
1 0 2 0.0 0 0.0 2 0.0 1
1 0 9 0.0 9 0.0 0 0.0 1
1 0 14 0.0 0 0.0 6 0.0 1
1 0 30 0.0 4 0.0 12 0.0 1
1 0 70 0.1 11 0.0 0 0.0 1
1 0 22 0.0 150 0.0 10 0.0 1
1 0 11 0.9 15 0.0 6 0.0 1
1 0 1 0.0 1 0.0 1 0.0 1
1 0 200 0.0 8 0.0 0 0.0 1
1 0 12 0.0 30 0.0 8 0.0 1
1 0 16 0.0 2 0.0 3 0.0 1
0 0 90 0.0 90 0.0 90 0.0 0
0 0 60 0.0 20 0.0 100 0.0 0
0 0 15 0.0 60 0.0 55 0.0 0
0 0 30 0.0 2 1.0 140 0.0 0
0 0 8 0.0 110 0.0 85 0.0 0
0 1 120 0.0 5 0.0 60 0.0 0
0 1 18 0.0 90 0.0 75 0.0 0
1 1 28 0.0 80 0.0 90 0.0 0
1 1 90 0.0 70 0.0 66 0.0 0
1 1 5 0.0 160 0.0 120 0.0 0
1 1 14 0.5 45 0.0 80 0.0 0
2 1 70 0.0 50 0.0 90 0.0 0
2 1 20 0.0 65 0.0 75 0.0 0
2 1 5 0.0 65 0.0 100 0.0 0
1 0 40 0.0 30 0.0 5 1.0 1
1 0 25 0.0 8 0.6 60 0.0 1
1 0 10 0.0 12 1.0 3 0.8 1
1 0 6 0.0 5 1.0 5 1.0 1
1 0 3 0.0 2 1.0 40 0.0 1
2 0 30 0.0 4 0.0 1 1.0 1
2 0 60 0.0 40 0.0 3 1.0 1
2 0 45 0.0 3 1.0 2 1.0 1
2 0 28 0.1 2 1.0 35 0.0 1
1 0 24 0.0 4 1.0 2 0.0 1
1 0 35 0.0 6 1.0 1 1.0 1
1 0 60 0.05 3 1.0 0 0.0 1
1 0 18 0.0 5 0.8 2 0.5 1
1 0 7 0.0 4 1.0 2 0.0 1
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
    """A tree by Gini impurity: (share of ones,) or (feature, limit, tree where x <= limit, tree above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = (len(y) * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
            if cost < best[0] - 1e-12:
                best = (cost, f, limit)
    if best[1] is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(1)
def fitted(table: str = LABELLED, depth: int = 5) -> tuple:
    rows = np.array([line.split() for line in table.strip().splitlines()[1:]], float)
    return grow(rows[:, :-1], rows[:, -1], depth)


def main_text(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def named_other(attributes: str, article: bool) -> bool:
    """A class, id or role names something else: one of its parts does, and no other part says what it is ("related-posts", not "related-work")."""
    known = OTHER_NAMES if article else OTHER_NAMES | TOP_NAMES
    for found in NAMED.findall(attributes):
        for name in "".join(found).split():
            parts = {p.lower() for p in PART.findall(name)}
            if parts & known and parts <= known | NEUTRAL:
                return True
    return False


@lru_cache(None)
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes) of each tag; "" names comments and declarations, "raw" raw elements with what is in them.

    Every step goes on from where the last one ended. A tag whose quoted values leave it open up to the page's end ends at its first ">",
    and so do all later ones, so that the end is looked for from one tag only."""
    at, size, last, rest = 0, len(page), page.rfind(">"), REST
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else size
            yield i, at, "", False, ""
        elif i > last:  # no tag ends after this place
            at = page.find("<!--", i)
            if at < 0:
                return
        elif m := TAG.match(page, i):
            r = rest.match(page, m.end())
            if r is None:
                rest = PLAIN
                r = rest.match(page, m.end())
            name, at = m[2].lower(), r.end()
            if name in RAW and not m[1] and not r[1].endswith("/"):
                end = raw_end(name).search(page, at)
                at = end.start() if end else size
                name = "raw"
            yield i, at, name, bool(m[1]), r[1]
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            at = page.find(">", i) + 1
            yield i, at, "", False, ""
        else:
            start = page.find("<", i + 1)
            if start < 0:
                return
            at = start


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, in an article, in a part named for something else) in page order."""
    out: list[tuple[str, int, float, int, int]] = []
    open_tags: list[tuple[str, int, int]] = []  # name, article, other
    places: dict[str, list[int]] = {}  # where each name stands in open_tags
    parts: list[str] = []
    linked: list[str] = []
    in_link = article = other = 0

    def close() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                links = len(html.unescape("".join(linked)).split())
                out.append((" ".join(words), len(words), links / len(words), int(article > 0), int(other > 0)))
            parts.clear()
            linked.clear()

    def cut(k: int) -> None:
        """Close all containers from place k on."""
        nonlocal article, other
        while len(open_tags) > k:
            tag, inside, odd = open_tags.pop()
            places[tag].pop()
            article, other = article - inside, other - odd

    at = 0
    for start, end, name, ends, attributes in tags(page):
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked.append(parts[-1])
        at = end
        if name == "raw":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK_TAGS:
            close()
            in_link = 0 if name in CONTAINERS and ends else in_link
            if name not in CONTAINERS:
                continue
            if not ends:
                if attributes.endswith("/"):
                    continue
                if name in SIBLINGS:
                    ends_at, within = SIBLINGS[name]
                    bound = max((places[x][-1] for x in within if places.get(x)), default=-1)
                    first = min((k for x in ends_at if places.get(x) and (k := places[x][-1]) > bound), default=None)
                    if first is not None:
                        cut(first)
                odd = int(name in OTHER_TAGS or (name == "header" and not article) or (name != "body" and named_other(attributes, article > 0)))
                inside = int(name in ("article", "main"))
                places.setdefault(name, []).append(len(open_tags))
                open_tags.append((name, inside, odd))
                article, other = article + inside, other + odd
            else:
                if places.get(name):
                    cut(places[name][-1])
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            linked.append(parts[-1])
    close()
    return out


def extract(page: str) -> str:
    found = blocks(page)
    has = any(b[3] for b in found)
    tree, none = fitted(), ("", 0, 0.0, 0, 0)
    keep = []
    for before, b, after in zip([none, *found], found, [*found[1:], none], strict=False):
        if main_text(tree, (b[3] if has else 2, b[4], b[1], b[2], before[1], before[2], after[1], after[2])):
            keep.append(b[0])
    return "\n\n".join(keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    common.small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extract(x) for x in common.texts(b.column("html"))]
            yield common.batch(schema, page_id=b.column("page_id"), url=b.column("url"), text=out, n_chars=[len(x) for x in out])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.read(spark, sf_dir, "pages"))
