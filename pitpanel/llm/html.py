"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its own and its
neighbours' word counts and link densities, by whether it stands in the page's article, and by whether
a container around it names itself as furniture (a menu, an advert, comments). A decision tree grown
on the small labelled table below tells content from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import text_batches

# Tag and name lists.
SKIPPED = frozenset("script style noscript template title svg math iframe object select textarea button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog".split())
FURNITURE_NAMES = re.compile(r"^(ads?|adverts?|advertisement|banner|sponsor(ed)?|promo(tion)?|nav(bar|igation)?|menu|side ?bar|foot(er)?|head(er)?|masthead|breadcrumbs?|"
                             r"comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|social|related|"
                             r"recommended|widget|toolbar|copyright|legal|pagination|pager|skip)$")
#: Furniture also around or on an article: what others wrote, or other pages' articles. Other names and forms do not reach into an article.
STRONG_NAMES = re.compile(r"^(ads?|adverts?|advertisement|sponsor(ed)?|promo(tion)?|comments?|commentlist|respond|replies|disqus|related|recommended)$")
STRONG_TAGS = FURNITURE_TAGS - {"form"}
#: A name with one of these words tells of the page's layout ("no-sidebar", "has-header"); "legal" alone is a name, as a part it is not.
LAYOUT_WORDS = frozenset("no not non without with has have is".split())
WHOLE_ONLY = frozenset(("legal",))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
ARTICLE = frozenset(("article", "main"))

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading")
# Labelled blocks: the features in this order, then 1 for content.
LABELLED = [
    (6, 1.0, 0, 0.0, 8, 0.0, 0, 1, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 40, 0.0, 0, 1, 0, 0), (14, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0),
    (60, 0.0, 10, 0.0, 55, 0.0, 0, 1, 0, 0), (22, 0.1, 80, 0.0, 0, 0.0, 0, 1, 0, 0), (9, 0.0, 120, 0.0, 0, 0.0, 0, 1, 0, 0), (35, 0.0, 70, 0.0, 20, 0.0, 1, 1, 0, 0),
    (12, 0.0, 90, 0.0, 33, 0.0, 1, 1, 0, 0), (3, 0.0, 40, 0.0, 18, 0.0, 1, 1, 1, 0), (45, 0.3, 12, 1.0, 30, 0.0, 1, 1, 0, 0), (4, 0.0, 0, 0.0, 90, 0.0, 0, 1, 1, 0),
    (10, 0.0, 14, 0.0, 70, 0.0, 1, 0, 1, 1), (1, 0.0, 30, 0.0, 25, 0.0, 1, 0, 0, 1), (2, 0.0, 9, 0.0, 0, 0.0, 1, 0, 0, 1), (80, 0.0, 10, 0.0, 60, 0.0, 1, 0, 0, 1),
    (55, 0.05, 80, 0.0, 12, 0.0, 1, 0, 0, 1), (7, 1.0, 60, 0.0, 40, 0.0, 1, 0, 0, 1), (200, 0.02, 50, 0.0, 3, 1.0, 1, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, 1, 0, 0, 1), (4, 0.0, 2, 0.0, 5, 0.0, 1, 0, 0, 1), (3, 0.0, 4, 0.0, 4, 0.0, 1, 0, 1, 1), (5, 0.0, 7, 0.0, 1, 0.0, 1, 0, 0, 1),
    (1, 1.0, 2, 0.5, 3, 1.0, 1, 0, 0, 1), (3, 1.0, 3, 1.0, 4, 1.0, 1, 0, 0, 1), (6, 0.5, 5, 1.0, 6, 0.6, 1, 0, 0, 1), (2, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1),
    (15, 0.0, 1, 0.0, 18, 0.1, 0, 0, 0, 1), (18, 0.1, 15, 0.0, 3, 0.0, 0, 0, 0, 1), (12, 0.0, 20, 0.0, 14, 0.0, 0, 0, 0, 1), (13, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (16, 0.0, 2, 0.0, 12, 0.2, 0, 0, 0, 1), (75, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0, 1), (40, 0.1, 60, 0.0, 90, 0.0, 0, 0, 0, 1), (110, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (26, 0.0, 70, 0.0, 45, 0.0, 0, 0, 0, 1),
    (18, 0.0, 35, 0.0, 50, 0.0, 0, 0, 0, 1), (30, 0.0, 4, 1.0, 22, 0.0, 0, 0, 0, 1), (13, 0.0, 44, 0.0, 31, 0.0, 0, 0, 0, 1), (9, 0.0, 5, 1.0, 60, 0.0, 0, 0, 1, 1),
    (6, 0.0, 70, 0.0, 85, 0.0, 0, 0, 1, 1), (4, 0.0, 50, 0.0, 64, 0.0, 0, 0, 1, 1), (8, 0.0, 0, 0.0, 95, 0.0, 0, 0, 1, 1),
    (5, 1.0, 4, 1.0, 6, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 30, 0.0, 0, 0, 0, 0), (25, 0.9, 3, 1.0, 20, 0.8, 0, 0, 0, 0), (12, 0.6, 10, 1.0, 11, 0.7, 0, 0, 0, 0),
    (40, 0.7, 12, 0.5, 9, 0.9, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 0), (5, 0.0, 6, 1.0, 0, 0.0, 0, 0, 0, 0),
    (8, 0.0, 9, 0.0, 7, 0.0, 0, 0, 0, 0), (9, 0.0, 4, 1.0, 8, 0.5, 0, 0, 0, 0), (7, 0.0, 6, 0.0, 9, 0.0, 0, 0, 0, 0), (9, 0.0, 12, 0.0, 2, 0.0, 0, 0, 0, 0),
    (4, 0.0, 5, 0.0, 3, 0.0, 0, 0, 0, 0), (2, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0, 0), (5, 0.0, 7, 0.0, 2, 0.0, 0, 0, 0, 0), (1, 0.0, 3, 0.0, 3, 0.0, 0, 0, 0, 0),
    (2, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0), (6, 0.0, 4, 0.5, 5, 1.0, 0, 0, 1, 0), (3, 0.0, 5, 1.0, 4, 1.0, 0, 0, 1, 0), (7, 0.4, 8, 0.0, 2, 1.0, 0, 0, 0, 0),
]


def named(value: str, whole: bool = False) -> int:
    """What a class or id says of a container: 0 nothing, 1 furniture, 2 furniture also around an article; ``whole``: its names as they are, without parts."""
    found = 0
    for w in value.lower().split():
        parts = [p for p in re.split(r"[-_0-9]+", w) if p]
        if LAYOUT_WORDS.isdisjoint(parts):
            for p in (w.rstrip("-_0123456789"), *(() if whole else (p for p in parts if p not in WHOLE_ONLY))):
                found = max(found, 2 if STRONG_NAMES.match(p) else 1 if FURNITURE_NAMES.match(p) else 0)
    return found


class Blocks(HTMLParser):
    """Flat blocks of a page, in order: (text, words, link words, in the article, furniture, heading)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []   # tag, furniture (2 also around an article), weak furniture around the tag
        self.found: list[tuple[str, int, int, int, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = self.skips = self.articles = self.strong = self.weak = self.headings = 0
        self.places: dict[str, list[int]] = {}       # where each tag stands open, the innermost last

    def cut(self) -> None:
        words = "".join(self.parts).split()
        if words:
            self.found.append((" ".join(words), len(words), min(self.linked, len(words)), int(self.articles > 0), int(self.strong + self.weak > 0), int(self.headings > 0)))
        self.parts, self.linked = [], 0

    def count(self, tag: str, furniture: int, by: int) -> None:
        self.links += by * (tag == "a")
        self.skips += by * (tag in SKIPPED)
        self.articles += by * (tag in ARTICLE)
        self.strong += by * (furniture == 2)
        self.headings += by * (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")

    def drop(self, tag: str, until: frozenset[str] = frozenset()) -> None:
        """Close the innermost ``tag`` and what is open inside it, unless a tag of ``until`` stands inside it.

        The places of open tags are kept by name, so an end without a start costs nothing and every tag is closed once."""
        at = self.places.get(tag)
        if not at or any(p[-1] > at[-1] for t in until if (p := self.places.get(t))):
            return
        for _ in range(len(self.open) - at[-1]):
            closed, furniture, self.weak = self.open.pop()
            self.places[closed].pop()
            self.count(closed, furniture, -1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.cut()
            self.drop("p", BLOCKS - {"p"})
            if tag in ("li", "tr", "td", "th", "dt", "dd"):
                self.drop(tag, frozenset(("ul", "ol", "table", "dl", "menu")))
        if tag in VOID:
            return
        furniture = 2 if tag in STRONG_TAGS else int(tag in FURNITURE_TAGS)
        if not furniture and tag not in ("html", "body", "main"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    level = named(value, tag == "article")
                    furniture = max(furniture, level if tag != "article" or level == 2 else 0)
                elif name == "role" and value and tag != "article":
                    furniture = max(furniture, 2 * (value.lower() in FURNITURE_ROLES - {"form"}), int(value.lower() == "form"))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, furniture, self.weak))
        self.weak = (0 if tag in ARTICLE else self.weak) + (furniture == 1)
        self.count(tag, furniture, 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:                           # a slash on other tags means nothing in HTML
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.drop(tag)

    def handle_data(self, data: str) -> None:
        if self.skips:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.cut()
    return parser.found


def features(found: list[tuple[str, int, int, int, int, int]]) -> np.ndarray:
    """Own, previous and next word counts and link densities, and the three marks, of every block."""
    own = np.array([(w, k / w) for _, w, k, *_ in found], float).reshape(-1, 2)
    marks = np.array([b[3:] for b in found], float).reshape(-1, 3)
    none = np.zeros((1, 2))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), marks]) if len(own) else np.zeros((0, len(FEATURES)))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1):
    """A classification tree by Gini impurity: (feature, threshold, below, above) or a class."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            n, m = left.sum(), (~left).sum()
            if min(n, m) >= least:
                p, q = y[left].mean(), y[~left].mean()
                cost = n * p * (1 - p) + m * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(t), left)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, left = best
    return f, t, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def train(labelled=LABELLED):
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1])


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, t, below, above = tree
    low = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", labelled=LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A NULL or empty page, and one without content, gives an empty text. Repeated rows stay repeated, NULL
    ids and addresses stay NULL, no rows give no rows, other columns are ignored. A page that is cut off is
    read as far as it goes. n_chars counts code points."""
    tree = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in text_batches(batches, "html"):
            out = [main_text(p.decode("utf-8", "replace"), tree) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
