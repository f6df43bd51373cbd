"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read once into flat blocks (a paragraph, a heading, a list item, other text).  The tree sees
a block's number of words and link density, those of the blocks before and after it, and the kind of
element it is; it knows neither articles nor menus.  It is grown from the labelled table below, and
the blocks it takes for main text are joined in page order.

What numbers cannot tell from prose is cut while the page is read, like scripts: forms, dialogs,
hidden parts, and elements called a notice or reader comments.

Defined cases: a null, empty or textless page has an empty text; comments, scripts, styles and
other raw parts are no text, also when they are never closed; a cut part that is never closed
ends where an article or the main part begins; broken character references stay as they are; a
page whose quotes never close is read by its angle brackets alone from there on, and a "<" that
nothing closes is text; time is linear in the page, however long or broken; equal pages get equal
texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: kinds of elements
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
CUT_TAGS = frozenset("button dialog fieldset form label search select".split())
CUT_NAMES = frozenset(
    "alert comment comments consent cookie cookies dialog disqus discussion gdpr login modal newsletter notice notices "
    "notification overlay popup replies reply respond response responses signup subscribe subscription".split())
CUT_ROLES = frozenset("alert dialog form search".split())
RAW_TAGS = frozenset("canvas iframe noscript object script style svg template textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Kinds of blocks by their innermost element; all others are 0.
KINDS = {**dict.fromkeys("li dd dt option td th".split(), 1), **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 2),
         **dict.fromkeys("p pre blockquote".split(), 3)}
OTHER, ITEM, HEADING, PARAGRAPH = range(4)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)([^>]*)>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    words: int
    density: float
    kind: int


class Features(NamedTuple):
    """What the tree sees of a block; a missing neighbour has 0 words."""

    words: float
    density: float
    words_before: float
    density_before: float
    words_after: float
    density_after: float
    kind: float


# fixed values: the labelled table, blocks as in Features and whether they are main text
LABELLED: tuple[tuple[Features, bool], ...] = tuple((Features(*row[:-1]), bool(row[-1])) for row in (
    # three of the given pages, whole: menu, advert, title, paragraphs, footer
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0), (1, 1.0, 1, 1.0, 8, 0.0, 1, 0), (8, 0.0, 1, 1.0, 11, 0.0, 0, 0),
    (11, 0.0, 8, 0.0, 49, 0.0, 2, 1), (49, 0.0, 11, 0.0, 108, 0.0, 3, 1), (108, 0.0, 49, 0.0, 40, 0.0, 3, 1),
    (40, 0.0, 108, 0.0, 2, 0.0, 3, 1), (2, 0.0, 40, 0.0, 7, 0.0, 3, 1), (7, 0.0, 2, 0.0, 48, 0.0, 3, 1),
    (48, 0.0, 7, 0.0, 12, 0.0, 3, 1), (12, 0.0, 48, 0.0, 0, 0.0, 0, 0), (1, 1.0, 1, 1.0, 9, 0.0, 1, 0),
    (9, 0.0, 1, 1.0, 11, 0.0, 0, 0), (11, 0.0, 9, 0.0, 75, 0.0, 2, 1), (75, 0.0, 11, 0.0, 8, 0.0, 3, 1),
    (8, 0.0, 75, 0.0, 12, 0.0, 3, 1), (12, 0.0, 8, 0.0, 123, 0.0, 3, 1), (123, 0.0, 12, 0.0, 1, 0.0, 3, 1),
    (1, 0.0, 123, 0.0, 9, 0.0, 3, 1), (9, 0.0, 1, 0.0, 11, 0.0, 3, 1), (11, 0.0, 9, 0.0, 0, 0.0, 0, 0),
    (8, 0.0, 1, 1.0, 12, 0.0, 0, 0), (12, 0.0, 8, 0.0, 31, 0.0, 2, 1), (31, 0.0, 12, 0.0, 23, 0.0, 3, 1),
    (23, 0.0, 31, 0.0, 35, 0.0, 3, 1), (35, 0.0, 23, 0.0, 35, 0.0, 3, 1), (15, 0.0, 23, 0.0, 43, 0.0, 3, 1),
    (43, 0.0, 15, 0.0, 4, 0.0, 3, 1), (4, 0.0, 43, 0.0, 9, 0.0, 3, 1), (9, 0.0, 4, 0.0, 9, 0.0, 3, 1), (9, 0.0, 9, 0.0, 0, 0.0, 0, 0),
    # other given blocks: short titles and texts, long texts, adverts and footers of other lengths
    (1, 0.0, 5, 0.0, 26, 0.0, 2, 1), (5, 0.0, 13, 0.0, 1, 0.0, 2, 1), (24, 0.0, 16, 0.0, 97, 0.0, 2, 1), (2320, 0.0, 9, 0.0, 13, 0.0, 3, 1),
    (1, 0.0, 1, 0.0, 4, 0.0, 3, 1), (3, 0.0, 24, 0.0, 16, 0.0, 3, 1), (4, 0.0, 1, 1.0, 5, 0.0, 0, 0), (16, 0.0, 1, 1.0, 24, 0.0, 0, 0),
    (13, 0.0, 1, 1.0, 1, 0.0, 0, 0), (5, 0.0, 1, 0.0, 0, 0.0, 0, 0), (16, 0.0, 97, 0.0, 0, 0.0, 0, 0), (4, 0.0, 2320, 0.0, 0, 0.0, 0, 0),
    # headings of a site and of lists of links, and of sections of a text
    (1, 0.0, 0, 0.0, 1, 1.0, 2, 0), (3, 0.0, 0, 0.0, 2, 1.0, 2, 0), (2, 0.0, 60, 0.0, 5, 1.0, 2, 0), (4, 0.0, 2, 1.0, 6, 0.9, 2, 0),
    (2, 1.0, 0, 0.0, 1, 1.0, 2, 0), (2, 0.0, 90, 0.0, 70, 0.0, 2, 1), (6, 0.0, 40, 0.1, 30, 0.2, 2, 1), (9, 0.0, 1, 1.0, 80, 0.0, 2, 1),
    (5, 1.0, 50, 0.0, 60, 0.0, 2, 1), (3, 0.0, 20, 0.0, 4, 0.0, 2, 1), (3, 0.0, 1, 1.0, 60, 0.0, 2, 1), (5, 0.0, 2, 1.0, 40, 0.0, 2, 1),
    (2, 0.0, 1, 1.0, 5, 0.0, 2, 1), (7, 0.0, 3, 1.0, 12, 0.1, 2, 1), (1, 0.0, 1, 1.0, 25, 0.0, 2, 1),
    # items of a text, and of menus, crumbs and related links
    (8, 0.0, 60, 0.0, 9, 0.0, 1, 1), (9, 0.0, 8, 0.0, 12, 0.0, 1, 1), (2, 0.0, 14, 0.0, 2, 0.0, 1, 1), (20, 0.2, 9, 0.0, 30, 0.0, 1, 1),
    (35, 0.1, 20, 0.2, 0, 0.0, 1, 1), (2, 0.0, 2, 0.0, 2, 0.0, 1, 1), (12, 0.3, 40, 0.0, 10, 0.4, 1, 1), (3, 1.0, 5, 0.0, 3, 1.0, 1, 0),
    (6, 1.0, 3, 1.0, 8, 1.0, 1, 0), (8, 1.0, 6, 1.0, 12, 0.0, 1, 0), (7, 0.7, 2, 1.0, 9, 0.8, 1, 0), (2, 0.0, 1, 1.0, 1, 1.0, 1, 0),
    (1, 0.0, 2, 1.0, 2, 1.0, 1, 0), (4, 0.9, 90, 0.0, 3, 1.0, 1, 0), (2, 1.0, 2, 0.0, 4, 0.0, 1, 0), (3, 1.0, 50, 0.0, 60, 0.0, 1, 0),
    (5, 1.0, 30, 0.0, 9, 0.0, 1, 0), (1, 1.0, 9, 0.0, 40, 0.0, 1, 0),
    # a text in plain elements, and what stands beside one: captions, bars, credits, teasers
    (60, 0.0, 9, 0.0, 80, 0.1, 0, 1), (80, 0.1, 60, 0.0, 45, 0.0, 0, 1), (45, 0.0, 80, 0.1, 33, 0.0, 0, 1), (33, 0.0, 45, 0.0, 6, 1.0, 0, 1),
    (120, 0.05, 3, 1.0, 60, 0.0, 0, 1), (28, 0.1, 50, 0.0, 70, 0.0, 0, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, 1), (40, 0.2, 1, 1.0, 90, 0.0, 0, 1),
    (5, 0.6, 60, 0.0, 2, 1.0, 0, 0), (2, 1.0, 3, 1.0, 3, 1.0, 0, 0), (30, 0.9, 4, 1.0, 20, 1.0, 0, 0), (50, 0.8, 90, 0.0, 6, 1.0, 0, 0),
    (9, 0.0, 30, 0.0, 1, 1.0, 0, 0), (3, 0.0, 1, 1.0, 0, 0.0, 0, 0), (7, 0.3, 2, 1.0, 40, 0.0, 0, 0), (18, 0.5, 40, 0.0, 0, 0.0, 0, 0),
    # paragraphs of links, and with links
    (2, 1.0, 1, 1.0, 1, 1.0, 3, 0), (5, 1.0, 40, 0.0, 3, 1.0, 3, 0), (12, 0.9, 2, 1.0, 9, 1.0, 3, 0), (6, 0.8, 4, 1.0, 0, 0.0, 3, 0),
    (25, 0.4, 30, 0.0, 20, 0.3, 3, 1), (60, 0.3, 5, 0.0, 40, 0.1, 3, 1), (9, 0.3, 50, 0.0, 30, 0.0, 3, 1), (4, 0.0, 1, 1.0, 1, 1.0, 3, 1),
    (40, 0.0, 60, 0.0, 0, 0.0, 3, 1), (9, 0.0, 30, 0.0, 0, 0.0, 3, 1), (300, 0.0, 0, 0.0, 0, 0.0, 3, 1), (4, 0.0, 3, 0.0, 0, 0.0, 3, 1),
    (20, 0.0, 1, 1.0, 0, 0.0, 3, 1), (1, 0.0, 1, 0.0, 0, 0.0, 3, 1), (30, 0.7, 60, 0.0, 50, 0.0, 3, 1), (15, 0.6, 40, 0.0, 35, 0.0, 3, 1), (7, 1.0, 60, 0.0, 55, 0.0, 3, 1),
))


@dataclass
class Node:
    """A leaf says yes or no; another node sends a block to below or above by one feature."""

    answer: bool
    feature: int = -1
    bound: float = 0.0
    below: Node | None = None
    above: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """Tree by Gini impurity; of equal splits the first feature and the lowest bound."""
    node = Node(bool(2 * y.sum() > len(y)))
    if not depth or y.all() or not y.any():
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < bound
            cost = sum(s.sum() * (len(s) - s.sum()) / len(s) for s in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, bound)
    if best is None:
        return node
    _, node.feature, node.bound = best
    low = x[:, node.feature] < node.bound
    node.below, node.above = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


@cache
def tree() -> Node:
    return grow(np.array([f for f, _ in LABELLED], float), np.array([label for _, label in LABELLED]))


def _is_text(features: Features) -> bool:
    node = tree()
    while node.feature >= 0:
        node = node.below if features[node.feature] < node.bound else node.above
    return node.answer


def _cut(tag: str, attributes: str) -> bool:
    """Whether an element is cut, by its tag or by what its attributes call it."""
    if tag in CUT_TAGS:
        return True
    if not attributes or tag in ("body", "html", "main", "article"):
        return False
    for name, value in _NAMED.findall(attributes):
        value = value.strip("\"'").lower()
        if (CUT_ROLES & set(value.split())) if name.lower() == "role" else (CUT_NAMES & set(_NAME_PARTS.split(value))):
            return True
    return bool(_HIDDEN.search(attributes))


@dataclass
class _Reader:
    """State while a page is read."""

    blocks: list[Block] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    kinds: list[tuple[str, int]] = field(default_factory=list)  # open elements that give a kind
    cut: str = ""  # the element that is being cut, and how many of its name are open in it
    depth: int = 0
    link: bool = False

    def add(self, piece: str) -> None:
        if self.cut:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        self.text.append(piece)
        if self.link:
            self.linked.append(piece)

    def close_block(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                linked = len(" ".join(self.linked).split())
                kind = self.kinds[-1][1] if self.kinds else OTHER
                self.blocks.append(Block(" ".join(words), len(words), min(linked / len(words), 1.0), kind))
            self.text, self.linked = [], []

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("article", "main"):
            self.cut = ""
        if self.cut:
            self.depth += tag == self.cut
            return
        if tag in VOID_TAGS:
            return
        if _cut(tag, attributes):
            self.cut, self.depth = tag, 1
        elif tag in BLOCK_TAGS:
            # an open paragraph, heading or item ends with the next block of its kind or with a section
            kind = KINDS.get(tag, OTHER)
            if self.kinds and (kind == self.kinds[-1][1] or self.kinds[-1][1] in (HEADING, PARAGRAPH)):
                self.kinds.pop()
            self.kinds.append((tag, kind))
            del self.kinds[:-64]  # what is open further out no longer matters

    def end(self, tag: str) -> None:
        if self.cut:
            self.depth -= tag == self.cut
            if not self.depth:
                self.cut = ""
        else:
            at = next((k for k in range(len(self.kinds) - 1, -1, -1) if self.kinds[k][0] == tag), None)
            if at is not None:
                del self.kinds[at:]


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    read, at, n = _Reader(), 0, len(page)
    tags, closes = _TAG, True  # closes: whether any ">" follows
    while at < n:
        opening = _OPEN.search(page, at) if closes else None
        if opening is None:
            read.add(page[at:])
            break
        start = opening.start()
        if start > at:
            read.add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            closes = end >= 0
            at = end + 1 if closes else start
            continue
        m = tags.match(page, start)
        if m is None and tags is _TAG:
            closes = page.find(">", start) >= 0
            # no end outside quotes: quotes say nothing any more, so that no later tag is sought to the end again
            if _PLAIN_TAG.match(page, start):
                tags = _PLAIN_TAG
                m = tags.match(page, start)
        if m is None:
            read.add("<")
            at = start + 1
            continue
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCK_TAGS:
            read.close_block()
            read.link = False
        elif tag == "br":
            read.add(" ")
        elif tag == "a":
            read.link = not closing
        if tag in RAW_TAGS:
            if not closing and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
        elif closing:
            read.end(tag)
        else:
            read.start(tag, m[3])
    read.close_block()
    return read.blocks


def features_of(blocks: list[Block]) -> list[Features]:
    sides = [(b.words, b.density) for b in blocks]
    before, after = [(0, 0.0), *sides], [*sides[1:], (0, 0.0)]
    return [Features(b.words, b.density, *left, *right, b.kind) for b, left, right in zip(blocks, before, after)]


def main_text(page: str | None) -> str:
    """Blocks of main text, in page order, with an empty line between them."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, f in zip(blocks, features_of(blocks)) if _is_text(f))


def extracted(pages: Column) -> Column:
    """Main text of a column of pages."""

    @F.arrow_udf(StringType())
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in column.to_pylist()], pa.string())

    return text(pages)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
