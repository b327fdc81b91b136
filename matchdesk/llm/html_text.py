"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. Per path the text length and the
punctuation are summed and divided by the number of nodes of that path, links
counting against it; the two ratios are smoothed over neighbouring nodes in page
order, fused by their product, and paths above a threshold taken from the page's
own spread are content. Paths through elements that never hold the article (menus, forms,
scripts, side matter, adverts, comments) have ratio zero, and a path's ratio is
fused with that of its container, so short paragraphs stand or fall with the column
of text that they belong to. ``article`` and ``main`` are a feature of the container's
ratio: blocks inside share it, a heading or lead before a nested one is fused with the
nested one's, and containers outside count half. The threshold holds on every page.

Side matter is known by its element or by whole words of its class, id or role. Such a mark
is ignored on an element that holds nearly all text of the page, words after a modifier
(``has-sidebar``) are none, and headers inside ``article`` and ``main`` are not set aside. Any
markup can be read; paths are kept as numbers, so deep nesting costs no more per element.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option button iframe object svg canvas title head".split())
SIDE = frozenset("nav footer aside form menu dialog".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
CLOSES_P = BLOCK - {"br"}
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
CONTENT = frozenset(["article", "main"])
NEARLY_ALL = 0.9  # of the text that no element sets aside: a mark on so much says nothing
# words of class, id and role values that mark side matter, in a name of several words too
MARKS = frozenset("""ad ads advert adverts advertisement advertising advertisements sponsor sponsored sponsors promo promos promotion
banner nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices
newsletter subscribe subscription signup login share sharing social related recommended recommendations widget popup modal comment
comments commentlist disqus replies respond search pagination pager copyright legal disclaimer contentinfo complementary hidden skip
toolbar metabar""".split())
MODIFIERS = frozenset("has have no non not with without is show hide toggle enable disable js".split())  # has-sidebar is no sidebar
SIDEWAYS = frozenset("side left right bar column col nav menu panel rail".split())  # side-column, but not side-by-side
HEADINGS = frozenset("entry post article story content section card chapter".split())  # their headers hold the title
WORD = re.compile(r"[A-Za-z]+")


def marked(names: str, in_content: bool) -> tuple[bool, bool]:
    """Whether class, id and role values mark side matter, and whether as reader comments."""
    side = comments = False
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in MODIFIERS:
            continue
        has = MARKS.intersection(words)
        side |= bool(has) or ("side" in words and SIDEWAYS.issuperset(words))
        side |= "header" in words and not in_content and not HEADINGS.intersection(words)
        comments |= bool(has & {"comments", "commentlist", "disqus", "replies", "respond"})
    return side, comments


PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
IMPLIED = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
           "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


class _Open:
    """An open element. Paths and containers are numbers of nodes in a tree of labels, marks are
    numbers of marked elements; each element has what holds for all inside it, so nothing
    is gathered along the stack."""

    __slots__ = ("tag", "path", "outer", "holder", "side", "mark", "in_content", "rank")


class _Blocks(HTMLParser):
    """Text blocks of a page in order: [path, container, text, link length, side matter by
    element, innermost mark, rank of the article or main that holds it: 0 none, 1 marked as side matter, 2 unmarked]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        root = _Open()
        root.tag, root.path, root.outer, root.holder, root.side, root.mark, root.in_content, root.rank = "", 0, 0, None, False, -1, False, 0
        self.stack: list[_Open] = [root]
        self.nodes: dict[tuple[int, str], int] = {}
        self.holders: dict[int, int | None] = {}  # path of an article or main -> that of the one around it
        self.marks: list[tuple[int, bool]] = []   # mark around it, reader comments
        self.open: Counter = Counter()
        self.blocks: list[list] = []
        self.text: list[str] = []
        self.link = 0
        self.raw = self.links = 0  # open raw elements and links

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i + 3)  # in HTML a comment, whatever it says
        return -1 if end < 0 else end + 1

    def flush(self):
        if not self.text:
            return
        text = " ".join("".join(self.text).split())
        if text:
            top = self.stack[-1]
            box = top.outer if top.holder is None else top.holder
            self.blocks.append([top.path, box, text, self.link, top.side, top.mark, top.rank])
        self.text, self.link = [], 0

    def _pop(self, k: int):
        for e in self.stack[k:]:
            self.raw -= e.tag in RAW
            self.links -= e.tag == "a"
            self.open[e.tag] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P and self.open["p"]:  # an open paragraph ends where a block begins
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == "p":
                    self._pop(k)
                    break
                if self.stack[k].tag in BLOCK:
                    break
        same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
        if tag in IMPLIED and any(self.open[t] for t in same):  # an open item ends where the next one begins
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in IMPLIED[tag]:
                    break
                if self.stack[k].tag in same:
                    self._pop(k)
                    break
        around, e = self.stack[-1], _Open()
        label, side, comments = tag, False, False
        if attrs:
            named = {k: v or "" for k, v in attrs}
            side, comments = marked(" ".join(named[k] for k in ("class", "id", "role") if k in named), around.in_content)
            side |= "hidden" in named
            label += "".join(f".{c}" for c in named.get("class", "").split())
        if tag == "header" and not around.in_content:
            side = True
        e.tag, e.in_content = tag, around.in_content or tag in CONTENT
        inline = tag in INLINE
        e.path = around.path if inline else self.nodes.setdefault((around.path, label), len(self.nodes) + 1)
        e.outer = around.outer if inline else around.path or e.path
        e.side = around.side or tag in SIDE or tag in RAW
        e.mark, e.holder, e.rank = around.mark, around.holder, around.rank
        if tag in CONTENT:
            self.holders[e.path] = around.holder
            e.holder, e.rank = e.path, 1 if side or around.rank == 1 else 2
        elif side and tag not in ("html", "body"):
            self.marks.append((around.mark, comments))
            e.mark = len(self.marks) - 1
        self.raw += tag in RAW
        self.links += tag == "a"
        self.open[tag] += 1
        self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash does not close an element of HTML
        if tag in RAW:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._pop(k)
                return
            if tag in INLINE and self.stack[k].tag in BLOCK:
                return  # an inline end tag does not close a block

    def ignored_marks(self) -> list[bool]:
        """Marks that hold for nothing: their element has nearly all text of the page. Reader
        comments stay marked however long they are."""
        text = [0] * len(self.marks)
        total = 0
        for _, _, t, _, side, mark, _ in self.blocks:
            if not side:
                total += len(t)
                if mark >= 0:
                    text[mark] += len(t)
        for k in range(len(self.marks) - 1, -1, -1):
            if self.marks[k][0] >= 0:
                text[self.marks[k][0]] += text[k]
        return [not comments and n >= NEARLY_ALL * total for n, (_, comments) in zip(text, self.marks)]

    def handle_data(self, data):
        if self.raw:
            return
        self.text.append(data)
        if self.links:
            self.link += len(data.strip())


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian window of three nodes to each side."""
    k = np.exp(-np.arange(-3, 4) ** 2 / 2.0)
    pad = np.concatenate([np.repeat(x[:1], 3), x, np.repeat(x[-1:], 3)])
    return np.convolve(pad, k / k.sum(), "valid")


def main_text(html: str | None) -> str:
    """Main text of one page: chosen blocks in page order, one per line."""
    if not html:
        return ""
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    blocks = p.blocks
    if not blocks:
        return ""
    ignored = p.ignored_marks()
    inherited: list[bool] = []  # whether a mark or one around it holds
    for k, (around, _) in enumerate(p.marks):
        inherited.append(not ignored[k] or around >= 0 and inherited[around])
    # path, container, text, link length, side matter, rank
    blocks = [[*b[:4], b[4] or b[5] >= 0 and inherited[b[5]], b[6]] for b in blocks]
    length = np.array([0.0 if b[4] else max(0, len(b[2]) - 2 * b[3]) for b in blocks])
    points = np.array([0.0 if b[4] else len(PUNCTUATION.findall(b[2])) for b in blocks])

    def ratio(of: int, x: np.ndarray) -> np.ndarray:
        names = {n: i for i, n in enumerate(dict.fromkeys(b[of] for b in blocks))}
        at = np.array([names[b[of]] for b in blocks])
        return (np.bincount(at, x) / np.bincount(at))[at]

    # paths, then their containers: mean text and mean punctuation per node
    path_text, path_point = _smooth(ratio(0, length)), _smooth(ratio(0, points))
    box_text, box_point = ratio(1, length), ratio(1, points)
    side = np.array([b[4] for b in blocks])
    rank = np.array([0 if b[4] or not box_text[k] else b[5] for k, b in enumerate(blocks)])
    inside = (rank == rank.max()) & (rank > 0)
    if inside.any():  # containers outside article and main count half
        weight = np.where(inside, 1.0, 0.5)
        box_text, box_point = box_text * weight, box_point * weight
    fused = (path_text + box_text) * (1.0 + path_point + box_point)
    open_ = fused[~side]
    if not len(open_) or open_.max() <= 0:
        return ""
    limit = min(open_.std(), 0.5 * open_.max())
    score = fused.copy()
    if inside.any():
        members: dict[int, list[int]] = {}
        for k in np.flatnonzero(inside):
            members.setdefault(blocks[k][1], []).append(k)
        # half the text and half the punctuation of the heaviest container will do
        heavy = max(members.values(), key=lambda m: length[m].sum())
        limit = min(limit, 0.25 * fused[heavy].mean())
        # of the containers inside a container the greatest ratios; inner ones have greater numbers
        inner: dict[int, tuple[float, float]] = {}
        for box in sorted(p.holders, reverse=True):
            here = inner.get(box, (0.0, 0.0))
            if box in members:
                k = members[box][0]
                here = max(here[0], box_text[k]), max(here[1], box_point[k])
            if p.holders[box] is not None and here != (0.0, 0.0):
                up = inner.get(p.holders[box], (0.0, 0.0))
                inner[p.holders[box]] = max(up[0], here[0]), max(up[1], here[1])
        for box, m in members.items():
            score[m] = np.maximum(fused[m], fused[m].mean())
            if box in inner:  # a heading or lead belongs to the text that follows
                more = [k for k in m if length[k] > 0]
                lifted = ((path_text[more] + max(inner[box][0], box_text[m[0]]))
                          * (1.0 + path_point[more] + max(inner[box][1], box_point[m[0]])))
                score[more] = np.maximum(score[more], lifted)
    keep = (score >= limit) & ~side & ((length > 0) | inside)
    return "\n".join(b[2] for b, k in zip(blocks, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, url, html = batch.columns
        text = [main_text(h.as_py()) for h in html]
        yield pa.RecordBatch.from_arrays(
            [key, url, pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null, empty and text-free pages give an empty text. Null ids and urls pass
    through; repeated rows give repeated results; other columns are not read. Broken
    markup is read as browsers do in the common cases (open paragraphs and items end
    where the next begins, stray end tags are ignored).
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
