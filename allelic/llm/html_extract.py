"""Main text of web pages from flat text blocks.

A page is read once, from left to right, into flat blocks: the text between block-level tags, with its number of words and
the share of them inside links. A decision tree, grown on the small table LABELLED of blocks of example pages, classifies
each block from these two figures and those of its neighbours: the blocks before and after it, and the blocks around them.

Markup decides only what is sure: what stands inside elements and named sections that are never the article (scripts,
menus, forms, footers, adverts, comments; see ASIDE and ASIDE_WORDS) isn't text and makes no block, and neighbours are
counted without it. Where a page marks its article (ARTICLE, ARTICLE_WORDS), the blocks outside aren't text, and neighbours
are counted within it. Everything else is the tree's.

Defined results: null and empty pages give the empty text. Text outside block tags is a block too. Unclosed tags are
closed by the end of what encloses them; unclosed scripts, styles and comments reach to the end of the page; a `<` that
begins no tag, or a tag that never ends, is text. Very long and malformed pages are read whole, in time that grows with
their length. Repeated rows are repeated; columns pass through, but for the page's and those named text and n_chars, which
the results replace.

An empty table gives an empty one. A page's result depends on that page alone, so there are no ties among rows; a block's value
at a split's threshold goes to the lower branch.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_name, ship, small_batches

_NAME = re.compile(r"/?([a-zA-Z][^\s/<>]*)")
#: A quoted value that holds a `>` goes on behind it.
_QUOTES = re.compile(r"""=\s*("[^"]*"?|'[^']*'?)""")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose content is never text of the page.
SILENT = {"script", "style", "head", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "button", "datalist", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end the open one of their kind.
ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Elements and names of classes that enclose what surely isn't the article.
ASIDE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset"}
ASIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "footer", "header", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "disqus", "discussion", "reply", "replies", "share", "sharing", "social", "related", "recommended", "widget", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "contentinfo", "complementary", "tags"}
ARTICLE = {"article", "main"}
ARTICLE_WORDS = {"article", "articlebody", "main", "post", "entry", "story", "content"}


def _split_names(attributes: str) -> set[str]:
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return set(_WORD.split(_HUMP.sub("-", found).lower())) if found else set()


def _tag_end(page: str, at: int, last: int) -> int:
    """Where the tag that opens at a place ends (its `>`), -1 if it never does; a `>` in quotes doesn't count. last: the
    page's last `>`, beyond which there is nothing to look for."""
    end = page.find(">", at) if at < last + 1 else -1
    if end < 0 or ("\"" not in (inside := page[at:end]) and "'" not in inside):
        return end
    pos = at
    while True:
        m = _QUOTES.search(page, pos, end + 1)
        if not m:
            return end
        if m.end() <= end:
            pos = m.end()
            continue
        # the value goes on behind the `>` that was found: to its closing quote, if there is one
        shut = page.find(m[1][0], m.start(1) + 1)
        if shut < 0:
            return end
        end = page.find(">", shut)
        if end < 0:
            return -1
        pos = shut + 1


class _Stack:
    """The open elements, with the places of each name, so that an end tag finds its element at once."""

    def __init__(self):
        self.names: list[str] = []
        self.marks: list[tuple[int, int]] = []  # (in an article, beside it)
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that aren't inline

    def push(self, name: str, inside: int, beside: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.marks.append((inside, beside))

    def top(self) -> tuple[int, int]:
        return self.marks[-1] if self.marks else (0, 0)

    def last(self, name: str) -> int:
        """Place of the innermost element of a name, -1 if none is open."""
        found = self.places.get(name)
        return found[-1] if found else -1

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            name = self.names.pop()
            self.marks.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def count(self, *names: str) -> int:
        return sum(len(self.places.get(n, ())) for n in names)


def blocks(page: str | None) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, in an article, beside it) of each block that has text."""
    out: list = []
    text: list[str] = []
    linked: list[str] = []
    stack = _Stack()
    page = page or ""
    last = page.rfind(">")
    ends: dict[str, int] = {}  # names whose end tag isn't found from some place on
    at = start = 0

    def end_block():
        nonlocal text, linked
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                n = len(body.split())
                out.append((body, n, min(1.0, len(html.unescape(" ".join(linked)).split()) / n), *stack.top()))
        text, linked = [], []

    def add(piece: str):
        if piece:
            text.append(piece)
            if stack.count("a"):
                linked.append(piece)

    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            add(page[start:at])
            shut = page.find("-->", at + 4)
            at = start = shut + 3 if shut >= 0 else len(page)
            continue
        m = _NAME.match(page, at + 1)
        end = _tag_end(page, at + 1, last) if m or page[at + 1 : at + 2] in ("!", "?", "/") else -1
        if end < 0:
            at += 1  # a `<` of the text
            continue
        add(page[start:at])
        tag = at
        at = start = end + 1
        if not m:
            continue
        close, name, attributes = page[tag + 1] == "/", m[1].lower(), page[m.end() : end]
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            if not close:
                end_block()
        if not close:
            if name in SILENT:
                if not attributes.rstrip().endswith("/") or name in ("script", "style"):
                    at = start = _silence(page, name, at, ends)
                continue
            if name in VOID:
                continue
            if name in ENDING:
                # its like ends, if no other block stands between
                place = stack.last(name)
                if place >= 0 and stack.block() == place:
                    stack.cut(place)
            inside, beside = stack.top()
            names = _split_names(attributes) if attributes else set()
            if name in ARTICLE or (names & ARTICLE_WORDS and not names & ASIDE_WORDS):
                inside = 1
            if (name in ASIDE and not (name == "header" and inside)) or (name != "body" and names & ASIDE_WORDS) or (attributes and _HIDDEN.search(attributes)):
                beside = 1
            stack.push(name, inside, beside)
        else:
            place = stack.last(name)
            if name in INLINE:
                if place > stack.block():  # an inline end tag doesn't close blocks
                    stack.cut(place)
            else:
                end_block()
                if place >= 0:
                    stack.cut(place)
    add(page[start:])
    end_block()
    return out


def _silence(page: str, name: str, at: int, ends: dict[str, int]) -> int:
    """Where a silent element that opened before a place ends."""
    if ends.get(name, len(page) + 1) <= at:
        return len(page)
    shut = re.compile(rf"</{re.escape(name)}(?![a-z0-9])", re.I).search(page, at)
    if shut:
        end = page.find(">", shut.end())
        return end + 1 if end >= 0 else len(page)
    if name == "head":  # one that is never closed ends where the body begins
        body = re.compile(r"(?=<body\b)", re.I).search(page, at)
        if body:
            return body.start()
    ends[name] = at
    return len(page)


NAMES = ("words", "link density", "words before", "link density before", "words after", "link density after", "words of five around", "link density of five around")


def features(found: list) -> np.ndarray:
    """The figures of each block and its neighbours, which are 0 beyond the ends."""
    n = np.array([b[1] for b in found], float)
    linked = n * np.array([b[2] for b in found], float)
    x = np.zeros((len(found), len(NAMES)))
    if not len(found):
        return x
    density = linked / n
    x[:, 0], x[:, 1] = n, density
    x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = n[:-1], density[:-1], n[1:], density[1:]
    around = lambda v: np.convolve(np.pad(v, 2), np.ones(5), "valid")
    x[:, 6], x[:, 7] = around(n), around(linked) / around(n)
    return x


def candidates(found: list) -> list:
    """The blocks that the tree judges: those beside an article aren't text, nor those outside a marked one."""
    found = [b for b in found if not b[4]]
    marked = [b for b in found if b[3]]
    return marked or found


def _w(n: int) -> str:
    return " ".join(["word"] * n)


def _a(*n: int) -> str:
    return "".join(f"<li><a href='#'>{_w(k)}</a></li>" for k in n)


def _p(*n: int) -> str:
    return "".join(f"<p>{_w(k)}</p>" for k in n)


#: Small labelled pages, without class names: fragments with 1 for the article's text and 0 for the rest. Short lines are
#: text between paragraphs and aren't among links or alone at the ends; so the neighbours tell.
LABELLED = [
    [(f"<ul>{_a(1, 1, 2, 1, 1)}</ul>", 0), (f"<h1>{_w(8)}</h1>{_p(120, 45, 1, 60, 4, 38)}", 1), (f"<ul>{_a(2, 1, 3)}</ul>", 0)],
    [(f"<ul>{_a(1, 2, 1)}</ul>", 0), (f"<h1>{_w(5)}</h1>{_p(30)}<h2>{_w(2)}</h2><ul><li>{_w(6)}</li><li>{_w(3)}</li></ul>{_p(80)}", 1), (f"<ul>{_a(5, 6, 5, 4)}</ul>", 0)],
    [(f"<ul>{_a(1, 1, 1, 2)}</ul>{_p(3)}<ul>{_a(2, 2)}</ul>", 0), (f"<h1>{_w(7)}</h1>{_p(50, 70, 18)}", 1), (f"<p><a>{_w(3)}</a></p><p><a>{_w(4)}</a> {_w(1)}</p>{_p(2)}<p><a>{_w(2)}</a></p>", 0)],
    [(f"<div>{_w(2)}</div><div><a>{_w(2)}</a> | <a>{_w(1)}</a></div><div><a>{_w(1)}</a></div>", 0), (f"<h1>{_w(9)}</h1><p>{_w(34)}</p><p>{_w(21)} <a>{_w(2)}</a> {_w(30)}</p>{_p(90, 12, 40)}", 1), (f"<div><a>{_w(3)}</a></div><div>{_w(4)}</div><div><a>{_w(2)}</a></div><div><a>{_w(2)}</a></div>", 0)],
    [(_p(15, 2) + f"<p><a>{_w(3)}</a></p>" + _p(41, 11, 70), 1), (f"<ul>{_a(5, 6, 5)}</ul>", 0)],
    [(_p(25, 1, 16, 60, 2, 33), 1), (f"<ul>{_a(1, 2, 1)}</ul>{_p(3)}<ul>{_a(2, 1)}</ul>", 0)],
    [(f"<ul>{_a(3, 2, 4)}</ul>", 0), (_p(8, 9, 55, 3, 21), 1), (f"<p><a>{_w(6)}</a></p><p><a>{_w(5)}</a></p>", 0)],
    [(f"<h1>{_w(6)}</h1>{_p(14, 9, 31, 5)}<blockquote>{_w(3)}</blockquote>{_p(48)}", 1)],
    [(_p(5, 3, 20, 6, 2, 4, 44), 1)],
    [(f"<h1>{_w(4)}</h1>{_p(12, 9)}", 1)],
    [(f"<h1>{_w(3)}</h1>{_p(22)}", 1)],
    [(f"<h1>{_w(2)}</h1>", 1)],
    [(_p(40), 1)],
    [(_p(1), 1)],
    [(_p(3, 2), 1)],
    [(f"<p>{_w(3)}</p><ul><li>{_w(4)}</li><li>{_w(5)}</li><li>{_w(2)}</li></ul>", 1)],
    [(f"<p>{_w(14)} <a>{_w(9)}</a></p>" + _p(30) + f"<p><a>{_w(4)}</a> {_w(6)}</p>" + _p(26), 1)],
    [(f"<p><a>{_w(2)}</a></p><p><a>{_w(3)}</a></p>{_p(2)}<p><a>{_w(1)}</a></p><p><a>{_w(2)}</a></p>", 0), (_p(36, 5, 52), 1), (f"<p><a>{_w(2)}</a></p>{_p(1)}<p><a>{_w(3)}</a></p><p><a>{_w(3)}</a></p>", 0)],
    [(f"<ul>{_a(4, 3)}</ul>{_p(4)}<ul>{_a(6, 2, 2)}</ul>", 0), (f"<h2>{_w(6)}</h2>{_p(64, 2, 28)}<p><a>{_w(5)}</a></p>{_p(33)}", 1)],
]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of all blocks of LABELLED."""
    xs, ys = [], []
    for page in LABELLED:
        x = features(blocks("".join(f for f, _ in page)))
        y, before = [], 0
        for i, (_, label) in enumerate(page):  # a fragment's blocks are those that it adds
            n = len(blocks("".join(f for f, _ in page[: i + 1])))
            y += [label] * (n - before)
            before = n
        xs.append(x)
        ys.append(np.array(y))
    return np.concatenate(xs), np.concatenate(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: (feature, cut, tree below or at it, tree above it), or a leaf's label."""
    if depth == 0 or len(set(y)) < 2:
        return int(2 * y.sum() >= len(y))
    best = (1e9, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            impurity = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if impurity < best[0] - 1e-9:
                best = (impurity, f, float(cut))
    if best[0] == 1e9:
        return int(2 * y.sum() >= len(y))
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def described(tree, indent: str = "") -> str:
    """The tree as text."""
    if isinstance(tree, int):
        return f"{indent}{'text' if tree else 'not text'}\n"
    return f"{indent}{NAMES[tree[0]]} <= {tree[1]:g}\n{described(tree[2], indent + '  ')}{indent}else\n{described(tree[3], indent + '  ')}"


def main_text(page: str | None, tree) -> str:
    found = candidates(blocks(page))
    return " ".join(b[0] for b, row in zip(found, features(found).tolist(), strict=True) if classify(tree, row))


def extract(pages: DataFrame, tree=None, column: str = "html") -> DataFrame:
    """pages with text and n_chars instead of the html."""
    small_batches(pages.sparkSession)
    tree = grow(*labelled()) if tree is None else tree
    names = [c for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")]
    quoted = [f"`{c}`" for c in names]
    schema = pages.limit(0).selectExpr(*quoted, "cast(null as string) as text", "cast(null as long) as n_chars").schema
    source = free_name(names, "_html")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(source).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.selectExpr(*quoted, f"`{column}` as `{source}`").mapInArrow(run, schema)


ship(__name__)
