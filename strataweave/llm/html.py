"""Main text of web pages from flat text blocks and a decision tree (operator 7).

A page is cut at block-level tags into flat text blocks. Each is described by its word count and link density, by those
of the blocks before and after it, and by tag kinds: whether it is a heading, and whether an element around it (or its
landmark role) is by definition an article or page furniture. Classes and ids aren't read. A decision tree trained on a
small labelled table (:func:`training_blocks`) decides which blocks are main text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import nullable, release

#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style noscript template title svg math iframe object canvas audio video textarea select".split())
#: Elements that part blocks.
PARTING = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and landmark roles, that by definition hold furniture or the article.
FURNITURE = frozenset("nav aside footer form header menu dialog button fieldset".split())
FURNITURE_ROLES = frozenset("navigation complementary contentinfo form banner menu menubar dialog alertdialog alert search button".split())
ARTICLE = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ROLE = re.compile(r"\srole\s*=\s*[\"']?\s*([a-z]+)", re.I)
_HIDES = re.compile(r"\shidden(?:[\s=>/]|\Z)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    #: 1 in an article or main element, 2 in an article inside an article, -1 in furniture, 0 where no element says.
    place: int


def standing(tag: str, attributes: str, outer: int, in_article: bool) -> int:
    """What an element says of its text, where its surroundings say ``outer``."""
    if outer < 0:
        return -1
    role = found[1].lower() if "role" in attributes and (found := _ROLE.search(attributes)) else ""
    if tag in FURNITURE or role in FURNITURE_ROLES:
        return outer if tag == "header" and outer > 0 else -1  # an article's own header holds its title
    if tag in ARTICLE or role in ARTICLE:
        return 2 if in_article and "article" in (tag, role) else max(outer, 1)
    return outer


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    place, heading, links, at = 0, False, 0, 0
    parts: list[tuple[str, bool]] = []

    def close() -> None:
        whole = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if whole:
            linked = sum(len(html.unescape(p).split()) for p, link in parts if link)
            words = len(whole.split())
            out.append(Block(whole, words, min(linked, words), heading, place))
        parts.clear()

    size, skip = len(page), None
    while at < size:
        if skip:
            end = re.compile(rf"</{re.escape(skip)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at, skip = (end.start() if end else size), None
            continue
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in PARTING or tag in HIDDEN:
            close()
        if tag == "a":
            links = 0 if ending else 1
        elif re.fullmatch("h[1-6]", tag):
            heading = not ending
        elif tag == "p":
            heading = False
        if ending:
            if any(t == tag for t, _ in stack):
                while stack:
                    t, place = stack.pop()
                    if t == tag:
                        break
        elif tag in HIDDEN and not m[3].endswith("/"):
            skip = tag
        elif tag not in VOID and tag in PARTING and tag not in ("p", "li", "dd", "dt", "td", "th", "tr", "option") or m[3]:
            if tag in VOID or tag == "head" or m[3].endswith("/"):  # a head's end may be left out, so it says nothing of what follows
                continue
            inner = -1 if _HIDES.search(m[3]) else standing(tag, m[3], place, any(t == "article" for t, _ in stack))
            if tag in ("p", "li", "dd", "dt", "td", "th", "tr", "option", "a") and inner == place:
                continue
            stack.append((tag, place))
            place = inner
    close()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "heading", "place", "page has an article")


def describe(found: list[Block]) -> np.ndarray:
    """FEATURES of each block of a page."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.linked / b.words for b in found), 0], float)
    place = np.array([b.place for b in found], float)
    has = np.full(len(found), float(len(found) > 0 and bool((place > 0).any())))
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], [b.heading for b in found], place, has]).reshape(-1, len(FEATURES))


def training_blocks(pages: int = 400, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: blocks of pages of varied layouts, labelled by the part they came from.

    A third of the pages have no element that says where the article is. Sizes and links vary by part: menus of links or of
    plain words, adverts, notices, footers, forms, bylines, related links, reader comments with their authors' names,
    paragraphs long and short, headings, lists, quotations.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ren", "tas", "u", "vel", "or")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda text: f'<a href="/{word()}">{text}</a>'
    xs, ys = [], []
    for _ in range(pages):
        labelled: dict[str, bool] = {}

        def put(tag: str, text: str, good: bool, kept: dict[str, bool] = labelled) -> str:
            kept[" ".join(re.sub(r"<[^>]*>", "", text).split())] = good
            return f"<{tag}>{text}</{tag.split()[0]}>"

        def listing(linked: bool, most: int) -> str:
            return "<ul>" + "".join(put("li", link(words(1, most)) if linked else words(1, most), False) for _ in range(rng.randint(3, 9))) + "</ul>"

        def paragraph() -> str:
            n = rng.choice(((12, 30), (30, 90), (60, 160), (1, 4), (1, 11)))
            text = words(*n)
            return put("p", f"{text} {link(words(1, 3))} {words(2, 9)}" if rng.random() < 0.2 else f"<b>{text}</b>" if rng.random() < 0.1 else text, True)

        marked = rng.random() < 0.67
        story = put("h1", words(1, 14), True)
        if rng.random() < 0.3:
            story += put("p", words(1, 3) + " " + link(words(1, 2)), False) if not marked else ""
        story += paragraph() if marked else put("p", words(20, 90), True)
        for _ in range(rng.randint(0, 12)):
            story += paragraph()
            if rng.random() < 0.12:
                story += put(rng.choice(("h2", "h3")), words(1, 8), True) + put("p", words(14, 60), True)
            if rng.random() < 0.08:
                story += "<ul>" + "".join(put("li", words(4, 25), True) for _ in range(rng.randint(2, 5))) + "</ul>"
            if rng.random() < 0.06:
                story += put("blockquote", words(8, 40), True)
            if marked and rng.random() < 0.08:
                story += rng.choice((put("aside", words(3, 40), False), f"<form>{put('label', words(1, 5), False)}{put('button', words(1, 2), False)}</form>", f"<nav>{listing(True, 4)}</nav>"))
        if not marked:
            story += put("p", words(15, 80), True)
        advert = lambda: put("div", words(2, 25) if rng.random() < 0.6 else link(words(2, 12)), False)
        notice = lambda: put("div", words(6, 16) + " " + link(words(1, 3)), False)

        def comments(nested: bool = False) -> str:
            out = "" if nested else put("h3", words(1, 3), False)
            for _ in range(rng.randint(1, 4)):
                text = put("div", link(words(1, 2)), False) + put("p", words(2, 12) if not marked else words(2, 60), False)
                out += f"<article>{text}</article>" if nested else text
            return f"<section>{out}</section>"

        menu = listing(rng.random() < 0.8, 3)
        if marked:
            top = rng.choice(("<nav>%s</nav>", "<header>%s</header>", '<div role="navigation">%s</div>', "<div>%s</div>")) % menu + (advert() if rng.random() < 0.5 else "")
            wrap = rng.choice(("<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", '<div role="main">%s</div>', "<article><div><section>%s</section></div></article>"))
            # comments that no element tells from the story stay outside of it
            middle = wrap % (story + comments(nested=True)) if "<article>%s" in wrap and rng.random() < 0.3 else wrap % story
            tail = "".join(rng.sample([f"<aside>{put('p', words(2, 60), False)}</aside>", f"<form>{put('label', words(1, 6), False)}</form>", comments(), notice(), advert()], rng.randint(0, 4)))
            foot = put("footer", "(c) " + words(2, 20), False)
        else:
            top = rng.choice(("<div>%s</div>", "<table><tr><td>%s</td></tr></table>")) % menu + (advert() + listing(True, 5) if rng.random() < 0.3 else "")
            middle = rng.choice(("<div>%s</div>", "<div><div>%s</div></div>", "<section>%s</section>")) % story
            tail = (listing(True, 6) if rng.random() < 0.5 else "") + (comments() if rng.random() < 0.3 else "")
            foot = put("div", "(c) " + words(2, 9), False) + (listing(True, 3) if rng.random() < 0.5 else "")
        found = blocks(f"<html><body>{top}{middle}{tail}{foot}</body></html>")
        for x, b in zip(describe(found), found, strict=True):
            if (y := labelled.get(b.text)) is not None:
                xs.append(x)
                ys.append(y)
    return np.array(xs), np.array(ys)


@dataclass
class Tree:
    """A binary tree as a flat table; ``feature`` -1 marks a leaf, which says ``good``."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    good: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(x) and (inner := self.feature[at] >= 0).any():
            n = at[inner]
            at[inner] = self.child[n] + (x[inner, self.feature[n]] > self.cut[n])
        return self.good[at]


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 6) -> Tree:
    """A classification tree by Gini impurity, grown to ``depth`` with ``least`` rows or more in a leaf."""
    rows: list[list] = [[-1, 0.0, 0, False]]
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        at, part, d = todo.pop()
        good = y[part]
        rows[at][3] = bool(len(good)) and good.mean() >= 0.5
        if d == depth or good.all() or not good.any() or len(part) < 2 * least:
            continue
        best = (1e-9, -1, 0.0)
        whole = good.mean() * (1 - good.mean())
        for f in range(x.shape[1]):
            order = np.argsort(x[part, f], kind="stable")
            v, g = x[part, f][order], np.cumsum(good[order])
            n = np.arange(1, len(part))
            left, right = g[:-1] / n, (g[-1] - g[:-1]) / (len(part) - n)
            gain = whole - (n * left * (1 - left) + (len(part) - n) * right * (1 - right)) / len(part)
            gain[(v[1:] == v[:-1]) | (n < least) | (len(part) - n < least)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float(v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            continue
        rows[at][:3] = [best[1], best[2], len(rows)]
        high = x[part, best[1]] > best[2]
        todo += [(len(rows), part[~high], d + 1), (len(rows) + 1, part[high], d + 1)]
        rows += [[-1, 0.0, 0, False], [-1, 0.0, 0, False]]
    return Tree(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))


_tree: Tree | None = None


def trained_tree() -> Tree:
    global _tree
    if _tree is None:
        _tree = fit_tree(*training_blocks())
    return _tree


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    good = tree.predict(describe(found)) if found else []
    return " ".join(b.text for b, g in zip(found, good, strict=True) if g)


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py() or "", tree) for x in part.column(0)]
                # a reference can name half a surrogate pair; it can't be written in UTF-8
                texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([nullable(part.column(1)), pa.array(texts, pa.string())], names=["row", "text"])
        release()

    return run


def extract(pages: DataFrame, row: Column, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """``(row, text string)`` for each row of ``pages``, in one pass without a shuffle; ``row`` is a struct of what to carry.

    White space in a block is one space, blocks are joined by one space, character references are decoded. Null and
    empty pages, and pages without main text, give the empty text. Broken markup is read as far as it goes.
    Columns outside ``row`` aren't read; repeated rows are carried; an empty table gives no rows.
    """
    rows = pages.select(F.col(html_col).cast("string").alias("html"), row.alias("row"))
    return rows.mapInArrow(_extract(tree or trained_tree()), f"row {rows.schema['row'].dataType.simpleString()}, text string")
