"""Main text of web pages: flat text blocks, shallow features of a block and its neighbours, a trained decision tree.

A page is read once from left to right. Block-level tags end a block; all other tags, line breaks and comments do not, but
<br> counts as white space. End tags that HTML lets out are implied. The content of scripts, styles and the like is skipped.

A block is described by its word count and link density and those of the blocks before and after it. As these alone cannot
tell an advert of ten words from a paragraph of ten, there are marks beside them: whether the block is a heading, where it is
(in an article, in what surrounds one, outside the article that the page marks, or on a page that marks none), and whether an
element around it has a class name, id or role that hints at surroundings, with the words, link density and share of the page
of that element, since wrappers of a whole page have such names as well. A decision tree, trained by Gini impurity on a small
labelled table, says which blocks are main text. The table has the blocks of pages that labelled_pages() makes by a rule, of
several kinds and all sizes; no feature has the last word in it.

Text of a block: character references are decoded, white space becomes one space, ends are trimmed. Kept blocks are
joined by a line feed. Null and empty pages, and pages without main text, give the empty text. Cut-off pages are read as
far as they go: an unfinished tag or comment at the end is dropped, and so is what follows a script, style, title or text
field that never ends; other skipped elements without an end are read on after their start tag, options end at the next tag.
Pages of any length and depth are read in time in proportion to their length. Repeated rows give repeated results; an empty
table gives an empty one; only the id, url and html columns are read, whatever others are called.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML that begin and end a block (a fixed value of the language).
BLOCK = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav noframes ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template title textarea select option iframe object canvas svg annotation annotation-xml video audio".split())
#: Those of them that hold no markup: without an end tag they go on to the end of the page.
RAW = frozenset("script style title textarea".split())
#: Those that are never inside another of their name: a second start tag ends the first.
_SINGLE = frozenset("iframe canvas video audio".split())
#: Elements without an end tag (a fixed value of the language).
VOID = frozenset("area base br col embed frame hr img input link meta source track wbr".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav aside footer form menu dialog button fieldset".split())
#: Elements that hold an article.
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may have no end tag: which open one a start tag ends, and the elements that open ones are not looked for beyond.
_ENDS = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody"}
_GROUPS = ("li", "dd", "tr", "td", "tbody", "p")
_BOUNDS = {
    "li": frozenset("ul ol menu dir table td th caption".split()), "dd": frozenset("dl table td th caption".split()), "tr": frozenset("table tbody thead tfoot".split()), "td": frozenset("table tr tbody thead tfoot".split()),
    "tbody": frozenset(["table"]), "p": frozenset("table td th caption button".split()),
}
_SCOPES = frozenset("table td th caption".split())
#: Words of class names, ids and roles that tell of what surrounds an article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe signup login comment comments reply replies respond disqus discussion form search pagination pager copyright legal tags toolbar complementary contentinfo".split()
)
#: Those of HINTS that tell of readers' comments; an article inside such an element is a comment.
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<close>>|\Z)|(?P<other>[!?/])[^>]*(?:>|\Z))", re.S)
_LOOSE = re.compile(r"<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*)(?P<close>>|\Z)")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[A-Za-z]+")

#: PLACE: 1 in an article, 0 on a page that marks none, -1 outside the one it marks, -2 in what surrounds an article. HINT: 1 if a
#: class name, id or role says so, 2 if it tells of comments; then the words, link density and share of the page's unlinked
#: words of the element that says so, or of the whole page.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading", "hint", "hint_words", "hint_links", "hint_share")
#: Depth of the tree, and rows that a leaf has at least.
DEPTH, LEAF = 12, 4


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: int
    heading: int
    hint: int
    extent: tuple[float, float, float]


def _text(words: int, links: float = 0.0) -> str:
    linked = round(words * links)
    return " ".join(["word"] * (words - linked) + (["<a href=x>" + " ".join(["word"] * linked) + "</a>"] if linked else []))


def labelled_pages(count: int = 600, seed: int = 5) -> Iterator[list[tuple[str, int | None]]]:
    """Small pages as (markup, label of the block in it) in order; None where there is no block.

    Drawn by a rule after the usual make-up of pages: a menu, an advert or notice, a title, paragraphs of any length, a few links
    in them, lists of links among them, readers' comments, a footer; in an article, in plain elements, or in wrappers whose
    names hint at something they are not.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    prose = lambda: int(np.exp(rng.uniform(0, np.log(160))))

    def links(n: int, label: int = 0) -> list:
        return [(f"<li>{_text(int(rng.integers(1, 5)), 1.0)}</li>", label) for _ in range(n)]

    def around() -> list:
        """What is no article: by its element, by its name, or by its looks only."""
        kind = rng.integers(5)
        if kind == 0:
            tag = pick("nav", "aside", "form", "footer")
            return [(f"<{tag}>", None), *links(int(rng.integers(0, 5))), (f"<p>{_text(int(rng.integers(1, 30)), pick(0.0, 0.3, 1.0))}</p>", 0), (f"</{tag}>", None)]
        if kind == 1:
            return [(f"<div class='{pick('ad', 'notice', 'cookie-banner', 'newsletter', 'social share', 'promo')}'>", None), (f"<p>{_text(int(rng.integers(1, 35)), pick(0.0, 0.0, 0.2, 1.0))}</p>", 0), ("</div>", None)]
        if kind == 2:
            return [("<ul>", None), *links(int(rng.integers(3, 7))), ("</ul>", None)]
        if kind == 3:
            return [("<div class='sidebar'>", None), (f"<h3>{_text(2)}</h3>", 0), (f"<p>{_text(int(rng.integers(5, 40)))}</p>", 0), *links(3), ("</div>", None)]
        return [(f"<div>{_text(int(rng.integers(4, 14)), 0.85)}</div>", 0), (f"<div>{_text(int(rng.integers(1, 4)), 1.0)}</div>", 0)]

    def body(marked: bool, least: int = 0) -> list:
        out = []
        while not out or "".join(x for x, _ in out).count("word") < least:
            out = story(marked)
        return out

    def story(marked: bool) -> list:
        out = [(f"<h1>{_text(int(rng.integers(1, 12)), pick(0.0, 0.0, 0.0, 1.0))}</h1>", 1)] if rng.random() < 0.9 else []
        for k in range(int(rng.integers(1, 7))):
            out.append((f"<p>{_text(prose() if marked or k % 2 else max(18, prose()), pick(0.0, 0.0, 0.05, 0.15, 0.3))}</p>", 1))
            draw = rng.random()
            if draw < 0.12:
                out.append((f"<h2>{_text(int(rng.integers(1, 7)))}</h2>", 1))
                out.append((f"<p>{_text(max(15, prose()))}</p>", 1))
            elif draw < 0.2 and marked:
                out += [("<ul>", None), *links(3), ("</ul>", None)]
            elif draw < 0.35:
                out += around()
            elif draw < 0.43 and marked:
                out += [("<ul>", None), *[(f"<li>{_text(int(rng.integers(1, 12)))}</li>", 1) for _ in range(3)], ("</ul>", None)]
        if not marked:
            out.append((f"<p>{_text(max(12, prose()))}</p>", 1))
        return out

    def comments() -> list:
        out = [(f"<div class='{pick('comments', 'replies', 'discussion')}'>", None)]
        for _ in range(int(rng.integers(1, 5))):
            out += [("<article>", None), (f"<p>{_text(prose(), pick(0.0, 0.1))}</p>", 0), ("</article>", None)] if rng.random() < 0.4 else [(f"<p>{_text(prose())}</p>", 0)]
        return [*out, ("</div>", None)]

    for i in range(count):
        kind = i % 4
        page = [x for _ in range(int(rng.integers(0, 3))) for x in around()]
        if kind == 3:
            page = [("<div>", None), *links(int(rng.integers(2, 6))), ("</div>", None)]
        tag = ("article", "main", "div", "div")[kind]
        name = pick("", "", " class='post'", " class='with-sidebar menu-open'", " id='notice-board'", " class='ad-free share-page'")
        least = 60 if name else 0  # what has a misleading name is no small part of its page
        inner = [(f"<div class='{pick('notice-board', 'tags-page', 'ad-layout')}'>", None), *body(True, 60), ("</div>", None)] if kind < 2 and rng.random() < 0.3 else body(kind < 2, least)
        page += [(f"<{tag}{name}>", None), *inner, (f"</{tag}>", None)]
        if kind < 2 and rng.random() < 0.4:
            yield page[-len(inner) - 2 :]  # a page of nothing else
            continue
        if kind < 2 and rng.random() < 0.5:
            page.append((f"<div>{_text(prose())}</div>", 0))
        if rng.random() < 0.4:
            page += comments()
        page += [x for _ in range(int(rng.integers(0, 2))) for x in around()] if kind != 3 else [("<div>", None), *links(2), ("</div>", None)]
        if rng.random() < 0.7:
            page += [("<footer>", None), (f"<p>{_text(int(rng.integers(2, 20)), pick(0.0, 0.5))}</p>", 0), ("</footer>", None)] if kind != 3 else [(f"<div>{_text(int(rng.integers(2, 6)))}</div>", 0)]
        if rng.random() < 0.35:
            page = [(f"<div class='{pick('has-sidebar', 'menu-open page', 'comments-open', 'no-ads')}'>", None), *page, ("</div>", None)]
        yield page


def labelled_table(**size) -> np.ndarray:
    """The labelled table: FEATURES of the blocks of labelled_pages(), and 1 for main text."""
    rows = []
    for page in labelled_pages(**size):
        found = blocks("".join(x for x, _ in page))
        labels = [y for _, y in page if y is not None]
        assert len(found) == len(labels)
        rows.append(np.column_stack([features(found), labels]))
    return np.concatenate(rows)


def train_tree(rows: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> tuple | float:
    """(feature, threshold, at most, above), or the share of main text in a leaf."""
    x, y = rows[:, :-1], rows[:, -1]
    best: tuple | None = None
    if depth and 0 < y.mean() < 1:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            value, mine = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(value[1:] > value[:-1])
            at = at[(at + 1 >= leaf) & (len(y) - at - 1 >= leaf)]
            if not len(at):
                continue
            n, k = at + 1.0, mine[at]
            cost = k - k * k / n + (mine[-1] - k) - (mine[-1] - k) ** 2 / (len(y) - n)
            low = int(cost.argmin())
            if best is None or cost[low] < best[0] - 1e-9:
                best = (float(cost[low]), f, float(value[at[low]] + value[at[low] + 1]) / 2)
    if best is None:
        return float(y.mean())
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, train_tree(rows[low], depth - 1, leaf), train_tree(rows[~low], depth - 1, leaf)


def predict(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    """The tree's shares of main text for rows of features."""
    out = np.empty(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, float):
            out[at] = node
        else:
            low = x[at, node[0]] <= node[1]
            todo += [(node[2], at[low]), (node[3], at[~low])]
    return out


@functools.cache
def default_tree() -> tuple | float:
    return train_tree(labelled_table())


def _hinted(attrs: str) -> int:
    """0 without a hint, 2 if it tells of comments, else 1."""
    if "=" not in attrs:
        return 0
    found = {w.lower() for a in _ATTR.findall(attrs) for w in _WORD.findall(a)}
    return 2 if found & COMMENTS else 1 if found & HINTS else 0


class _Element(NamedTuple):
    """What holds inside an open element: its marks, and the open elements that start tags in it may end (-1 for none)."""

    place: int = 0
    hint: int = 0
    region: int = 0
    heading: int = 0
    scope: int = 0
    open: tuple[int, ...] = (-1,) * len(_GROUPS)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, the empty ones left out."""
    out: list[Block] = []
    names, states, where = [""], [_Element()], {}  # open elements; of each name the places in them
    inside, regions = [0], []  # of each hint the number of the one around it; of each block its number
    link, link_depth, skip, marked = 0, 0, "", False
    endless: set[str] = set()
    parts: list[tuple[str, bool]] = []
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.split()) for t, own in parts if own)
                words, e = len(text.split(" ")), states[-1]
                out.append(Block(text, words, min(words, linked), e.place, e.heading, e.hint, (0.0, 0.0, 0.0)))
                regions.append(e.region)
            parts = []

    def cut(depth: int) -> None:
        """Ends all open elements from a depth on."""
        nonlocal link
        while len(names) > depth:
            where[names.pop()].pop()
            states.pop()
        if link and link_depth > len(names):
            link = 0

    while at < n:
        if skip:
            m = _ends(skip).search(page, at)
            if m:
                at = m.end()
            elif skip in RAW:
                break
            else:
                endless.add(skip)
            skip = ""
            continue
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            parts.append((html.unescape(page[at:tag]) if "&" in page[at:tag] else page[at:tag], link > 0))
        if tag == n:
            break
        m = _TAG.match(page, tag)
        if not m:
            if tag + 1 < n and (page[tag + 1].isascii() and page[tag + 1].isalpha()) or page[tag + 1 : tag + 2] == "/" and page[tag + 2 : tag + 3].isalpha():
                m = _LOOSE.match(page, tag)  # a quote that is never closed
            if not m:
                parts.append(("<", link > 0))
                at = tag + 1
                continue
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if not m["close"] and m.end() == n:
            break
        ending = bool(m["end"])
        if name == "br":
            parts.append((" ", link > 0))
        elif name in SKIPPED:
            if not ending and not m["attrs"].rstrip().endswith("/") and name not in endless:
                skip = name
        elif name == "a":
            link, link_depth = (0, 0) if ending else (1, len(names))
        elif name not in BLOCK:
            continue
        elif ending:
            flush()
            if (own := where.get(name)) and own[-1] >= states[-1].scope:
                cut(own[-1])
        else:
            flush()
            if name != "hr" and name in VOID:
                continue
            if states[-1].open[-1] >= 0 and name not in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "col", "colgroup", "legend", "summary"):
                cut(states[-1].open[-1])
            if name == "hr":
                continue
            if name in _ENDS and (k := states[-1].open[_GROUPS.index(_ENDS[name])]) >= 0:
                cut(k)
            if name in HEADINGS and names[-1] in HEADINGS:
                cut(len(names) - 1)
            e, depth = states[-1], len(names)
            place, hint, region = e.place, e.hint, e.region
            hinted = 0 if name in HEADINGS or name in ("body", "html") else _hinted(m["attrs"])
            if name in INSIDE and place >= 0:
                marked = marked or hint != 2
                place, hint, region = 1, *((hint, region) if hint == 2 else (0, 0))
            elif name in AROUND or name == "header" and place == 0:
                place = -2
            if hinted:
                inside.append(region)
                hint, region = max(hint, hinted), len(inside) - 1
            mine = "p" if name == "p" else _ENDS.get(name)
            opened = tuple(depth if g == mine else -1 if name in _BOUNDS[g] else k for g, k in zip(_GROUPS, e.open, strict=True)) if mine or name in _RESETS else e.open
            names.append(name)
            where.setdefault(name, []).append(depth)
            states.append(_Element(place, hint, region, 1 if name in HEADINGS else e.heading, depth if name in _SCOPES else e.scope, opened))
    flush()
    if marked:
        out = [b._replace(place=-1) if b.place == 0 else b for b in out]
    return _with_extents(out, regions, inside)


_RESETS = frozenset().union(*_BOUNDS.values())


def _with_extents(found: list[Block], regions: list[int], inside: list[int]) -> list[Block]:
    """The blocks with the words, link density and share of the page's unlinked words of the element that has the nearest
    hint, or of the page if none has."""
    words, linked = [0] * len(inside), [0] * len(inside)
    for b, r in zip(found, regions, strict=True):
        words[r] += b.words
        linked[r] += b.linked
    for r in range(len(inside) - 1, 0, -1):
        words[inside[r]] += words[r]
        linked[inside[r]] += linked[r]
    plain = max(1, words[0] - linked[0])
    extents = [(float(w), k / max(1, w), (w - k) / plain) for w, k in zip(words, linked, strict=True)]
    return [b._replace(extent=extents[r]) for b, r in zip(found, regions, strict=True)]


@functools.cache
def _ends(name: str) -> re.Pattern:
    """Where a skipped element ends: after its end tag, or before a tag that cannot be in it."""
    end = rf"</{name}(?=[\s/>])[^>]*>"
    if name in ("option", "select"):
        held = "option|optgroup|hr|br|b|i|em|strong|span|font|img" if name == "select" else "br|b|i|em|strong|span|font|img"
        end += rf"|(?=</?(?!(?:{held})[\s/>])[A-Za-z])"
    elif name in _SINGLE:
        end += rf"|(?=<{name}[\s/>])"
    return re.compile(end, re.I)


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    marks = np.array([(b.place, b.heading, b.hint, *b.extent) for b in found], float).reshape(-1, 6)
    return np.concatenate([own, before, after, marks], axis=1)


def main_texts(pages: list[str | None], tree: tuple | float | None = None) -> list[str]:
    """The main text of each page; the blocks of all are classified at once."""
    found = [blocks(p) if p else [] for p in pages]
    every = [features(b) for b in found if b]
    kept = predict(default_tree() if tree is None else tree, np.concatenate(every)) >= 0.5 if every else np.zeros(0, bool)
    out, at = [], 0
    for own in found:
        out.append("\n".join(b.text for b, keep in zip(own, kept[at : at + len(own)], strict=True) if keep))
        at += len(own)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    tree = default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = main_texts(part.column("html").to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
