"""Main text of web pages by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags) with the elements around them.  A logistic classifier,
trained here on generated pages whose blocks are known, gives each block a cost of being content and of being boilerplate;
these are the capacities of its edges to the two terminals.  Neighbours in page order, and blocks next to each other under
the same element, are joined by smoothness edges that weaken with their distance in the tree.  The maximum flow separates
content from boilerplate at the least total cost.

Pages are independent: there is no shuffle, and a task holds one batch.  Reading is linear in the page, however deep its
elements are nested, and the graph has two smoothness edges per block.

Edge cases: null and empty html, and pages without text, give an empty text; broken or unclosed markup is read as far as it
goes; a head ends where HTML says so, also without its end tag; character references are decoded, also without their
semicolon where HTML allows that; classes of html, body and of an element around the whole page do not decide about its text; white space is what Unicode calls so, no-break spaces too; repeated rows are extracted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm import _labels, _session, _text

NAME = "op3_html"
ORACLE_SQL = None

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Smoothness between neighbours in page order and under one element, before it weakens with tree distance.
ORDER_WEIGHT, SIBLING_WEIGHT, FADE = 1.0, 0.8, 0.5

# Fixed names of HTML elements and of common classes.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title svg iframe object canvas select textarea datalist audio video map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Start tags that may stand in a head; any other, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements beyond which an end tag or an implied end does not reach.
SCOPES = frozenset("table ul ol dl article section nav aside div main body header footer form blockquote".split())
ENDS_P = BLOCKS - {"body", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "li", "dd", "dt"}

#: What the elements around a block say, as bits; by tag, and by words in class, id and role.
FLAGS = ["article", "main", "nav", "header", "footer", "aside", "advert", "comment", "form", "notice", "related", "heading", "list", "table", "quote", "hidden"]
_BIT = {name: 1 << k for k, name in enumerate(FLAGS)}
BY_TAG = {"article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice", "ul": "list", "ol": "list", "dl": "list", "table": "table", "blockquote": "quote"}
BY_TAG |= {f"h{k}": "heading" for k in range(1, 7)}
BY_WORD = {
    "article": "article post entry story content body text maintext articlebody",
    "main": "main",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc toolbar topbar tabs skip",
    "header": "header masthead banner branding logo",
    "footer": "footer copyright colophon legal bottom",
    "aside": "aside sidebar side rail complementary widget widgets tags meta byline",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense adslot banner-ad",
    "comment": "comment comments commentlist discussion disqus reply replies respond feedback reader-comments",
    "form": "form search login signup subscribe subscription newsletter",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning dialog toast banner-notice",
    "related": "related recommended recommendations share sharing social more popular trending teaser links",
    "hidden": "hidden sr-only visually-hidden",
}
#: Pieces of a class name that tell the state of a page, not what the element is, as in ``no-sidebar`` or ``menu-open``.
STATES = frozenset("no not non has have with without is are on off open opened closed enabled disabled ready active loaded layout template theme".split())
_WORDS = {word: _BIT[flag] for flag, words in BY_WORD.items() for word in words.split()}

# Possessive, so that broken markup is never tried in more than one way.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<[!?][^>]*+>", re.S)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PIECES = re.compile(r"[^a-z]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    element: int  # the nearest block-level element around it; 0 is the page
    flags: int
    tag: str


class Page(NamedTuple):
    """A page's blocks in order, and the tree of its block-level elements: parent and depth of each, by number."""

    blocks: list[Block]
    parents: list[int]
    depths: list[int]


@lru_cache(maxsize=4096)
def _flags_of(tag: str, attributes: str) -> int:
    """The bits of one element."""
    bits = _BIT[BY_TAG[tag]] if tag in BY_TAG else 0
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for word in value.split():
                bits |= _WORDS.get(word, 0)
                pieces = _PIECES.split(word)
                if word not in _WORDS and STATES.isdisjoint(pieces):
                    for piece in pieces:
                        bits |= _WORDS.get(piece, 0)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            bits |= _BIT["hidden"]
    return bits


def read(page: str) -> Page:
    """The blocks of text of a page and the elements around them.

    Every tag costs a constant: where the open elements of a tag are, and where the nearest scope is, is kept in lists, and
    an element is opened and closed once.  Words of a button count inside a paragraph only.
    """
    found: list[Block] = []
    parents, depths, own = [0], [0], [0]
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, block-level element, bits of the inline elements in it
    places: dict[str, list[int]] = {}  # where in the stack a tag is open
    scopes: list[int] = [0]  # where in the stack scopes are open
    parts: list[str] = []
    linked = unseen = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, element, bits = stack[-1]
                found.append(Block(text, min(linked, len(text)), element, bits, tags[element]))
            linked = 0

    def pop() -> None:
        nonlocal unseen
        tag = stack.pop()[0]
        places[tag].pop()
        unseen -= tag in UNSEEN or tag == "button" and hidden_buttons.pop()
        if scopes[-1] == len(stack):
            scopes.pop()

    def end(names: tuple[str, ...], through_scopes: bool = False) -> None:
        """Close the nearest element of these tags, unless a scope lies between."""
        place = max((places[t][-1] for t in names if places.get(t)), default=0)
        if place and (through_scopes or scopes[-1] <= place):
            while len(stack) > place:
                pop()

    tags = [""]
    hidden_buttons: list[bool] = []
    if "<!--" not in page[page.rfind(">") + 1 :]:  # a tag that the page breaks off in is no text
        cut = _UNFINISHED.search(page, page.rfind(">") + 1)
        page = page[: cut.start()] if cut else page
    stop_at = len(page)
    while at < stop_at:
        m = _TAG.search(page, at)
        stop = m.start() if m else stop_at
        if stack[-1][0] == "head" and page[at:stop].strip():
            pop()
        if stop > at and not unseen:
            parts.append(page[at:stop])
            linked += (stop - at) * bool(places.get("a"))
        if m is None:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            end((tag,), tag in SCOPES)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop()
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                end(("p",))
            if tag in CLOSES:
                end(CLOSES[tag])
        if tag in VOID:
            continue
        if tag in RAW:
            close = _RAW_ENDS[tag].search(page, at)
            at = close.end() if close else stop_at
            continue
        if unseen and tag == "body":  # something in the head that was never closed
            while len(stack) > 1 and unseen:
                pop()
        element, inline, bits = stack[-1][1], stack[-1][2], _flags_of(tag, m[3])
        if tag in BLOCKS:
            parents.append(element)
            depths.append(depths[element] + 1)
            tags.append(tag)
            own.append(0 if tag in ("html", "body") else bits)
            element, bits = len(parents) - 1, inline
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append((tag, element, inline | bits))
        if tag == "button":
            hidden_buttons.append(not places.get("p"))
        unseen += tag in UNSEEN or tag == "button" and hidden_buttons[-1]
    flush()
    around = _around(found, parents, tags, own)
    return Page([b._replace(flags=b.flags | around[b.element]) for b in found], parents, depths)


def _around(found: list[Block], parents: list[int], tags: list[str], own: list[int]) -> list[int]:
    """The bits of each element and those around it.

    What an element's name says against its text does not count if the element is the frame of the page: it holds the first main element (or
    else first heading, or article) and at least half of the text, or, on a page without any of these, nearly all of it.
    """
    size = [0] * len(parents)
    for b in found:
        size[b.element] += len(b.text)
    for k in range(len(parents) - 1, 0, -1):  # an element comes after its parent
        size[parents[k]] += size[k]
    core = next((k for tag in ("main", "h1", "article") for k in [tags.index(tag) if tag in tags else 0] if k), 0)
    frames = {0}
    k = parents[core]
    while k:
        frames.add(k)
        k = parents[k]
    around = [0]
    for k in range(1, len(parents)):
        framing = k in frames and 2 * size[k] >= size[0] or not core and 10 * size[k] >= 9 * size[0] and tags[k] not in BY_TAG
        around.append(around[parents[k]] | (own[k] & ~_AGAINST if framing else own[k]))
    return around


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    return read(page).blocks


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees of each block."""
    rows = []
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        link = b.linked / len(b.text)
        stops = sum(b.text.count(c) for c in ".!?,;")
        rows.append([
            *((b.flags >> j) & 1 for j in range(len(FLAGS))), math.log1p(words) / 3, link, min(1.0, 4 * stops / words), b.text[-1] in ".!?\"'”»…",
            b.tag == "p", b.tag == "li", b.tag in ("td", "th"), b.tag == "div", k == 0, k == len(found) - 1, words < 4, link > 0.5, "©" in b.text[:40],
            (b.flags & 3 != 0) and not b.flags & _OFF,
        ])
    return np.array(rows, dtype=np.float64).reshape(len(found), N_FEATURES)


_OFF = sum(_BIT[n] for n in ("nav", "footer", "aside", "advert", "comment", "form", "notice", "related", "hidden"))
_AGAINST = _OFF | _BIT["header"]
N_FEATURES = len(FLAGS) + 14


def generated(rng: random.Random) -> tuple[str, list[bool]]:
    """A page with what a site puts around an article, and for each block whether it belongs to the article."""
    out: list[str] = []
    truth: list[bool] = []
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: (words(4, 16) + rng.choice([".", ".", ".", "!", "?"])).capitalize()
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))

    def say(text: str, content: bool) -> str:
        truth.append(content)
        return text

    if rng.random() < 0.08:  # nothing but the text, with little or no markup
        text = say(prose(1, 4), True)
        return rng.choice([text, f"<p>{text}", f"<html><body>{text}</body></html>", f"<html><body><div><p>{text}</p></div></body></html>"]), truth

    def wrap(tag: str, names: list[str], inner: str) -> str:
        style = rng.random()
        if style < 0.4 and tag:
            return f"<{tag}>{inner}</{tag}>"
        attribute = rng.choice(["class", "id"]) if style < 0.9 else "role"
        return f'<{"div" if style < 0.75 or not tag else tag} {attribute}="{rng.choice(names)}">{inner}</{"div" if style < 0.75 or not tag else tag}>'

    def items(content: bool, linked: bool, short: bool = True) -> str:
        one = lambda: say(f'<li><a href="/x">{words(1, 4)}</a></li>' if linked else f"<li>{words(2, 6) if short else prose(1, 2)}</li>", content)
        return "<ul>" + "".join(one() for _ in range(rng.randint(2, 7))) + "</ul>"

    plain = lambda content, a=1, b=3: say(f"<{(t := rng.choice(['p', 'p', 'div']))}>{prose(a, b)}</{t}>", content)
    nav = lambda: wrap("nav", ["nav", "menu", "navbar", "site-navigation", "breadcrumbs"], items(False, True))
    advert = lambda: wrap("", ["ad", "advert", "sponsored", "promo", "ads"], say(prose(1, 3), False))
    notice = lambda: wrap("", ["cookie-notice", "notice", "consent", "alert", "popup"], plain(False, 1, 2))
    side = lambda: wrap("aside", ["sidebar", "widget", "related", "side"], say(f"<h3>{words(1, 3)}</h3>", False) + (items(False, True) if rng.random() < 0.6 else plain(False, 1, 3)))
    form = lambda: wrap("form", ["search", "newsletter", "login-form", "subscribe"], say(f"<label>{words(1, 4)}</label>", False) + "<input>")
    comments = lambda: wrap("section", ["comments", "comment-list", "discussion", "reader-comments"], say(f"<h3>{words(1, 2)}</h3>", False) + "".join(f'<div class="{rng.choice(["comment", "reply", "comment-body"])}">{plain(False, 1, 4)}</div>' for _ in range(rng.randint(1, 5))))
    share = lambda: wrap("", ["share", "social", "related", "tags"], items(False, True))

    def article() -> str:
        inner = say(f"<h1>{words(2, 9)}</h1>", True) if rng.random() < 0.9 else ""
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.7:
                inner += say(f"<p>{prose(1, 6) if rng.random() < 0.85 else words(1, 4)}</p>", True)
            elif kind < 0.76:
                inner += say(f"<h2>{words(1, 6)}</h2>", True)
            elif kind < 0.81:
                inner += items(True, False, short=rng.random() < 0.5)
            elif kind < 0.85:
                inner += f"<blockquote>{plain(True)}</blockquote>"
            elif kind < 0.88:
                inner += "<table><tr>" + "".join(say(f"<td>{words(1, 5)}</td>", True) for _ in range(3)) + "</tr></table>"
            elif kind < 0.89:
                inner += say(f"<p>{prose(1, 1)}</p>", True) + items(True, True)
            elif kind < 0.92:
                inner += say(f'<p>{prose(1, 2)} <a href="/y">{words(1, 3)}</a> {sentence()}</p>', True)
            elif kind < 0.96:
                inner += advert()
            else:
                inner += rng.choice([share, form, notice])()
        return rng.choice([
            lambda x: f"<article>{x}</article>", lambda x: f"<main>{x}</main>", lambda x: f"<main><article>{x}</article></main>", lambda x: f'<div class="{rng.choice(["content", "post", "entry-content", "article-body"])}">{x}</div>', lambda x: f"<div>{x}</div>", lambda x: x,
        ])(inner)

    for part, chance in ((lambda: wrap("header", ["header", "masthead", "banner"], say(f"<div>{words(1, 5)}</div>", False) + (nav() if rng.random() < 0.5 else "")), 0.5), (nav, 0.7), (notice, 0.3), (form, 0.3), (advert, 0.4), (side, 0.3), (article, 1.0), (share, 0.3), (comments, 0.4), (side, 0.4), (advert, 0.3), (form, 0.2)):
        if rng.random() < chance:
            out.append(part())
    if rng.random() < 0.85:
        out.append(wrap("footer", ["footer", "site-footer", "copyright", "legal"], say(f"<p>&copy; {words(1, 3)} &middot; {prose(1, 2)}</p>" if rng.random() < 0.7 else f"<p>{words(2, 9)}</p>", False) + (items(False, True) if rng.random() < 0.4 else "")))
    return f"<html><head><title>t</title></head><body>{''.join(out)}</body></html>", truth


@lru_cache(maxsize=1)
def classifier(pages: int = 500, seed: int = 5) -> np.ndarray:
    """Weights of the block classifier, trained on generated pages; the last is the intercept."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, truth = generated(rng)
        found = blocks(page)
        if len(found) == len(truth):
            xs.append(features(found))
            ys += truth
    y = np.array(ys, dtype=np.float64)
    return _labels.logistic(np.vstack(xs), y, np.ones(len(y)), ridge=2.0)


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: node k costs ``gain[k]`` if cut off (or minus that if kept), an edge its weight.

    Maximum flow by breadth-first levels and blocking flows; parallel paths of a level are found by depth-first search.
    """
    n = len(gain)
    source, sink = n, n + 1
    heads: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(heads))
        heads.append(b)
        room.append(there)
        out[b].append(len(heads))
        heads.append(a)
        room.append(back)

    for k, g in enumerate(gain):
        if g > 0:
            add(source, k, g, 0.0)
        elif g < 0:
            add(k, sink, -g, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                b = heads[e]
                if level[b] < 0 and room[e] > tiny:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = heads[path[first] ^ 1]
                del path[first:]
            while place[a] < len(out[a]):
                e = out[a][place[a]]
                if room[e] > tiny and level[heads[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(out[a]):
                path.append(out[a][place[a]])
                a = heads[path[-1]]
            elif path:
                place[heads[path[-1] ^ 1]] += 1
                a = heads[path.pop() ^ 1]
            else:
                break


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between those next to each other under the same element.

    The way between neighbours in the tree is walked from both ends; over a page, each element is walked up once and down once.
    """
    edges, last = [], {}
    for k, b in enumerate(page.blocks):
        if k:
            x, y, steps = page.blocks[k - 1].element, b.element, 0
            while x != y:
                if page.depths[x] >= page.depths[y]:
                    x = page.parents[x]
                else:
                    y = page.parents[y]
                steps += 1
            edges.append((k - 1, k, ORDER_WEIGHT * FADE ** max(0, steps - 2)))
        parent = page.parents[b.element]
        if parent in last and last[parent] != k - 1:
            edges.append((last[parent], k, SIBLING_WEIGHT))
        last[parent] = k
    return edges


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The article's blocks, one a line."""
    page = read(html or "")
    if not page.blocks:
        return ""
    gain = np.clip(features(page.blocks) @ weights[:-1] + weights[-1], -8, 8)
    kept = min_cut(gain.tolist(), smoothness(page))
    return "\n".join(b.text for b, k in zip(page.blocks, kept, strict=True) if k)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Id, url, main text and its length of every page."""

    weights = classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "html"):
            texts = [main_text(h, weights) for h in chunk.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("page_id"), chunk.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the contract of op3."""
    return extract(_session.table(spark, sf_dir, "pages"))
