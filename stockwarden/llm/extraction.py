"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is walked once; every run of text between block-level tags is a leaf block with its ancestors. Features are the
ancestors' tags, the words of their classes and ids, and statistics of the text. The field labels the sequence of blocks
main or other; Viterbi decoding gives the likeliest labels of the page as a whole.

It is trained on labelled pages: `labelled_pages` composes pages of many layouts from parts whose label is known (articles,
menus, headers, footers, sidebars, notices, adverts, forms, comments), with and without telling names and with broken
markup. Training is gradient ascent on the exact likelihood over all of them at once.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Element names by their role in HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: their text ends at their own end tag only, or with the page.
RAW = "script style textarea title iframe"
#: Elements that are left out with all their markup up to their own end tag; without one only the tag is.
UNSEEN = frozenset("noscript template select svg object canvas audio video button datalist".split())
#: Those of them that may hold others of their own name; of the rest a start tag ends an open one.
NESTED = frozenset("template svg object canvas".split())
#: Start tags that end an open element of these names.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Where looking for an element to close stops.
SCOPE = frozenset("table ul ol dl body html article section div td th".split())
TAGS = tuple("nav header footer aside article main section form figure table li a p h1 h2 h3 div td blockquote pre ul ol dl address label body".split())
#: Words in classes, ids and roles, by what they tell.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager skip", "head": "header masthead banner topbar logo branding title-bar",
    "foot": "footer colophon copyright legal bottom", "side": "sidebar side aside widget rail related recommended popular trending tags tagcloud meta byline author-box",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner-ad commercial affiliate partner", "notice": "cookie cookies consent gdpr notice alert modal popup overlay warning disclaimer message",
    "form": "form search newsletter subscribe signup login register contact", "comment": "comment comments disqus respond reply replies discussion thread", "share": "share social sharing follow facebook twitter",
    "main": "content main article post entry story body text page-content article-body post-content entry-content hentry prose",
}
_ROLE = {w: k for k, (role, words) in enumerate(NAMES.items()) for w in words.split()}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|</[^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+)?")


_SAME = {name: re.compile(rf"<(/?){name}(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.I) for name in UNSEEN}


def _end_of(page: str, name: str, at: int) -> int:
    """Where the element `name` whose start tag ends at `at` is over; -1 if it has no end tag of its own."""
    depth = 1
    for m in _SAME[name].finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif name not in NESTED:
            return -1
        elif not m[0].endswith("/>"):
            depth += 1
    return -1


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    roles: frozenset[int]
    parent: str
    linked: float  # share of the text within links


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; white space inside is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[int], bool]] = []  # name, roles, hidden
    parts: list[str] = []
    linked = 0

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not any(s[2] for s in stack):
                raw = sum(map(len, parts))
                names = [s[0] for s in stack]
                roles = frozenset().union(*(s[1] for s in stack)) if stack else frozenset()
                parent = next((n for n in reversed(names) if n in BLOCK), "")
                out.append(Block(text, frozenset(names), roles, parent, min(1.0, linked / max(1, raw))))
            parts.clear()
            linked = 0

    def add(text: str):
        nonlocal linked
        if text:
            parts.append(text)
            if any(s[0] == "a" for s in stack):
                linked += len(text)

    at, page = 0, page or ""
    open_ended: set[str] = set()  # names that have no end tag in the rest of the page
    for m in _TOKEN.finditer(page):
        if m.start() < at:  # in an element that is left out
            continue
        add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCK:
                end_block()
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name == "br":
            add(" ")
        if name in BLOCK:
            end_block()
            if any(s[0] == "p" for s in stack):  # a paragraph ends where the next block begins, with what is open in it
                while stack.pop()[0] != "p":
                    pass
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        if name in VOID:
            continue
        attrs = m["attrs"]
        if attrs.endswith("/") and name not in BLOCK:
            continue
        if name in UNSEEN:
            if name not in open_ended:
                end = _end_of(page, name, at)
                if end < 0 and not re.search(f"</{name}", page[at:], re.I):
                    open_ended.add(name)
                at = max(at, end)
            continue
        roles: frozenset[int] = frozenset()
        if attrs.strip():
            found = [w for v in _NAMED.findall(attrs) for w in _words("".join(v).lower())]
            roles = frozenset(_ROLE[w] for w in found if w in _ROLE)
        stack.append((name, roles, bool(attrs) and bool(_HIDDEN.search(attrs))))
    add(page[at:])
    end_block()
    return out


def _words(names: str) -> list[str]:
    out = []
    for w in _WORDS.findall(names):
        out += [w, *w.split("-")] if "-" in w else [w]
    return out


_TEXT = 22
FEATURES = 1 + 2 * len(TAGS) + len(NAMES) + _TEXT
_TAG_AT = {t: 1 + k for k, t in enumerate(TAGS)}


def features(blocks: list[Block]) -> np.ndarray:
    """Blocks x features: ancestors, nearest block, names, and statistics of the text."""
    x = np.zeros((len(blocks), FEATURES))
    x[:, 0] = 1
    for k, b in enumerate(blocks):
        row = x[k]
        for t in b.tags:
            if t in _TAG_AT:
                row[_TAG_AT[t]] = 1
        if b.parent in _TAG_AT:
            row[_TAG_AT[b.parent] + len(TAGS)] = 1
        base = 1 + 2 * len(TAGS)
        for r in b.roles:
            row[base + r] = 1
        t, n = b.text, len(b.text)
        words = t.count(" ") + 1
        row[base + len(NAMES) :] = (
            n < 20, 20 <= n < 60, 60 <= n < 150, 150 <= n < 400, n >= 400, words <= 2, words >= 12, b.linked > 0.8, 0.3 < b.linked <= 0.8, b.linked == 0,
            t[-1] in ".!?\"”»…", t.count(",") >= 2, t.count(".") >= 2, "©" in t or "copyright" in t.lower(), "|" in t or "·" in t or "»" in t,
            sum(map(str.isdigit, t)) > 0.2 * n, t.isupper(), k == 0, k == len(blocks) - 1, k < 0.15 * len(blocks), k > 0.85 * len(blocks), ":" in t,
        )
    return x


@dataclass
class Field:
    """Emission weights (features x 2), transition weights (2 x 2) and start weights."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels (Viterbi); ties go to label 0."""
        if not len(x):
            return np.empty(0, np.int64)
        score, back = x @ self.emit, np.zeros((len(x), 2), np.int64)
        best = score[0] + self.start
        for k in range(1, len(x)):
            ways = best[:, None] + self.move
            back[k] = ways.argmax(axis=0)
            best = ways.max(axis=0) + score[k]
        out = np.zeros(len(x), np.int64)
        out[-1] = best.argmax()
        for k in range(len(x) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """Fit by Adagrad on the regularised log likelihood; all pages advance together, padded to the longest."""
    n, longest, width = len(pages), max(len(y) for _, y in pages), pages[0][0].shape[1]
    x, y, on = np.zeros((n, longest, width)), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (a, b) in enumerate(pages):
        x[k, : len(b)], y[k, : len(b)], on[k, : len(b)] = a, b, True
    gold = np.eye(2)[y] * on[:, :, None]
    moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    field = Field(np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2))
    sums = [np.full(w.shape, 1e-8) for w in (field.emit, field.move, field.start)]
    for _ in range(rounds):
        score = x @ field.emit
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0] + field.start
        for t in range(1, longest):
            step = _log_sum(ahead[:, t - 1, :, None] + field.move, 1) + score[:, t]
            ahead[:, t] = np.where(on[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(field.move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(on[:, t + 1, None], step, 0)
        whole = _log_sum(ahead[:, -1], 1)
        each = np.exp(ahead + behind - whole[:, None, None]) * on[:, :, None]
        pair = ahead[:, :-1, :, None] + field.move + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]).sum(axis=(0, 1))
        slopes = (
            np.einsum("ntf,ntl->fl", x, gold - each) / n - ridge * field.emit,
            (moves - expected) / n - ridge * field.move,
            (gold[:, 0] - each[:, 0]).sum(axis=0) / n - ridge * field.start,
        )
        for w, g, s in zip((field.emit, field.move, field.start), slopes, sums, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    return field


def labelled_pages(n: int = 320, seed: int = 3) -> list[str]:
    """Training pages of random layouts. In their text, words that begin with `~` mark blocks that belong to the main text."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    sound = "an er the in on ti es re or de la un ge sch le ment que ció os ar en ver zu eau ist to of and".split()

    def word():
        return "".join(sound[k] for k in rng.integers(0, len(sound), rng.integers(1, 4)))

    def words(low, high, mark=""):
        return " ".join(mark + word() for _ in range(rng.integers(low, high + 1)))

    def sentences(low, high, mark=""):
        return " ".join(words(2, 18, mark).capitalize() + pick(".", ".", ".", "!", "?") for _ in range(rng.integers(low, high + 1)))

    def links(low, high):
        item = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
        some = [item() for _ in range(rng.integers(low, high + 1))]
        return pick("<ul>" + "".join(f"<li>{s}</li>" for s in some) + "</ul>", pick(" | ", " ", " · ").join(some), "".join(f"<div>{s}</div>" for s in some), "".join(f"<li>{s}" for s in some))

    def paragraph():
        body = sentences(1, 6, "~") if rng.random() < 0.85 else words(1, 4, "~") + pick(".", "")
        oddity = rng.random()
        if oddity < 0.06:
            body = pick(" | ", " · ", " : ").join(words(1, 2, "~") for _ in range(rng.integers(2, 12))) + pick("", ".", " |")
        elif oddity < 0.1:
            body = words(1, 1, "~") + pick("", ".", "!")
        elif oddity < 0.13:
            body = body.upper()
        elif oddity < 0.35:
            body += f' <a href="#">{words(1, 3, "~")}</a> ' + words(1, 6, "~") + "."
        shape = rng.random()
        if shape < 0.1:
            return f"<p><b>{body}<br>"
        if shape < 0.2:
            return f"<p>{body}"
        if shape < 0.25:
            return f"<div>{body}</div>"
        if shape < 0.3:
            return f"<blockquote><p>{body}</p></blockquote>"
        if shape < 0.36:
            return "<ul>" + "".join(f"<li>{words(2, 14, '~')}</li>" for _ in range(rng.integers(2, 5))) + "</ul>"
        if shape < 0.4:
            return f"<pre>{body}</pre>"
        if shape < 0.43:
            return "<table>" + "".join(f"<tr><td>{words(1, 3, '~')}</td><td>{words(1, 4, '~')}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        return f"<p>{body}</p>"

    def wrap(kinds, inside):
        opening = pick(*kinds)
        return f"<{opening}>{inside}</{opening.split(' ', 1)[0]}>"

    def article():
        inside = "".join(paragraph() + (f"<h{rng.integers(2, 4)}>{words(1, 6, '~')}</h2>" if rng.random() < 0.12 else "") for _ in range(rng.integers(1, 12)))
        head = f"<h1>{words(2, 10, '~')}</h1>" if rng.random() < 0.75 else ""
        extra = wrap(('div class="share"', 'div class="social-share"'), links(2, 4)) if rng.random() < 0.15 else ""
        middle = advert() if rng.random() < 0.2 else ""
        half = len(inside) // 2
        cut = inside.find("<p", half)
        inside = inside if cut < 0 else inside[:cut] + middle + inside[cut:]
        kinds = ("article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post-content"', 'section class="entry-content"', 'div class="article-body"', 'div id="content"', "div", 'div class="story"', 'div role="main"', "td")
        out = wrap(kinds, head + inside + extra)
        return wrap(("main", 'div class="container"', 'div class="wrapper"'), out) if rng.random() < 0.3 else out

    def advert():
        kinds = ('div class="ad"', 'div class="advert"', 'div id="ads"', 'aside class="promo"', 'div class="sponsored"', 'div class="ad-banner"', "ins", 'section class="advertisement"')
        return wrap(kinds, pick(sentences(1, 3), words(2, 9), f'<a href="/x">{words(2, 8)}</a>', f"<p>{sentences(1, 2)}</p>"))

    def menu():
        kinds = ("nav", "nav", 'div class="menu"', 'ul class="navbar"', 'div id="navigation"', "header", 'div class="breadcrumbs"', 'nav class="pagination"')
        return wrap(kinds, links(2, 9))

    def header():
        return wrap(("header", 'div class="header"', 'div id="masthead"'), pick("", f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<a href='/'>{words(1, 2)}</a>") + pick("", links(2, 6)))

    def sidebar():
        inside = "".join(f"<h3>{words(1, 3)}</h3>" + pick(links(2, 6), f"<p>{sentences(1, 2)}</p>", f"<p>{words(3, 12)}</p>") for _ in range(rng.integers(1, 4)))
        return wrap(("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'section class="related"', 'aside class="related-posts"'), inside)

    def notice():
        return wrap(('div class="cookie-notice"', 'div id="cookie-consent"', 'div class="alert"', 'div class="notice"', 'div class="gdpr"', 'div role="alert"'), pick(sentences(1, 3), f"<p>{sentences(1, 2)}</p>"))

    def form():
        return wrap(('form class="search"', 'form action="/s"', 'div class="newsletter"', 'form id="login"'), f"<label>{words(1, 4)}</label><input name=q>" + pick("", f"<p>{sentences(1, 2)}</p>"))

    def comments():
        one = lambda: wrap(('div class="comment"', 'li class="comment"', 'article class="comment"'), f"<p>{sentences(1, 4)}</p>" + pick("", f"<span>{words(1, 2)}</span>"))
        return wrap(('section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div id="disqus_thread"'), pick("", f"<h2>{words(1, 3)}</h2>") + "".join(one() for _ in range(rng.integers(1, 5))))

    def footer():
        return wrap(("footer", "footer", 'div class="footer"', 'div id="footer"'), pick("&copy; ", "") + pick(sentences(1, 2), words(2, 6) + " &middot; " + words(2, 8), links(2, 6), f"<p>{words(3, 12)}</p>"))

    out = []
    for _ in range(n):
        before = [part() for part in (header, menu, notice, advert, form, sidebar) if rng.random() < 0.4]
        after = [part() for part in (advert, sidebar, form, comments, notice, menu) if rng.random() < 0.35]
        rng.shuffle(before)
        rng.shuffle(after)
        body = "".join(before) + (article() if rng.random() < 0.96 else "") + "".join(after) + (footer() if rng.random() < 0.8 else "")
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}" + pick("</body></html>", ""))
    return out


def default_field() -> Field:
    """The field trained on `labelled_pages`."""
    pages = []
    for page in labelled_pages():
        blocks = blocks_of(page)
        labels = np.array([int("~" in b.text) for b in blocks], np.int64)
        for b in blocks:
            b.text = b.text.replace("~", "") or "."
        if blocks:
            pages.append((features(blocks), labels))
    return train(pages)


def main_text(page: str | None, field: Field) -> str:
    """The blocks of the main text, joined by line ends; empty for a null or empty page."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, label in zip(blocks, field.decode(features(blocks)), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars. Null pages and pages without a main
    text give an empty text; rows that repeat an id repeat; other columns are ignored."""
    model = pages.sparkSession.sparkContext.broadcast(field or default_field())

    @pandas_udf(StringType())
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, model.value) for p in page], dtype=object)

    out = pages.select("page_id", "url", text("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
