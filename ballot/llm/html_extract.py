"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block elements, each with its chain of
ancestors. Every block has features of its ancestors (tags, words of class and id) and of its text
(length, share of links, punctuation, stock phrases); the chain's transitions tie neighbours together.
The field is trained on labelled pages: those made by `labelled_pages`, whose labels are known from how
they are made, or the caller's own. Decoding is by Viterbi, a page at a time.

Defined results: a null or empty page has the text ''; equal pages (rows that repeat, equal ids) get equal
texts; tags cut off by the end of the page are dropped, as browsers do; very long pages and any number of
open elements take time and memory in proportion to the page; of two parses of a page there are no ties, and
equal scores of the field go to the label "beside the article". Hidden elements are parsed like others: the
field alone decides what belongs to the article. Input columns named like the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ballot.llm.common import map_text

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold code, markup as text, a form's own text or the page's name; their end is their own end tag.
RAW = frozenset("script style iframe noembed noframes textarea title annotation annotation-xml".split())
#: An open element of these is closed by the start of one of those.
CLOSED_BY = {"p": BLOCKS - {"button", "label", "legend", "option", "summary"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
CLOSES = {tag: [x for x in CLOSED_BY if tag in CLOSED_BY[x]] for tag in BLOCKS}
#: Within these an element is not looked for to be closed by the start of another.
BARRIERS = BLOCKS - {"p", "li", "dt", "dd", "option", "tr", "td", "th", "tbody"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
GOLD = re.compile(r'\bdata-gold="([01])"')
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass(frozen=True)
class Place:
    """An element with its ancestors, as sums of what features ask of them: their size is bounded, however deep it is."""

    tag: str
    tags: int = 0  # of TAGS, itself and its ancestors
    hints: int = 0  # of HINTS, by their classes, ids and roles
    own: str = "none"  # the innermost block element
    linked: bool = False
    gold: int | None = None

    def below(self, tag: str, names: list[str], gold: int | None) -> Place:
        tags = self.tags | TAG_BIT.get(tag, 0)
        hints = self.hints
        for n in names:
            hints |= HINT_BIT.get(n, 0)
        return Place(tag, tags, hints, tag if tag in BLOCKS else self.own, self.linked or tag == "a", self.gold if gold is None else gold)


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters inside links


def names_of(attributes: str) -> list[str]:
    """Words of an element's class, id and role."""
    out = []
    for m in NAMED.finditer(attributes):
        out += WORD.findall(CAMEL.sub(r"\1 \2", m[2] or m[3] or m[4] or "").lower())
    return out


class Opened:
    """The open elements: a stack that finds the innermost of a tag without a search."""

    def __init__(self):
        self.stack = [Place("")]
        self.at: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    @property
    def top(self) -> Place:
        return self.stack[-1]

    def push(self, place: Place) -> None:
        self.at.setdefault(place.tag, []).append(len(self.stack))
        if place.tag in BARRIERS:
            self.barriers.append(len(self.stack))
        self.stack.append(place)

    def cut(self, depth: int) -> None:
        """Closes all elements from a depth on."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in BARRIERS:
                self.barriers.pop()

    def innermost(self, tag: str) -> int:
        own = self.at.get(tag)
        return own[-1] if own else 0

    def close_for(self, tag: str) -> None:
        """The start of a block element closes what cannot hold it."""
        depth = max((self.innermost(x) for x in CLOSES[tag]), default=0)
        if depth > (self.barriers[-1] if self.barriers else 0):
            self.cut(depth)


def leaf_blocks(html: str | None, marked: bool = False) -> list[Block]:
    """A page's leaf blocks; `marked`: with the marks of labelled pages, which other pages' marks must not pass for.

    One pass, linear in the page however many elements are open.
    """
    out: list[Block] = []
    opened = Opened()
    parts: list[str] = []
    linked = 0
    html = html or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(text, opened.top, linked))
        linked = 0

    def show(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text)
            parts.append(text)
            if opened.top.linked:
                linked += len(text.strip())

    at = 0
    while m := TAG.search(html, at):
        show(html[at : m.start()])
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if not m[0].endswith(">"):
            break  # the page ends inside the tag
        if end:
            depth = opened.innermost(tag)
            if depth:
                if tag in BLOCKS:
                    flush()
                opened.cut(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            opened.close_for(tag)
        if tag in RAW:
            if rest.rstrip().endswith("/") and tag.startswith("annotation"):
                continue
            close = closing(tag).search(html, at)
            at = close.end() if close else len(html)
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            gold = GOLD.search(rest) if marked and "data-gold" in rest else None
            opened.push(opened.top.below(tag, names_of(rest) if "=" in rest else [], int(gold[1]) if gold else None))
    else:
        show(html[at:])
    flush()
    return out


@cache
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


# Words of classes and ids, by what they stand for.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc skip pagination pager topbar",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense banner teaser",
    "side": "sidebar side widget widgets related rail recommended trending popular aside",
    "notice": "cookie cookies consent notice notices alert popup modal gdpr privacy overlay disclaimer dialog announcement",
    "comment": "comment comments commentlist reply replies discussion disqus respond feedback response responses",
    "share": "share sharing social follow tweet facebook",
    "foot": "footer foot copyright colophon legal bottom contentinfo",
    "head": "header head masthead logo brand tagline top",
    "form": "form login signin signup register newsletter subscribe subscription search contact",
    "main": "content article post entry main story body text page single blog prose",
}
HINT_BIT = {w: 1 << i for i, words in enumerate(HINTS.values()) for w in words.split()}
# Stock phrases of what surrounds articles.
PHRASES = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign (?:in|up)\b|\blog ?in\b|privacy policy|terms of|\bnewsletter\b|\bread more\b|\bshare (?:this|on)\b|\breply\b|\bcomments?\b|\badvertisement\b|\bsponsored\b", re.I)
#: One of these is in any text that the phrases are in; plain searches are much faster.
STEMS = ("©", "copyright", "rights reserved", "cookie", "subscribe", "sign in", "sign up", "log in", "login", "privacy policy", "terms of", "newsletter", "read more", "share ", "reply", "comment", "advertisement", "sponsored")
TAGS = "nav header footer aside form article main section ul ol li table td figure figcaption blockquote pre button label select h1 h2 h3 h4 h5 h6 p a dl div".split()


TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}


def chain_features(tags: int, hinted: int, own: str) -> list[str]:
    """Features of a block's ancestors."""
    held = {t for t in TAGS if tags & TAG_BIT[t]}
    hints = {h for i, h in enumerate(HINTS) if hinted >> i & 1}
    f = [f"tag:{t}" for t in TAGS if t in held] + [f"own:{own}"] + [f"hint:{h}" for h in sorted(hints)]
    inside = "article" if "article" in held else "main" if "main" in held or "main" in hints else "body"
    f.append(f"inside:{inside}")
    apart = [x for x in ("nav", "aside", "footer", "header", "form") if x in held] + [x for x in ("menu", "advert", "side", "notice", "comment", "share", "foot", "form") if x in hints]
    f += [f"apart in {inside}"] if apart else [f"plain in {inside}"]
    if "header" in held and own in ("h1", "h2"):
        f.append(f"title in header in {inside}")
    return f


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    seen_h1 = False
    chains: dict[tuple, list[str]] = {}
    for i, b in enumerate(blocks):
        own = b.place.own
        chain = (b.place.tags, b.place.hints, own)
        if chain not in chains:
            chains[chain] = chain_features(*chain)
        f = list(chains[chain])
        n = b.text.count(" ") + 1
        links = b.linked / max(1, len(b.text))
        seen_h1 |= own == "h1"
        f.append("words:1-2" if n < 3 else "words:3-7" if n < 8 else "words:8-19" if n < 20 else "words:20-59" if n < 60 else "words:60-")
        f.append("links:0" if links == 0 else "links:some" if links < 0.5 else "links:most")
        f.append("end:stop" if b.text[-1] in ".!?…\"'”)" else "end:other")
        low = b.text.lower()
        if any(x in low for x in STEMS) and PHRASES.search(low):
            f.append("phrase")
            if n < 20:
                f.append("short phrase")
        f.append("h1:own" if own == "h1" else "h1:after" if seen_h1 else "h1:before")
        if own == "li" and links > 0.5:
            f.append("linked item")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        out.append(f)
    return out


@dataclass
class Field:
    number: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    _cells: dict[str, tuple[float, float]] | None = None

    def emission(self, names: list[str]) -> tuple[float, float]:
        """Sums of a block's weights for either label; of plain floats, which Python adds faster than array cells."""
        if self._cells is None:
            self._cells = {x: tuple(self.weights[i].tolist()) for x, i in self.number.items()}
        a = b = 0.0
        for x in names:
            if cell := self._cells.get(x):
                a += cell[0]
                b += cell[1]
        return a, b

    def decode(self, names: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        if not names:
            return []
        m = self.moves.tolist()
        emit = [self.emission(f) for f in names]
        score, back = emit[0], []
        for e in emit[1:]:
            best = [0 if score[0] + m[0][k] >= score[1] + m[1][k] else 1 for k in (0, 1)]
            back.append(best)
            score = [score[best[k]] + m[best[k]][k] + e[k] for k in (0, 1)]
        labels = [int(score[1] > score[0])]
        for best in reversed(back):
            labels.append(best[labels[-1]])
        return labels[::-1]

    def text(self, html: str | None) -> str:
        blocks = leaf_blocks(html)
        return " ".join(b.text for b, y in zip(blocks, self.decode(features(blocks)), strict=True) if y)


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, penalty: float = 1e-3, rate: float = 0.1) -> Field:
    """The field of greatest likelihood on labelled pages: forward and backward sums, all pages side by side."""
    pages = [p for p in pages if p[0]]
    number: dict[str, int] = {}
    for names, _ in pages:
        for f in names:
            for x in f:
                number.setdefault(x, len(number))
    n, longest = len(pages), max(len(p[0]) for p in pages)
    x = np.zeros((n, longest, len(number)), np.float32)
    y = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for i, (names, labels) in enumerate(pages):
        for t, f in enumerate(names):
            x[i, t, [number[k] for k in f]] = 1
        y[i, : len(labels)] = labels
        real[i, : len(labels)] = True
    blocks, first = x[real], np.zeros((n, longest), bool)
    first[:, 0] = True
    total = len(blocks)
    w, moves = np.zeros((len(number), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    gold = np.eye(2)[y[real]]
    pair = np.zeros((2, 2))
    follow = real[:, 1:]
    np.add.at(pair, (y[:, :-1][follow], y[:, 1:][follow]), 1)

    def plus(a):  # log of the sum of exponentials over the second last axis
        top = a.max(axis=-2, keepdims=True)
        return np.squeeze(top, -2) + np.log(np.exp(a - top).sum(axis=-2))

    for k in range(1, steps + 1):
        emit = np.zeros((n, longest, 2))
        emit[real] = blocks @ w
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(real[:, t, None], plus(ahead[:, t - 1, :, None] + moves) + emit[:, t], ahead[:, t - 1])
        norm = plus(ahead[:, -1, :, None])[:, 0]
        after = np.zeros((n, longest, 2))
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            step = (emit[:, t + 1] + after[:, t + 1])[:, None, :] + moves
            after[:, t] = np.where(real[:, t + 1, None], plus(np.swapaxes(step, 1, 2)), 0)
            both = np.exp(ahead[:, t, :, None] + step - norm[:, None, None])
            expected += both[real[:, t + 1]].sum(axis=0)
        post = np.exp(ahead + after - norm[:, None, None])[real]
        grads = [blocks.T @ (post - gold) / total + penalty * w, (expected - pair) / total + penalty * moves]
        for j, (value, g) in enumerate(zip((w, moves), grads, strict=True)):
            state[2 * j] = 0.9 * state[2 * j] + 0.1 * g
            state[2 * j + 1] = 0.99 * state[2 * j + 1] + 0.01 * g * g
            value -= rate * (state[2 * j] / (1 - 0.9**k)) / (np.sqrt(state[2 * j + 1] / (1 - 0.99**k)) + 1e-8)
    return Field(number, w, moves)


def labelled_pages(count: int = 260, seed: int = 11) -> list[str]:
    """Pages of many layouts; data-gold="1" marks elements of the article, "0" whatever stands beside it."""
    r = np.random.default_rng(seed)
    syllables = "ba den tor lin mus ka re von tis ela gra pon ster il du men ora fe".split()

    def pick(*options):
        return options[r.integers(len(options))]

    def chance(p: float) -> bool:
        return r.random() < p

    def prose(lo: int, hi: int) -> str:
        out = []
        for _ in range(r.integers(lo, hi + 1)):
            w = "".join(pick(*syllables) for _ in range(r.integers(1, 4)))
            out.append(w.capitalize() if not out or out[-1].endswith(".") else w)
            if chance(0.12):
                out[-1] += pick(".", ".", ",")
        return " ".join(out).rstrip(",.") + pick(".", ".", ".", "")

    def inline(text: str) -> str:
        words = text.split(" ")
        if len(words) > 6 and chance(0.4):
            i = int(r.integers(1, len(words) - 3))
            tag = pick("b", "em", "i", "strong", "span", 'a href="/x"', "code")
            words[i] = f"<{tag}>{words[i]}"
            words[i + 1] += f"</{tag.split()[0]}>"
        return " ".join(words) + pick("", "", " &amp; " + prose(1, 4), "<br>" + prose(2, 9))

    def element(tag: str, names: str, inner: str, gold: int | None = None) -> str:
        mark = "" if gold is None else f' data-gold="{gold}"'
        kind = "" if not names else f' class="{names}"' if chance(0.7) else f' id="{names}"'
        return f"<{tag}{kind}{mark}>{inner}</{tag}>"

    def links(lo: int, hi: int) -> str:
        items = "".join(f'<li><a href="/{k}">{prose(1, 4).rstrip(".")}</a>' + pick("</li>", "</li>", "") for k in range(r.integers(lo, hi + 1)))
        return pick(f"<ul>{items}</ul>", f"<ul>{items}</ul>", re.sub(r"</?li>", " ", items))

    def paragraphs(lo: int, hi: int) -> str:
        out = ""
        for _ in range(r.integers(lo, hi + 1)):
            kind = r.random()
            if kind < 0.66:
                out += f"<p>{inline(prose(1, 90))}" + pick("</p>", "</p>", "")
            elif kind < 0.76:
                out += f"<{(h := pick('h2', 'h3'))}>{prose(1, 9)}</{h}>"
            elif kind < 0.84:
                out += f"<{(u := pick('ul', 'ol'))}>" + "".join(f"<li>{inline(prose(2, 25))}</li>" for _ in range(r.integers(2, 6))) + f"</{u}>"
            elif kind < 0.9:
                out += f"<blockquote>{pick('', '<p>')}{prose(5, 40)}</blockquote>"
            elif kind < 0.94:
                out += f"<p><b>{prose(3, 40)}<br>"
            elif kind < 0.97:
                out += f"<table><tr><td>{prose(1, 8)}</td><td>{prose(1, 8)}</td></tr></table>"
            else:
                out += f"<figure><img src='a.png'><figcaption>{prose(3, 15)}</figcaption></figure>"
        return out

    def advert() -> str:
        return pick(element("div", pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"), prose(2, 30), 0), element("aside", pick("ad", "promo", ""), f"<p>{prose(3, 30)}</p>", 0), element("section", "sponsored-links", f"<p>{prose(3, 30)}</p>" + links(1, 3), 0))

    def notice() -> str:
        text = pick("We use cookies to improve this site. " + prose(3, 12), prose(4, 30), "By using this site you accept our privacy policy.")
        return element(pick("div", "section", "aside", "div"), pick("cookie-notice", "cookies", "consent", "notice", "gdpr-banner", "alert", "popup"), pick("", "<p>") + text + pick("", "<button>OK</button>"), 0)

    def form() -> str:
        inner = "".join(f"<label>{prose(1, 3)}</label><input name=a>" for _ in range(r.integers(1, 4))) + f"<button>{prose(1, 2)}</button>"
        return pick(element("form", pick("", "search", "newsletter", "login"), pick("", f"<p>{prose(3, 20)}</p>") + inner, 0), element("div", pick("newsletter", "subscribe", "signup"), f"<p>{prose(3, 20)}</p><form>{inner}</form>", 0))

    def comments() -> str:
        one = lambda: pick(f'<div class="comment"><b>{prose(1, 2)}</b><p>{prose(3, 60)}</p><a href="#">Reply</a></div>', f'<li class="comment"><p>{prose(3, 60)}</p></li>', f'<article class="comment"><header>{prose(1, 3)}</header><p>{prose(5, 60)}</p></article>')
        return element(pick("section", "div", "ol"), pick("comments", "comment-list", "discussion", "responses"), pick("", f"<h2>{pick('Comments', prose(1, 3))}</h2>") + "".join(one() for _ in range(r.integers(1, 6))) + pick("", form()), 0)

    def side() -> str:
        return pick(element("aside", pick("", "sidebar", "related"), f"<h3>{prose(1, 4)}</h3>" + pick(links(2, 6), f"<p>{prose(4, 35)}</p>"), 0), element("div", pick("sidebar", "widget", "related-posts", "side"), f"<h3>{prose(1, 4)}</h3>" + pick(links(2, 6), f"<p>{prose(4, 35)}</p>"), 0))

    def share() -> str:
        return element("div", pick("share", "social-links"), links(2, 4), 0)

    pages = []
    for _ in range(count):
        title = prose(2, 12)
        head = ""
        if chance(0.6):
            head += element(pick("header", "div"), pick("header", "masthead", "site-header", "top"), pick("", f"<h1>{prose(1, 3)}</h1>", f'<a href="/">{prose(1, 3)}</a>') + pick("", f"<p>{prose(2, 10)}</p>"), 0)
        if chance(0.85):
            head += pick(f'<nav data-gold="0">{links(2, 9)}</nav>', element("div", pick("menu", "navbar", "nav", "breadcrumbs"), links(2, 9), 0))
        heading = pick(f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", "")
        body, extra = paragraphs(1, 12), pick("", "", advert(), notice(), form(), share(), side())
        if extra:  # something that doesn't belong, inside the article
            body += extra + paragraphs(0, 4)
        box = r.random()
        if box < 0.45:
            article = element("article", pick("", "", "post", "entry"), heading + body, 1)
        elif box < 0.6:
            article = element("main", "", pick(heading + body, element("article", "", heading + body)), 1)
        elif box < 0.85:
            article = element("div", pick("content", "post-body", "entry-content", "article-text", "story", "main", "page"), heading + body, 1)
        elif box < 0.93:
            article = f'<table><tr><td data-gold="1">{heading + body}</td></tr></table>'
        else:
            article = f'<div data-gold="1">{heading + body}</div>'
        before = "".join(f() for f in (advert, notice, form, side) if chance(0.3))
        below = "".join(f() for f in (share, comments, side, advert, form, notice) if chance(0.3))
        foot = ""
        if chance(0.9):
            foot = element(pick("footer", "footer", "div"), pick("footer", "copyright", "site-footer"), pick("&copy; ", "Copyright ", "") + prose(2, 25) + pick("", links(2, 5)), 0)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{head}<!-- x -->{before}{article}{below}{foot}</body></html>"
        pages.append(page[: int(len(page) * r.uniform(0.6, 1))] if chance(0.08) else page)
    return pages


def labelled(pages: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks of marked pages; what is not marked is not of the article."""
    out = []
    for page in pages:
        blocks = leaf_blocks(page, marked=True)
        out.append((features(blocks), [b.place.gold or 0 for b in blocks]))
    return out


@cache
def default_field() -> Field:
    return train(labelled(labelled_pages()))


def main_text(pages: DataFrame, html: str = "html", model: Field | None = None) -> DataFrame:
    """pages less `html`, with text (joined blocks of the article) and n_chars (its code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_field())

    def make():
        def run(texts):
            got = [shared.value.text(t) for t in texts]
            return [got, [len(t) for t in got]]

        return run

    keep = [c for c in pages.columns if c != html]
    return map_text(pages, html, [("text", T.StringType(), pa.string()), ("n_chars", T.LongType(), pa.int64())], make, keep=keep)
