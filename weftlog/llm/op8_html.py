"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into its leaf blocks (text between block-level tags, in page order); scripts, styles, the head, comments
and form controls are no text. A head without an end tag ends, as in HTML, at the first text or tag that can't stand in it,
and of other unshown elements than scripts, styles and such an end tag that is missing loses no text: reading goes on
after the start tag. Each block gets features of its ancestor tags, of cues in their class, id and role, and of
its text (length, share of link text, marks, place in the page). The field tags blocks as content or not and is decoded
by Viterbi; content blocks are decoded, blanks made one space, trimmed and joined by two line feeds.

Training: numpy, exact likelihood, on labelled pages made by a fixed generator: articles in <article>, <main>, or a <div>
with or without telling names, between menus, headers, notices, adverts, sidebars, forms, comments and footers, with
unclosed tags; each block is labelled by the part it was made for. Nothing of the input trains.

Null and empty pages have no text; repeated rows each give their row; an empty table gives no rows; further columns are
ignored; very long pages are read whole, in linear time.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import crf
from weftlog.llm.common import slices, small_batches, table, texts

#: Tags that begin and end a block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags whose text is not shown (fixed values).
SILENT = frozenset("script style noscript template head title textarea select option button iframe svg object canvas audio video".split())
#: Tags that can stand in the head, and unshown elements that run to the end of the page if not closed (fixed values).
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
OPEN = frozenset("script style textarea title".split())
#: Tags without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
_NAMED = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template", "select", "object", "canvas", "audio", "video", "button")}


#: Cues in class, id and role names (fixed values), by what they speak of.
CUES = {
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager",
    "side": "sidebar aside related widget recommended trending popular teaser",
    "notice": "cookie cookies consent notice gdpr popup modal alert newsletter subscribe paywall overlay",
    "talk": "comment comments reply replies discussion disqus respond",
    "share": "share sharing social follow login signup search byline meta tags",
    "foot": "footer foot copyright legal bottom",
    "head": "header masthead top logo brand",
    "main": "content article post entry story body text main page",
}
_CUE = {word: name for name, words in CUES.items() for word in words.split()}
TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "ol", "li", "table", "blockquote", "pre", "figure", "figcaption", "p", "h1", "h2", "h3", "div", "details", "dialog", "menu", "fieldset"]
NAMES = ["bias", *[f"in_{t}" for t in TAGS], *[f"cue_{c}" for c in CUES], "short", "medium", "long", "half_link", "all_link", "no_stop", "copyright", "first", "early", "late", "last", "after_h1", "leaf_p", "leaf_div", "leaf_li", "leaf_h"]
_AT = {n: i for i, n in enumerate(NAMES)}


class Block:
    """A leaf block: its text, how many characters of it are links, and what its ancestors say (bits of NAMES)."""

    __slots__ = ("heading", "linked", "marks", "text")

    def __init__(self, text: str, linked: int, marks: int, heading: bool):
        self.text, self.linked, self.marks, self.heading = text, linked, marks, heading


class Element(NamedTuple):
    """An open element, with what it and its ancestors say."""

    tag: str
    marks: int
    leaf: int
    heading: bool


_ROOT = Element("", 1 << _AT["bias"], 0, False)


@lru_cache(maxsize=4096)
def _own(tag: str, names: str) -> int:
    """Bits of what an element says by its tag and its class, id and role."""
    found = {f"in_{tag}"} if tag in TAGS else set()
    found |= {f"cue_{_CUE[word]}" for word in re.split(r"[^a-z]+", names) if word in _CUE}
    return sum(1 << _AT[f] for f in found)


def _groups(tag: str) -> tuple[str, ...]:
    """What an element's place in the stack is found by."""
    return (tag, *[""] * (tag in BLOCK), *["!"] * (tag in ("article", "body", "main")))


@lru_cache(maxsize=256)
def _leaf(tag: str) -> int:
    """Bit of a block's nearest block-level tag."""
    name = {"p": "leaf_p", "div": "leaf_div", "li": "leaf_li"}.get(tag, "leaf_h" if re.fullmatch("h[1-6]", tag) else "bias")
    return 1 << _AT[name]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; texts have blanks made one space."""
    out: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # of each tag in the stack; "": of all block-level tags, "!": of those that no end tag of another reaches over
    parts: list[str] = []
    ends: dict[str, re.Match | None] = {}
    links = linked = silent = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else _ROOT
            out.append(Block(text, min(linked, len(text)), top.marks | top.leaf, top.heading))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if stack and stack[-1].tag == "head" and not raw.isspace() and raw:
            leave(len(stack) - 1)
        if raw and not silent:
            text = entities.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def leave(depth: int) -> None:
        nonlocal links, silent
        while len(stack) > depth:
            tag = stack.pop().tag
            links -= tag == "a"
            silent -= tag in SILENT
            for group in _groups(tag):
                places[group].pop()

    def last(group: str) -> int:
        found = places.get(group)
        return found[-1] if found else -1

    def end_of(tag: str, at: int) -> re.Match | None:
        """The next end tag; each stretch of the page is searched once."""
        if tag not in ends or ends[tag] and ends[tag].start() < at:
            ends[tag] = _RAW_END[tag].search(page, at)
        return ends[tag]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1] and tag not in HEAD and stack and stack[-1].tag == "head":
            leave(len(stack) - 1)
        if tag in BLOCK:
            close()
        elif tag == "br":
            say(" ")
        if m[1]:
            at_ = last(tag)
            if at_ >= 0 and (tag in ("body", "html", "article", "main") or at_ > last("!")):
                leave(at_)
            continue
        if tag in BLOCK and stack and stack[-1].tag == "option":
            leave(len(stack) - 1)
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or tag in BLOCK:
            # An open paragraph ends before any block; an open item before the next one.
            block = last("")
            if tag == "option" and last(tag) > block:
                leave(last(tag))
            elif block >= 0 and (stack[block].tag == "p" or stack[block].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr")):
                leave(block)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if tag in _RAW_END:
            end = end_of(tag, at)
            if end is None:
                at = n if tag in OPEN else at
                continue
            if tag != "button":
                at = end.end()
                continue
        names = " ".join(v.strip("\"'") for _, v in _NAMED.findall(m[3])).lower() if m[3] else ""
        above = stack[-1] if stack else _ROOT
        for group in _groups(tag):
            places[group].append(len(stack))
        stack.append(Element(tag, above.marks | _own(tag, names), _leaf(tag) if tag in BLOCK else above.leaf, above.heading or tag == "h1"))
        links += tag == "a"
        silent += tag in SILENT
    close()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row of 0 and 1 for each block."""
    x = np.zeros((len(page), len(NAMES)))
    heading = False
    for i, b in enumerate(page):
        x[i, [k for k in range(len(NAMES)) if b.marks >> k & 1]] = 1
        n = len(b.text)
        x[i, _AT["short" if n < 40 else "medium" if n < 160 else "long"]] = 1
        if b.linked * 2 >= n:
            x[i, _AT["all_link" if b.linked * 10 >= n * 9 else "half_link"]] = 1
        x[i, _AT["no_stop"]] = not re.search("[.!?…]", b.text)
        x[i, _AT["copyright"]] = "©" in b.text or "(c)" in b.text.lower()
        x[i, _AT["after_h1"]] = heading
        heading = heading or b.heading
        x[i, _AT["early"]], x[i, _AT["late"]] = i * 5 < len(page), i * 5 >= len(page) * 4
    if len(page):
        x[0, _AT["first"]] = x[-1, _AT["last"]] = 1
    return x


def generated(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """(page, label of each leaf block) of made-up pages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvéüñ") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=3, b=14: words(a, b).capitalize() + r.choice([".", ".", ".", "", "!"])
    out = []
    for _ in range(n):
        labels: list[int] = []

        def put(markup: str, label: int, labels=labels) -> str:
            labels.append(label)
            return markup

        def menu() -> str:
            items = "".join(put(f'<li><a href="/{word()}">{words(1, 2)}</a></li>', 0) for _ in range(r.randint(2, 7)))
            return r.choice(["<nav><ul>{}</ul></nav>", '<ul class="menu">{}</ul>', '<div id="navbar"><ul>{}</ul></div>', '<div role="navigation"><ul>{}</ul></div>']).format(items)

        def box(kinds: list[str]) -> str:
            inner = put(f"<p>{sentence()} {sentence()}</p>", 0) if r.random() < 0.5 else put(sentence(2, 20), 0)
            return r.choice(kinds).format(inner)

        ad = ['<div class="ad">{}</div>', '<div class="advert banner">{}</div>', '<aside class="sponsored">{}</aside>', '<section class="promo">{}</section>']
        notice = ['<div class="cookie-notice">{}</div>', '<div id="consent">{}</div>', '<div class="newsletter">{}</div>', '<dialog class="modal">{}</dialog>']
        side = ['<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div class="related">{}</div>', '<aside class="widget">{}</aside>']
        form = ["<form>{}</form>", '<form class="search">{}<input name="q"></form>']
        foot = ["<footer>{}</footer>", '<div class="footer">{}</div>', '<footer id="bottom">{}</footer>']
        head = ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>']

        def article() -> str:
            parts = [put(f"<h1>{sentence(2, 9)}</h1>", 1)] if r.random() < 0.85 else []
            for _k in range(r.choice([0, 1, 2, 3, 5, 8])):
                kind = r.random()
                text = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8])))
                if kind < 0.12:
                    parts.append(put(f"<p><b>{text}<br>", 1))
                elif kind < 0.17:
                    parts.append(put(f"<h2>{words(1, 6)}</h2>", 1))
                elif kind < 0.22:
                    parts.append("<ul>" + "".join(put(f"<li>{sentence()}</li>", 1) for _ in range(r.randint(1, 4))) + "</ul>")
                elif kind < 0.26:
                    parts.append(put(f"<blockquote>{text}</blockquote>", 1))
                elif kind < 0.3:
                    parts.append(box(ad))
                elif kind < 0.33:
                    parts.append("<pre>" + put(words(3, 9), 1) + "</pre>")
                else:
                    parts.append(put(f"<p>{text if r.random() < 0.85 else words(1, 2)}</p>", 1))
            if r.random() < 0.15:
                parts.append(box(side))
            if r.random() < 0.2:
                parts.append(comments())
            wrap = ["<article>{}</article>"] * 5 + ["<main>{}</main>", '<div class="content">{}</div>', '<div id="article-body">{}</div>', "<main><article>{}</article></main>", '<section class="post">{}</section>', "<div>{}</div>"]
            return r.choice(wrap).format("".join(parts))

        def comments() -> str:
            inner = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(put(" ".join(sentence() for _ in range(r.randint(1, 4))), 0)) for _ in range(r.randint(1, 4)))
            return r.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment-list">{}</div>']).format(inner)

        body = []
        if r.random() < 0.35:
            body.append(box(head))
        if r.random() < 0.85:
            body.append(menu())
        for kinds, share in ((notice, 0.2), (ad, 0.5), (form, 0.15), (side, 0.2)):
            if r.random() < share:
                body.append(box(kinds))
        body.append(article())
        for kinds, share in ((ad, 0.2), (side, 0.3), (form, 0.1)):
            if r.random() < share:
                body.append(box(kinds))
        if r.random() < 0.3:
            body.append(comments())
        if r.random() < 0.85:
            body.append(r.choice(foot).format(put(f"&copy; {word()}.example.net &middot; {sentence()}" if r.random() < 0.7 else sentence(), 0)))
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title></head><body>{''.join(body)}</body></html>", labels))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, crf.Moves]:
    rows, tags = [], []
    for page, labels in generated(700, 21):
        found = blocks(page)
        if found and len(found) == len(labels):
            rows.append(features(found))
            tags.append(labels)
    return crf.fit(rows, tags, crf.forbidden(2), 100)


def main_text(page: str, weights: np.ndarray, moves: crf.Moves) -> str:
    found = blocks(page)
    if not found:
        return ""
    tags = crf.viterbi(features(found) @ weights, moves)
    return "\n\n".join(b.text for b, t in zip(found, tags, strict=True) if t)


def extractor(weights: np.ndarray, moves: crf.Moves):
    def extract(batches):
        for batch in slices(batches, "html"):
            out = [main_text(page, weights, moves) for page in texts(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extractor(*model()), "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html": op8_html}
ORACLES: dict[str, str] = {}
