"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: the text between block-level tags, with its
ancestors' tags and class, id and role words.  Ancestor and text features give
each block a score for article or boilerplate; two transition tables (same
parent as the block before, or another) tie neighbours together; Viterbi finds
the best labelling, and the article's blocks are joined in page order.

The field is trained by gradient ascent on the conditional likelihood of
labelled pages.  The corpus has no labels, so ``labelled_pages`` writes them:
pages of several layouts with random words, whose article elements carry a
label attribute that only training reads.  Training is deterministic and takes
about a second on the driver; nothing of the corpus goes into it.

Null html counts as empty; without article blocks the text is empty.  Text that
isn't rendered (scripts, styles, templates, head) is never a block.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head iframe math noscript object script style svg template title".split())
#: Start tags that leave an open head open; any other, or text, ends it.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Start tags that end an open element of the second set, up to a container.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINER = set("article aside body div dl fieldset figure footer form header main nav ol section table td th ul".split())

#: Open elements that a start tag may end, or at which its search for them ends.
STOPS = CONTAINER | {"p"} | {x for ends in ENDS.values() for x in ends}

#: Words in class, id and role, by what they speak for (fixed lists).
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination skip",
    "head": "header masthead topbar toolbar logo branding hero site",
    "foot": "footer foot copyright colophon legal credits",
    "side": "sidebar side aside rail widget widgets related recommended popular trending more tags share social",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner adsense outbrain taboola",
    "note": "cookie cookies consent gdpr notice alert newsletter subscribe subscription signup popup modal overlay paywall login",
    "talk": "comment comments reply replies respond discussion disqus thread reviews",
    "main": "article content main post entry story text body prose",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_SPLIT = re.compile(r"[^a-z0-9]+")
_TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "p", "li", "table", "blockquote", "pre", "figure", "button", "h1", "h", "dialog", "menu", "label", "a")


_BIT = {t: 1 << k for k, t in enumerate(dict.fromkeys((*(t for t in _TAGS if t not in ("h1", "h")), "h1", "h2", "h3", "h4", "h5", "h6")))}
_HINT_BIT = {h: 1 << k for k, h in enumerate(HINTS)}


@dataclass
class Block:
    """A leaf: its text, bits of its ancestors' tags and hints, the number of the container that holds it, characters in links, label."""

    text: str
    tags: int
    hints: int
    parent: int
    linked: int
    label: int


@dataclass(slots=True)
class Element:
    """An open element.  What it inherits is kept in it, and ``stop`` and ``hides`` say where the nearest elements lie (itself included) at which a search up the stack ends, so no step costs more the deeper the page."""

    tag: str
    tags: int = 0
    hints: int = 0
    holder: int = 0
    label: int = 0
    stop: int = -1
    hides: int = -1


_ROOT = Element("")

class PageParser(HTMLParser):
    """The library's parser for whole pages, fed at once: sections with unknown words are comments, and an open comment reaches to the end, as in HTML."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)


class Blocks(PageParser):
    """Leaf blocks of a page, in order; time and memory are linear in the page."""

    def __init__(self, labels: bool = False):
        super().__init__()
        self.labels = labels
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.number = 0, 0

    @property
    def hidden(self) -> int:
        """The place of the innermost open element whose text isn't rendered, or -1."""
        return self.stack[-1].hides if self.stack else -1

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = self.stack[-1] if self.stack else _ROOT
                self.blocks.append(Block(text, at.tags, at.hints, at.holder, self.linked, at.label))
            self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        for e in self.stack[at:]:
            self.open[e.tag] -= 1
        del self.stack[at:]

    def _end_head(self) -> None:
        """Close a head that is open with no hidden element open in it."""
        at = self.hidden
        if at >= 0 and self.stack[at].tag == "head":
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCK:
            self._flush()
            ends = ENDS.get(tag, ())
            k = self.stack[-1].stop if self.stack else -1
            while k >= 0:
                open_tag = self.stack[k].tag
                if open_tag == "p" or open_tag in ends:
                    self._pop(k)
                    break
                if open_tag in CONTAINER:
                    break
                k = self.stack[k - 1].stop if k else -1
        elif tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        if tag == "body" and self.hidden >= 0:
            self._pop(next(k for k, e in enumerate(self.stack) if e.tag in HIDDEN))
        above, place = self.stack[-1] if self.stack else _ROOT, len(self.stack)
        hints, label = above.hints, above.label
        if attrs:
            words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
            if words:
                for w in _SPLIT.split(words):
                    if w in _HINT:
                        hints |= _HINT_BIT[_HINT[w]]
            if self.labels and any(k == "data-label" for k, _ in attrs):
                label = 1
        self.number += 1
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(Element(tag, above.tags | _BIT.get(tag, 0), hints, self.number if tag in CONTAINER else above.holder, label, place if tag in STOPS else above.stop, place if tag in HIDDEN else above.hides))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self._pop(k)

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        if self.hidden < 0:
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len(data)


def blocks_of(html: str, labels: bool = False) -> list[Block]:
    parser = Blocks(labels)
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.blocks


# -- features ------------------------------------------------------------
_STEPS = (2, 5, 10, 20, 40, 80)
NAMES = [
    "bias", *(f"in_{t}" for t in _TAGS), *(f"hint_{h}" for h in HINTS), "article_only", "article_header", "bare", *(f"words_{s}" for s in (*_STEPS, "more")),
    "links_none", "links_some", "links_most", "ends_sentence", "commas", "copyright", "capitals", "digits", "first", "last",
]
INDEX = {n: i for i, n in enumerate(NAMES)}
_bits = lambda names, table=_BIT: sum(table[n] for n in names.split())
_BAD_TAGS, _BAD_HINTS = _bits("nav footer aside form button dialog menu"), _bits("menu foot side ad note talk", _HINT_BIT)
_HEADINGS, _INSIDE, _HEADER, _FRAME = _bits("h1 h2 h3 h4 h5 h6"), _bits("article main"), _bits("header"), _bits("article main nav header footer aside form")
_TAG_FEATURES, _HINT_FEATURES = [(_BIT[t], f"in_{t}") for t in _TAGS if t in _BIT], [(bit, f"hint_{h}") for h, bit in _HINT_BIT.items()]


def active(b: Block, k: int, n: int) -> list[int]:
    """Indices of the block's features (all 0/1)."""
    tags, hints = b.tags, b.hints
    on = ["bias", *(name for bit, name in _HINT_FEATURES if hints & bit), *(name for bit, name in _TAG_FEATURES if tags & bit)]
    if tags & _HEADINGS:
        on.append("in_h")
    inside = tags & _INSIDE
    if inside and not tags & _BAD_TAGS and not hints & _BAD_HINTS:
        on.append("article_only")
    if inside and tags & _HEADER:
        on.append("article_header")
    if not hints and not tags & _FRAME:
        on.append("bare")
    words = b.text.count(" ") + 1
    on.append(next((f"words_{s}" for s in _STEPS if words <= s), "words_more"))
    share = b.linked / max(1, len(b.text))
    on.append("links_none" if not b.linked else "links_some" if share < 0.5 else "links_most")
    if b.text[-1] in ".!?:\"'”’»…":
        on.append("ends_sentence")
    if b.text.count(",") >= 2:
        on.append("commas")
    if "©" in b.text or "(c)" in b.text:
        on.append("copyright")
    if b.text.isupper():
        on.append("capitals")
    if sum(map(str.isdigit, b.text)) * 4 > len(b.text):
        on.append("digits")
    if k == 0:
        on.append("first")
    if k == n - 1:
        on.append("last")
    return [INDEX[x] for x in on]


# -- labelled pages ------------------------------------------------------
def _words(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = "".join(r.choice(("an", "er", "thi", "ung", "les", "ción", "que", "de", "wo", "sta", "re", "in", "mo", "é", "ta")) for _ in range(r.choice((1, 1, 2, 2, 3))))
        out.append(w.capitalize() if not i or r.random() < 0.06 else w)
        if r.random() < 0.09 and i + 1 < n:
            out[-1] += r.choice((",", ".", ","))
    return " ".join(out) + ("." if r.random() < 0.8 else "")


def _content(r: random.Random) -> str:
    """Article elements, labelled."""
    out = []
    if r.random() < 0.85:
        h = f"<h1 data-label>{_words(r, r.randint(2, 9))}</h1>"
        out.append(f"<header>{h}</header>" if r.random() < 0.2 else h)
    for _ in range(r.randint(1, 8)):
        n = r.choice((1, 2, 4, 8, 15, 30, 60, 120))
        kind = r.random()
        if kind < 0.7:
            inner = _words(r, n)
            inner = f"<b>{inner}</b>" if r.random() < 0.15 else inner + f' <a href="#">{_words(r, 2)}</a> ' + _words(r, 3) if r.random() < 0.2 else inner
            out.append(f"<p data-label>{inner}" + ("" if r.random() < 0.2 else "</p>"))
        elif kind < 0.78:
            out.append(f"<h2 data-label>{_words(r, r.randint(1, 6))}</h2>")
        elif kind < 0.86:
            out.append("<ul>" + "".join(f"<li data-label>{_words(r, r.randint(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            out.append(f"<blockquote data-label>{_words(r, n)}</blockquote>")
        elif kind < 0.96:
            out.append(f"<pre data-label>{_words(r, n)}</pre>")
        else:
            out.append(f"<table><tr><td data-label>{_words(r, 2)}</td><td data-label>{_words(r, 3)}</td></tr></table>")
    return "".join(out)


def _menu(r: random.Random) -> str:
    links = "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(r.randint(2, 8)))
    tag = r.choice(("nav", "nav", 'div class="menu"', 'div id="navbar"', 'div class="breadcrumbs"'))
    return f"<{tag}><ul>{links}</ul></{tag.split()[0]}>"


def _extra(r: random.Random) -> str:
    """One boilerplate element that may stand anywhere."""
    long, n = _words(r, r.choice((5, 12, 30, 60))), r.randint(2, 8)
    return r.choice((
        f'<div class="ad">{long}</div>', f'<div class="advert-box"><p>{long}</p></div>', f'<aside><h3>{_words(r, 2)}</h3><p>{long}</p></aside>',
        f'<div class="sidebar"><ul><li>{_words(r, n)}</li><li><a href="/x">{_words(r, 3)}</a></li></ul></div>',
        f'<div class="cookie-notice"><p>{long}</p><button>{_words(r, 1)}</button></div>', f'<div role="dialog" class="consent">{long}</div>',
        f'<form action="/s"><label>{_words(r, 2)}</label><input name="q"><button>{_words(r, 1)}</button></form>',
        f'<section class="comments"><h3>{_words(r, 2)}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{_words(r, n)}</p></div></section>',
        f'<div id="disqus"><p>{long}</p></div>', f'<div class="newsletter signup"><p>{long}</p></div>', f'<div class="share"><a href="#">{_words(r, 1)}</a></div>',
        f'<ul class="related">{"".join(f"<li><a href=/r{i}>{_words(r, 5)}</a></li>" for i in range(3))}</ul>',
    ))


def _page(r: random.Random) -> str:
    if r.random() < 0.04:  # text and little else
        return f"<html data-label>{_words(r, r.choice((12, 40, 120)))}</html>"
    head = f'<head><title>{_words(r, 4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    body = [_menu(r) if r.random() < 0.9 else ""]
    if r.random() < 0.5:
        tag = r.choice(("header", 'div class="header"', 'div id="masthead"'))
        body.append(f'<{tag}><a href="/">{_words(r, 2)}</a><p>{_words(r, r.randint(2, 12))}</p></{tag.split()[0]}>')
    body += [_extra(r) for _ in range(r.randint(0, 3))]
    inner = _content(r)
    if r.random() < 0.35:
        inner += _extra(r) + (f"<p data-label>{_words(r, 25)}</p>" if r.random() < 0.5 else "")
    if r.random() < 0.15:
        inner += f"<footer>{_words(r, 8)}</footer>"
    tag = r.choice(("article", "article", "article", "main", "main", 'div class="content"', 'div class="post entry"', 'div id="story"', "div", "td"))
    body.append(f"<table><tr><td>{inner}</td></tr></table>" if tag == "td" else f"<{tag}>{inner}</{tag.split()[0]}>")
    body += [_extra(r) for _ in range(r.randint(0, 3))]
    if r.random() < 0.9:
        tag = r.choice(("footer", "footer", 'div class="footer"'))
        body.append(f"<{tag}>{r.choice(('&copy; ', '', '&copy; 2024 '))}{_words(r, r.randint(2, 25))} &middot; <a href='/p'>{_words(r, 2)}</a></{tag.split()[0]}>")
    return f"<!DOCTYPE html><html>{head}<body>{''.join(body)}</body></html>"


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Pages of random layout whose article elements have the attribute data-label."""
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]


# -- the field -----------------------------------------------------------
@dataclass
class Field:
    """Weights of two labels (0 boilerplate, 1 article): by feature, and by label before and after for a new and the same parent."""

    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    lists: tuple = field(default=(), repr=False)

    def label(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not self.lists:
            self.lists = (self.weights.tolist(), self.steps.tolist(), self.start.tolist())
        (w0, w1), steps, start = self.lists
        n, back = len(blocks), []
        s0 = s1 = 0.0
        for k, b in enumerate(blocks):
            on = active(b, k, n)
            u0, u1 = math.fsum([w0[i] for i in on]), math.fsum([w1[i] for i in on])
            if not k:
                s0, s1 = start[0] + u0, start[1] + u1
                continue
            a = steps[b.parent == blocks[k - 1].parent]
            f0, f1 = s0 + a[0][0] < s1 + a[1][0], s0 + a[0][1] < s1 + a[1][1]
            back.append((f0, f1))
            s0, s1 = max(s0 + a[0][0], s1 + a[1][0]) + u0, max(s0 + a[0][1], s1 + a[1][1]) + u1
        at = int(s1 > s0)
        out = [at] if blocks else []
        for f in reversed(back):
            at = int(f[at])
            out.append(at)
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train_field(pages: list[str], rounds: int = 200, rate: float = 0.1, ridge: float = 0.5) -> Field:
    """Maximum conditional likelihood by Adam; forward and backward sums run over all pages at once."""
    chains = [c for c in (blocks_of(p, labels=True) for p in pages) if c]
    pages_n, steps_n, nf = len(chains), max(map(len, chains)), len(NAMES)
    x, y, same = np.zeros((pages_n, steps_n, nf)), np.zeros((pages_n, steps_n), int), np.zeros((pages_n, steps_n), int)
    real = np.zeros((pages_n, steps_n), bool)
    for i, chain in enumerate(chains):
        for k, b in enumerate(chain):
            x[i, k, active(b, k, len(chain))] = 1
            y[i, k], real[i, k] = b.label, True
            same[i, k] = int(k > 0 and b.parent == chain[k - 1].parent)
    hot = np.eye(2)[y] * real[:, :, None]
    theta = [np.zeros((2, nf)), np.zeros((2, 2, 2)), np.zeros(2)]
    moment = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    pair_true = np.zeros((2, 2, 2))
    for k in range(1, steps_n):
        np.add.at(pair_true, (same[real[:, k], k], y[real[:, k], k - 1], y[real[:, k], k]), 1)
    for step in range(1, rounds + 1):
        w, a, s = theta
        u = x @ w.T
        alpha, beta = np.zeros((pages_n, steps_n, 2)), np.zeros((pages_n, steps_n, 2))
        alpha[:, 0] = u[:, 0] + s
        for k in range(1, steps_n):
            nxt = _lse(alpha[:, k - 1, :, None] + a[same[:, k]], 1) + u[:, k]
            alpha[:, k] = np.where(real[:, k, None], nxt, alpha[:, k - 1])
        for k in range(steps_n - 2, -1, -1):
            nxt = _lse(a[same[:, k + 1]] + (u[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(real[:, k + 1, None], nxt, beta[:, k + 1])
        z = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        pair = np.zeros((2, 2, 2))
        for k in range(1, steps_n):
            q = np.exp(alpha[:, k - 1, :, None] + a[same[:, k]] + (u[:, k] + beta[:, k])[:, None, :] - z[:, None, None]) * real[:, k, None, None]
            np.add.at(pair, same[:, k], q)
        grads = [np.einsum("pkl,pkf->lf", hot - p, x) - ridge * w, pair_true - pair - ridge * a, (hot[:, 0] - p[:, 0]).sum(axis=0) - ridge * s]
        for t, g, (m, v) in zip(theta, grads, moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*theta)


@functools.cache
def default_field() -> Field:
    return train_field(labelled_pages())


def extract(html: str, crf: Field) -> str:
    blocks = blocks_of(html)
    return " ".join(b.text for b, y in zip(blocks, crf.label(blocks), strict=True) if y)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", crf: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    crf = crf or default_field()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h, crf) for h in texts_of(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), kernel, "page_id long, url string, text string, n_chars long")
