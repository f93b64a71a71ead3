"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is described
by its ancestors (tags, hints in class, id and role) and by its text (length, links, stops);
the field scores the two labels of a block from these and from the label before it, and
Viterbi decoding picks the best sequence. Blocks labelled main are joined in page order.

Training pages are HTML in which elements carry ``data-label="main"`` or ``"other"``; the
nearest such ancestor labels a block. ``labelled_pages`` makes them from a layout grammar, so
no label comes from the pages that are read. The likelihood is maximised by full gradients.

Defined cases: a null or empty page has the empty text; character references are decoded; tags
left open or cut off at the end of the page close there; a quote that does not follow "=" or is never
closed is an ordinary character of its tag; end tags without a start are skipped; very long and deeply
nested pages take time in proportion to their length; scripts, styles, templates, comments,
form controls and the head are never text; formulas (MathML), the text of drawings (SVG) and
fallback text (noscript, object, canvas, iframe, audio, video) are inline text of their block;
an svg or math tag that ends in "/>" closes at once; repeated rows are alike; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset("math svg".split())
FALLBACK = frozenset("noscript object canvas iframe audio video".split())
INLINE = FOREIGN | FALLBACK | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
UNSEEN = frozenset("script style template head title select textarea button".split())
#: Elements that do not end the block they stand in.
WITHIN = INLINE | UNSEEN - {"head", "title"}
RAW = frozenset("script style textarea title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section table ul dt dd".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Elements that a paragraph cannot be closed across.
ENDS_P = ("table", "td", "th", "article", "body", "div", "section")

#: Tags that mean in a drawing or formula what they mean elsewhere; its other tags are inline.
HTML_IN_FOREIGN = VOID | INLINE | UNSEEN - {"title"} | CLOSES_P | frozenset(SIBLINGS) | frozenset("html body caption tbody tfoot thead".split())
#: Elements of a drawing whose text stands apart.
APART = frozenset("text title desc".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|data-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HINTS = [
    ("nav", r"nav|menu|breadcrumb|pager|paginat|toc|tabs|skip"),
    ("foot", r"foot|copyright|legal|colophon|bottom"),
    ("head", r"header|masthead|logo|brand|topbar|top-bar|site-title"),
    ("side", r"side|aside|widget|related|recommend|popular|trending|read-?more|more-|teaser|also|rail"),
    ("comment", r"comment|disqus|repl(?:y|ies)|discussion|responses|guestbook|feedback|review"),
    ("ad", r"(?:^|[-_ ])ads?(?:[-_ ]|$)|advert|sponsor|promo|banner|adsense|adslot|adbox|dfp|outbrain|taboola"),
    ("notice", r"cookie|consent|notice|gdpr|privacy|alert|popup|modal|overlay|subscribe|newsletter|paywall|announce|warning|signup|banner"),
    ("form", r"form|login|search|sign-?in|register|contact"),
    ("share", r"share|social|follow|tags?(?:[-_ ]|$)|meta|byline"),
    ("main", r"article|content|post(?:[-_ ]|$)|entry|story|main|body|text"),
]
_HINTS = [(name, re.compile(p, re.I)) for name, p in _HINTS]
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"']*/\Z")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    features: frozenset
    label: str | None


@lru_cache(maxsize=20_000)
def _own(tag: str, attributes: str) -> tuple[frozenset, str | None]:
    """Features that an element gives to all blocks below it, and its label."""
    found, label = {f"in:{tag}"} if tag not in INLINE else set(), None
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "data-label":
            label = value
        elif name == "hidden" or name == "style" and _HIDDEN.search(value):
            found.add("hidden")
        elif name in ("class", "id", "role", "aria-label"):
            found.update(f"hint:{hint}" for hint, p in _HINTS if p.search(value))
    return frozenset(found), label


def _text_features(text: str, in_links: int, tag: str) -> list[str]:
    words = text.count(" ") + 1
    share = in_links / max(1, len(text))
    out = [
        f"tag:{tag}", f"words:{min(6, words.bit_length())}", f"links:{0 if share < 0.05 else 1 if share < 0.4 else 2}",
        "stop" if text[-1] in ".!?:…»\"”'" else "open",
    ]
    if "©" in text or "(c)" in text:
        out.append("copyright")
    if text.count(",") + text.count(".") >= 3:
        out.append("sentences")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return out


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page, in order."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, str | None, bool]] = [("", frozenset(), None, False)]
    # places in the stack: of each tag, of what an inline end tag cannot leave, of all but inline elements
    places: dict[str, list[int]] = {}
    walls: list[int] = [0]
    lumps: list[int] = [0]
    parts: list[str] = []
    linked, in_link, foreign, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                below = stack[lumps[-1]]
                out.append(Block(text, below[1].union(_text_features(text, linked, below[0])), stack[-1][2]))
        linked = 0

    def close(k: int) -> None:
        nonlocal in_link, foreign
        in_link -= sum(1 for e in stack[k:] if e[0] == "a")
        foreign -= sum(1 for e in stack[k:] if e[0] in FOREIGN)
        for e in stack[k:]:
            places[e[0]].pop()
        for at in (walls, lumps):
            while at[-1] >= k:
                at.pop()
        del stack[k:]

    def last(tags: tuple) -> int:
        """Place of the innermost open element of these tags; 0 for none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def leave(tags: tuple, scope: tuple) -> None:
        """Close the innermost open element of ``tags`` unless an element of ``scope`` lies within it."""
        if (k := last(tags)) > last(scope):
            close(k)

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][3]:
            parts.append(raw := unescape(raw))
            if in_link:
                linked += len(raw)

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if foreign and html.startswith("<![CDATA[", m.start()):
                end = html.find("]]>", m.start() + 9)
                end = len(html) if end < 0 else end
                text(html[m.start() + 9 : end].replace("&", "&amp;"))
                at = end + 3
            continue
        if foreign or tag in FOREIGN:
            closed = m[3].endswith("/") and not _UNQUOTED_SLASH.search(m[3])
            if tag not in HTML_IN_FOREIGN:
                if tag in APART:
                    text(" ")
                continue
            if not m[1] and closed and (tag in FOREIGN or tag in RAW):
                continue
            if not m[1] and (tag in CLOSES_P or tag in SIBLINGS):  # a block ends the drawing
                close(min(places[t][0] for t in FOREIGN if places.get(t)))
        if m[1]:
            if k := last((tag,)):
                if tag not in WITHIN:
                    flush()
                elif walls[-1] > k:
                    continue  # an inline end tag does not close blocks
                close(k)
            elif tag in ("p", "br"):
                flush() if tag == "p" else text(" ")
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in WITHIN:
            flush()
            if tag in CLOSES_P:
                leave(("p",), ENDS_P)
            if tag in SIBLINGS:
                leave(SIBLINGS[tag], SCOPES[tag])
        if tag in VOID:
            continue
        if tag == "body":
            leave(("head",), ENDS_P)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        own, label = _own(tag, m[3])
        above = stack[-1]
        if tag in ("header", "footer", "aside", "form"):
            own = own | {f"in:{tag}@{'article' if 'in:article' in above[1] or 'in:main' in above[1] else 'page'}"}
        places.setdefault(tag, []).append(len(stack))
        if tag not in WITHIN:
            walls.append(len(stack))
        if tag not in INLINE:
            lumps.append(len(stack))
        stack.append((tag, above[1] | own, label or above[2], above[3] or tag in UNSEEN))
        in_link += tag == "a"
        foreign += tag in FOREIGN
    text(html[at:])
    flush()
    return out


@dataclass
class Field:
    """Weights of features for the label main, and of label changes."""

    weights: dict[str, float]
    change: np.ndarray  # 2 x 2, from label to label
    start: np.ndarray

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi labels: which blocks are main."""
        if not page:
            return []
        get = self.weights.get
        bias = self.weights["bias"]
        (a, b), (c, d) = self.change.tolist()
        back = []
        s0 = s1 = 0.0
        for k, block in enumerate(page):
            gain = bias + sum([get(f, 0.0) for f in block.features])
            if k == 0:
                s0, s1 = float(self.start[0]), float(self.start[1]) + gain
            else:
                from0, from1 = s0 + a >= s1 + c, s0 + b >= s1 + d
                back.append((from0, from1))
                s0, s1 = max(s0 + a, s1 + c), max(s0 + b, s1 + d) + gain
        label = s1 > s0
        labels = [label]
        for from0, from1 in reversed(back):
            label = not (from1 if label else from0)
            labels.append(label)
        return labels[::-1]


def fit(pages: list[str], steps: int = 150, rate: float = 0.15, decay: float = 5e-4) -> Field:
    """Maximum likelihood (with a Gaussian prior) on labelled pages."""
    parsed = [p for p in ([b for b in blocks(h) if b.label] for h in pages) if p]
    names = sorted({f for p in parsed for b in p for f in b.features} | {"bias"})
    number = {f: i for i, f in enumerate(names)}
    longest = max(map(len, parsed))
    x = np.zeros((len(parsed), longest, len(names)), dtype=np.float32)
    y = np.zeros((len(parsed), longest), dtype=np.int64)
    live = np.zeros((len(parsed), longest), dtype=bool)
    for i, p in enumerate(parsed):
        for j, b in enumerate(p):
            x[i, j, [number["bias"], *(number[f] for f in b.features)]] = 1
            y[i, j], live[i, j] = b.label == "main", True
    flat, theta = x[live], np.zeros(len(names) + 6)
    pair_live = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair_live], y[:, 1:][pair_live]), 1)
    seen_start = np.bincount(y[:, 0], minlength=2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        w, change, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        emit = np.zeros((len(parsed), longest, 2))
        emit[live, 1] = flat @ w.astype(np.float32)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + change, axis=1) + emit[:, t]
            ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(change + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        one = np.exp(ahead + behind - z[:, None, None])[..., 1] * live
        pairs = np.exp(ahead[:, :-1, :, None] + change + (emit + behind)[:, 1:, None, :] - z[:, None, None, None]) * pair_live[..., None, None]
        grad = np.concatenate([
            (y - one)[live].astype(np.float32) @ flat, (seen - pairs.sum(axis=(0, 1))).ravel(), seen_start - np.stack([1 - one[:, 0], one[:, 0]]).sum(axis=1),
        ]) / len(parsed) - decay * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Field(dict(zip(names, theta[:-6].tolist())), theta[-6:-2].reshape(2, 2), theta[-2:])


def labelled_pages(n: int = 300, seed: int = 7) -> list[str]:
    """Training pages from a grammar of layouts: where the article is, and what surrounds it."""
    rng = Random(seed)
    pick = lambda *options: options[int(rng.random() * len(options))]
    chance = lambda p: rng.random() < p
    stock = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(2, 9))) for _ in range(2_000)]

    def words(low: int, high: int) -> str:
        return " ".join(rng.choices(stock, k=rng.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join((words(2, 14).capitalize() + pick(".", ".", ".", ", " + words(1, 6) + ".", "?")) for _ in range(rng.randint(low, high)))

    def links(low: int, high: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{k}'>{words(1, 5)}</a></{tag}>" for k in range(rng.randint(low, high)))

    def attributes(*names: str) -> str:
        return pick("", f' class="{pick(*names)}"', f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{words(1, 1)} {pick(*names)}"')

    def neutral() -> str:
        return f' {pick("class", "id")}="{pick("page", "container", "wrapper", "row", "col", "inner", "block", "box", words(1, 1))}"'

    def wrap(body: str, tag: str, names: tuple[str, ...], plain: float, label: str = "other") -> str:
        """A labelled element that shows what it is by its tag or only by its names."""
        if chance(plain):
            return f'<{tag}{attributes(*names)} data-label="{label}">{body}</{tag}>'
        return f'<{pick("div", "section", "div")} {pick("class", "id", "class")}="{pick(*names)}" data-label="{label}">{body}</div>'

    def menu() -> str:
        return wrap(pick(f"<ul>{links(3, 9)}</ul>", links(3, 9, "span"), links(2, 6, "div")), "nav", ("nav", "menu", "main-menu", "breadcrumbs", "navbar", "pagination"), 0.7)

    def banner() -> str:
        return wrap(pick(f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 6)}</p>", words(1, 4), f"<a href='/'>{words(1, 3)}</a>") + pick("", menu()), "header", ("site-header", "masthead", "header", "topbar", "brand"), 0.7)

    def foot() -> str:
        body = pick(f"&copy; {words(1, 2)} {pick('', '&middot; ' + sentences(1, 2))}", f"<p>&copy; 2020 {words(2, 5)}</p><ul>{links(2, 5)}</ul>", f"<p>{sentences(1, 3)}</p>")
        return wrap(body, "footer", ("footer", "site-footer", "bottom", "legal", "copyright"), 0.7)

    def advert() -> str:
        body = pick(sentences(1, 3), f"<p>{sentences(1, 2)}</p>", f"<a href='/x'>{words(2, 8)}</a>", f"<p>{words(1, 3)}</p><p>{sentences(1, 2)}</p>")
        return f'<{(t := pick("div", "div", "aside", "section"))} {pick("class", "id", "class")}="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "ad-box")}" data-label="other">{body}</{t}>'

    def side() -> str:
        body = "".join(pick(f"<h3>{words(1, 4)}</h3><ul>{links(3, 7)}</ul>", f"<h4>{words(1, 3)}</h4><p>{sentences(1, 2)}</p>", f"<p>{sentences(1, 3)}</p>") for _ in range(rng.randint(1, 3)))
        return wrap(body, "aside", ("sidebar", "widget", "related", "side", "recommended", "popular-posts", "right-rail", "related-articles"), 0.6)

    def notice() -> str:
        body = pick(f"<p>{sentences(1, 3)}</p>", sentences(1, 2), f"<p>{sentences(1, 2)}</p><button>{words(1, 2)}</button><a href='/p'>{words(1, 3)}</a>")
        return f'<{(t := pick("div", "div", "section", "p" if body[0] != "<" else "div"))} {pick("class", "id", "role", "class")}="{pick("cookie-notice", "cookie", "notice", "consent", "gdpr-banner", "alert", "newsletter", "subscribe-box", "paywall", "popup", "announcement", "cookie-banner")}" data-label="other">{body}</{t}>'

    def form() -> str:
        body = pick(f"<label>{words(1, 3)}</label><input name='q'>" * rng.randint(1, 2), "<input name='e'>") + pick("", f"<p>{sentences(1, 2)}</p>", f"<p>{words(2, 6)}</p>") + f"<button>{words(1, 2)}</button>"
        return f'<form{attributes("search", "login", "newsletter-form", "contact-form")} data-label="other">{body}</form>'

    def comments() -> str:
        one = lambda: pick(f"<div class='comment'><b>{words(1, 2)}</b><p>{sentences(1, 5)}</p></div>", f"<li><p>{sentences(1, 4)}</p></li>", f"<p>{sentences(1, 4)}</p>", f"<article class='comment'><p>{sentences(1, 4)}</p></article>")
        body = pick("", f"<h3>{words(1, 3)}</h3>") + "".join(one() for _ in range(rng.randint(1, 6)))
        return f'<{(t := pick("section", "div", "div", "ol"))} {pick("class", "id", "id")}="{pick("comments", "comment-list", "comments-area", "disqus_thread", "responses", "discussion", "reader-comments", "replies")}" data-label="other">{body}</{t}>'

    def share() -> str:
        return f'<{(t := pick("ul", "div"))} class="{pick("share", "social", "share-buttons", "tags")}" data-label="other">{links(2, 5, "li" if t == "ul" else "span")}</{t}>'

    def article() -> str:
        title = pick(f"<h1>{words(1, 10).capitalize()}</h1>", f"<h1>{sentences(1, 1)}</h1>", f"<header><h1>{words(2, 9)}</h1></header>", f"<h2>{words(2, 9)}</h2>", "")
        parts = [title]
        for _ in range(rng.randint(1, 13)):
            parts.append(pick(
                f"<p>{sentences(1, 8)}</p>", f"<p>{sentences(1, 8)}</p>", f"<p>{sentences(2, 12)}</p>", f"<p>{sentences(1, 2)}", f"<p>{words(1, 2).capitalize()}.</p>",
                f"<p><b>{words(1, 12)}.<br><p>{sentences(1, 6)}</p>", f"<h2>{words(1, 6)}</h2><p>{sentences(1, 6)}</p>", f"<p>{sentences(1, 3)} <a href='/z'>{words(1, 4)}</a> {sentences(1, 3)}</p>",
                f"<ul><li>{words(1, 12)}</li><li>{sentences(1, 2)}</li><li>{words(1, 8)}</li></ul>", f"<blockquote><p>{sentences(1, 4)}</p></blockquote>",
                f"<p>{words(20, 120)}</p>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 6)}</td></tr></table>", f"<figure><img src='/i'><figcaption>{sentences(1, 1)}</figcaption></figure>",
                f"<pre>{words(3, 30)}</pre>", f"<h3>{words(1, 5)}</h3><div>{sentences(1, 5)}</div>",
            ))
            if chance(0.12):
                parts.append(pick(advert, advert, notice, form, side, share)())
        if chance(0.2):
            parts.append(pick(comments, share)())
        if chance(0.3):  # nothing but the text says that this is the article
            t = pick("div", "div", "section", "td")
            return f'<{t}{pick("", neutral(), neutral())} data-label="main">{"".join(parts)}</{t}>'
        if chance(0.55):
            return f'<article{attributes("post", "entry", "story", "article")} data-label="main">{"".join(parts)}</article>'
        if chance(0.35):
            return f'<main{attributes("content", "main")} data-label="main">{"".join(parts)}</main>'
        return f'<div {pick("class", "id")}="{pick("content", "post", "article-body", "entry-content", "story", "main", "post-content", "text", "article")}" data-label="main">{"".join(parts)}</div>'

    def page() -> str:
        before = [f() for f in (banner, menu, notice, advert, form, share) if chance(0.45)]
        after = [f() for f in (comments, side, advert, notice, form, share, foot, foot) if chance(0.45)]
        rng.shuffle(before)
        if chance(0.12):
            before, after = [], []
        if chance(0.1):  # paragraphs straight in the body
            middle = "".join(f'<p data-label="main">{sentences(1, 6)}</p>' for _ in range(rng.randint(1, 8)))
        else:
            middle = f"<{(t := pick('main', 'div'))}>{article()}{pick('', side())}</{t}>" if chance(0.4) else article()
        if chance(0.1):  # laid out by a table
            rest = "".join(f'<td{pick("", neutral())}>{f()}</td>' for f in (menu, side, menu) if chance(0.5))
            middle = f"<table{pick('', neutral())}><tr>{rest}<td>{middle}</td></tr></table>"
        body = "".join(before) + middle + "".join(after)
        if chance(0.4):
            body = f"<div{neutral()}>{body}</div>"
        if chance(0.05):
            return body
        return f"<html><head><title>{words(1, 5)}</title></head><body>{body}" + pick("</body></html>", "")

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted on the grammar's pages, the same in every run."""
    return fit(labelled_pages())


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return "\n\n".join(b.text for b, main in zip(page, field.decode(page)) if main)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every page."""
    held = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(h, held.value) for h in b], dtype=object)

    text = F.pandas_udf(run, "string")
    return pages.select("page_id", "url", text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
