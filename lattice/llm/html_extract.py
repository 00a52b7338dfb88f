"""Operator 4: main text of HTML pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags. Each block has features of its ancestors' tags, classes, ids and roles and
of its text (length, share of link text, closing punctuation and the like). The
field has two labels, main text and rest, one weight for each feature and one
for each pair of neighbouring labels; it is trained by maximum likelihood
(forward-backward, Adam) on labelled pages and decoded by Viterbi.

No table holds labels for pages, so ``labelled_pages`` composes ``TRAINING_PAGES``
pages from a seed: articles of many shapes among menus, headers, notices,
adverts, sidebars, forms, comments and footers, each block with its label. That
bound is the model's only sample; extraction covers whole pages.

Defined cases: null or empty html gives an empty text; text outside any tag is a
block of its own; open or stray tags are closed as browsers do for paragraphs,
list items and cells, and else ignored; an unclosed script or style runs to the
end, a head ends before the first thing that no head may hold, a self-closed svg
is empty, and other hidden elements without an end tag hide nothing; rows
with equal ``page_id`` are extracted each by its own html; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 400

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^<]+|<)""",
    re.S | re.I,
)
#: What a head may hold; anything else ends it, whether or not it has an end tag.
_HEAD = re.compile(
    r"""\s++|<!--.*?-->|<(script|style|title|noscript|template)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?</\1\s*>"""
    r"""|<(?:meta|link|base|basefont|bgsound)\b(?:[^>"']|"[^"]*"|'[^']*')*+>""",
    re.S | re.I,
)
_HEAD_END = re.compile(r"</head\s*>", re.I)
#: Elements without text of their own to show: left out up to their end tag, if there is one.
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("noscript", "template", "svg", "iframe")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open ones, up to the nearest of the tags after them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_P = ({"p"}, {"td", "th", "li", "div", "section", "article", "body", "button"})


def _tokens(page: str) -> Iterator[tuple[str, str, str, str, str]]:
    """The groups of ``_TOKEN``, in order; heads and hidden elements count as one skipped element."""
    skipped = ("head", "", "", "", "")
    last: dict[str, int] = {}
    at = 0
    while at < len(page):
        found = _TOKEN.match(page, at)
        if not found:
            at += 1
            continue
        at = found.end()
        raw, end, tag, attributes, text = (x or "" for x in found.groups())
        name = "" if end else tag.lower()
        if name == "head":
            while held := _HEAD.match(page, at):
                at = held.end()
            closed = _HEAD_END.match(page, at)
            at = closed.end() if closed else at
            yield skipped
        elif name in _HIDDEN:
            if name not in last:
                last[name] = max((x.start() for x in _HIDDEN[name].finditer(page)), default=-1)
            if not (name == "svg" and attributes.endswith("/")) and at <= last[name]:
                at = _HIDDEN[name].search(page, at).end()
            yield skipped
        else:
            yield raw, end, tag, attributes, text


def leaf_blocks(page: str) -> list[tuple[str, list[tuple[str, tuple[str, ...]]], int, int]]:
    """(text, ancestors as (tag, names in its class, id and role), characters, characters in links) of each leaf block."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((text, [x for x in stack], len(text), min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(names: set[str], within: set[str]) -> None:
        nonlocal links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                links -= sum(x[0] == "a" for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    for raw, end, tag, attributes, text in _tokens(page):
        if text:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if not tag:
            if raw:
                parts.append(" ")
            continue
        tag = tag.lower()
        is_block = tag in BLOCK_TAGS
        if tag == "br":
            parts.append(" ")
        if is_block:
            flush()
        if end:
            close({tag}, set())
            continue
        if tag in VOID_TAGS:
            continue
        if is_block:
            close(*_ENDS.get(tag, _P))
        if tag == "a":
            links += 1
        names = tuple(x.lower() for a in _ATTRIBUTE.findall(attributes) for x in _NAME.findall(a[1] or a[2] or a[3])) if "=" in attributes else ()
        stack.append((tag, names))
    flush()
    return out


def features(blocks: list) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    for text, ancestors, size, linked in blocks:
        names = {f"in:{tag}" for tag, _ in ancestors if tag in BLOCK_TAGS or tag in ("a", "label")} | {f"name:{x}" for _, own in ancestors for x in own}
        own = next((tag for tag, _ in reversed(ancestors) if tag in BLOCK_TAGS), "")
        n_words = text.count(" ") + 1
        names |= {f"own:{own}", f"words:{min(6, n_words.bit_length())}", f"links:{linked * 4 // max(1, size)}", "bias"}
        if text[-1] in ".!?…:;”\"'":
            names.add("stops")
        if "©" in text or "copyright" in text.lower():
            names.add("rights")
        if "|" in text or "·" in text:
            names.add("bars")
        out.append(sorted(names))
    return out


_SYLLABLES = "an be cor da el fi gra hu in jo ka lo mi nu or pa que ri so ta un ve wi xa yo zu".split()


def labelled_pages(n: int, seed: int = 4) -> list[tuple[str, list[tuple[str, int]]]]:
    """Composed pages with the label (1: main text) of each of their blocks, in order."""
    rnd = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(a, b)))

    def sentence(a: int = 4, b: int = 40) -> str:
        text = words(a, b)
        return text[0].upper() + text[1:] + rnd.choice([".", ".", ".", "!", "?", ""])

    pages = []
    for _ in range(n):
        found: list[tuple[str, int]] = []

        def leaf(tag: str, text: str, label: int, link: float = 0.0) -> str:
            found.append((text, label))
            inner = f'<a href="/{words(1, 1)}">{text}</a>' if rnd.random() < link else rnd.choice([text, text, f"<b>{text}</b>", f"<span>{text}</span>"])
            return f"<{tag}>{inner}" + ("" if tag in ("p", "li") and rnd.random() < 0.2 else f"</{tag}>")

        def box(tags: list[str], inner) -> str:
            opening = rnd.choice(tags)
            return f"<{opening}>{inner()}</{opening.split()[0]}>"

        def listed(a: int, b: int, label: int, link: float) -> str:
            return "<ul>" + "".join(leaf("li", words(1, 4) if not label else sentence(), label, link) for _ in range(rnd.randint(a, b))) + "</ul>"

        def several(a: int, b: int, make) -> str:
            return "".join(make() for _ in range(rnd.randint(a, b)))

        def any_leaf(label: int = 0, link: float = 0.3) -> str:
            return leaf(rnd.choice(["p", "div", "h3", "p"]), sentence(2, 25), label, link)

        def menu() -> str:
            return box(["nav", "nav", 'div class="menu"', 'div id="nav"', 'div role="navigation"', 'ul class="breadcrumbs"'], lambda: listed(2, 9, 0, 0.95))

        def header() -> str:
            return box(["header", 'div class="header"', 'div id="site-header"', 'div class="masthead"', 'div role="banner"'], lambda: several(1, 3, any_leaf) + (menu() if rnd.random() < 0.5 else ""))

        def notice() -> str:
            return box(['div class="notice"', 'div class="cookie-notice"', 'div id="cookie-banner"', 'div role="alert"', 'div class="alert"', 'div class="consent"', 'div class="popup"', "dialog"], lambda: several(1, 2, any_leaf))

        def advert() -> str:
            def bare() -> str:
                text = sentence(3, 20)
                found.append((text, 0))
                return text

            return box(['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div id="banner"', 'div class="promo"', 'aside class="ad"', 'section class="ad"'], rnd.choice([bare, lambda: several(1, 2, any_leaf)]))

        def sidebar() -> str:
            return box(["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"', 'aside class="sidebar"', 'div role="complementary"'], lambda: several(1, 4, any_leaf) + (listed(2, 6, 0, 0.8) if rnd.random() < 0.6 else ""))

        def form() -> str:
            return box(["form", 'form class="newsletter"', 'div class="subscribe"', 'form class="search"', 'form id="login"'], lambda: several(1, 3, lambda: leaf(rnd.choice(["label", "button", "p", "div"]), words(1, 8), 0)))

        def comments() -> str:
            return box(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="comments"', 'div class="discussion"', 'ol class="comments"', 'div class="reader-comments"', 'div class="responses"'],
                       lambda: several(1, 5, lambda: box(['div class="comment"', "div", "article class='comment'", "li"], lambda: several(1, 3, lambda: leaf(rnd.choice(["p", "div", "p"]), sentence(3, 40), 0)))))

        def footer() -> str:
            def bare() -> str:
                text = rnd.choice(["© ", "Copyright ", ""]) + words(1, 2) + rnd.choice([" · ", " | ", " "]) + sentence(2, 14)
                found.append((text, 0))
                return text

            return box(["footer", "footer", 'div class="footer"', 'div id="footer"', 'div role="contentinfo"', 'div class="site-footer"'], rnd.choice([bare, bare, lambda: several(1, 3, any_leaf)]))

        def share() -> str:
            return box(['div class="share"', 'div class="social"', 'ul class="tags"', 'div class="toolbar"'], lambda: several(1, 3, lambda: leaf("li", words(1, 3), 0, 0.8)))

        def body() -> str:
            kinds = rnd.choices(["p", "p", "p", "short", "h2", "list", "quote", "table", "pre", "figure", "bare"], k=rnd.randint(1, 14))
            made = []
            for kind in kinds:
                if kind == "p":
                    made.append(leaf("p", sentence(5, 80), 1, 0.03))
                elif kind == "short":
                    made.append(leaf("p", sentence(1, 6), 1, 0.1))
                elif kind == "h2":
                    made.append(leaf(rnd.choice(["h2", "h3"]), words(1, 9), 1))
                elif kind == "list":
                    made.append(listed(2, 5, 1, 0.1))
                elif kind == "quote":
                    made.append(f"<blockquote>{leaf('p', sentence(), 1)}</blockquote>")
                elif kind == "table":
                    made.append("<table>" + "".join(f"<tr>{leaf('td', words(1, 4), 1)}{leaf('td', words(1, 4), 1)}</tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
                elif kind == "pre":
                    made.append(leaf("pre", words(3, 12), 1))
                elif kind == "figure":
                    made.append(f"<figure><img src='x.png'>{leaf('figcaption', sentence(2, 12), 1)}</figure>")
                else:
                    made.append(leaf("div", sentence(5, 60), 1))
                if rnd.random() < 0.06:
                    made.append(rnd.choice([advert, share, form, sidebar, notice])())
            return "".join(made)

        def main() -> str:
            def inner() -> str:
                title = leaf("h1", words(2, 12), 1) if rnd.random() < 0.85 else ""
                text = title + (share() if rnd.random() < 0.15 else "") + body()
                return text + (comments() if rnd.random() < 0.15 else "") + (menu() if rnd.random() < 0.05 else "")

            return box(["article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry"', 'section class="article-body"', 'div class="story"', 'div role="main"'], inner)

        def script() -> str:
            return rnd.choice(["<script>var a='<p>x</p>';</script>", "<style>p{margin:0}</style>", "<!-- note -->"])

        before, after = rnd.sample([header, menu, notice, advert, form, menu, script], rnd.randint(1, 4)), rnd.sample([sidebar, comments, form, advert, footer, notice, menu, script], rnd.randint(0, 4))
        made = [f() for f in before] + [main()] + [f() for f in after] + ([footer()] if rnd.random() < 0.8 else [])
        text = "".join(made)
        if rnd.random() < 0.3:
            text = rnd.choice(['<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>', "<main>{}</main>"]).format(text)
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{text}</body></html>", found))
    return pages


class Field:
    """Weights of the features, of the label pairs and of the first label."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        get = self.weights.get
        (stay0, go1), (go0, stay1) = self.pairs
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for i, names in enumerate(feats):
            e = 0.0
            for x in names:
                e += get(x, 0.0)
            if not i:
                s0, s1 = 0.0, e
                continue
            from0, from1 = (0 if s0 + stay0 >= s1 + go0 else 1), (1 if s1 + stay1 >= s0 + go1 else 0)
            s0, s1 = max(s0 + stay0, s1 + go0), max(s1 + stay1, s0 + go1) + e
            back.append((from0, from1))
        if not feats:
            return []
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[str, list[tuple[str, int]]]], rounds: int = 250, ridge: float = 1e-3, rate: float = 0.1) -> Field:
    """Fit a field to labelled pages. Pages whose blocks don't come out as labelled are left out."""
    rows, labels = [], []
    for page, known in pages:
        blocks = leaf_blocks(page)
        if [b[0] for b in blocks] == [" ".join(_html.unescape(t).split()) for t, _ in known]:
            rows.append(features(blocks))
            labels.append([y for _, y in known])
    names = sorted({x for r in rows for f in r for x in f})
    number = {x: i for i, x in enumerate(names)}
    n, t = len(rows), max(map(len, rows))
    x, y, mask = np.zeros((n, t, len(names)), np.float32), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (r, own) in enumerate(zip(rows, labels)):
        y[i, : len(own)], mask[i, : len(own)] = own, True
        for j, f in enumerate(r):
            x[i, j, [number[k] for k in f]] = 1
    flat = x.reshape(-1, len(names))
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    both = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            both[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]).sum()
    m = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    for k in range(1, rounds + 1):
        e = np.zeros((n, t, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, t)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = e[:, 0]
        for j in range(1, t):
            step = np.logaddexp(alpha[:, j - 1, :1] + pairs[0], alpha[:, j - 1, 1:] + pairs[1]) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], step, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            ahead = beta[:, j + 1] + e[:, j + 1]
            step = np.logaddexp(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
            beta[:, j] = np.where(mask[:, j + 1, None], step, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0)) * mask
        expected = np.zeros((2, 2))
        for a in range(2):
            for b in range(2):
                expected[a, b] = (np.exp(np.minimum(alpha[:, :-1, a] + pairs[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None], 0)) * mask[:, 1:]).sum()
        grad = np.concatenate([flat.T @ ((p1 - y * mask).ravel().astype(np.float32)) / n + ridge * w, ((expected - both) / n + ridge * pairs).ravel()])
        m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad**2
        step = rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
        w -= step[:-4]
        pairs -= step[-4:].reshape(2, 2)
    return Field(dict(zip(names, w.tolist())), pairs.tolist())


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages(TRAINING_PAGES))


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b[0] for b, y in zip(blocks, field.decode(features(blocks))) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each of ``pages`` (page_id, url, html)."""
    used = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x, used) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
