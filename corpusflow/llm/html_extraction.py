"""Operator 2: main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, the text between block-level tags. A block has features of its ancestor tags and
their class words, of its text, and of its place; two labels, article or not, form a chain over the page, decoded by
Viterbi. The field is trained by gradient ascent on the likelihood of labelled pages. Labelled pages are drawn by
`labelled_pages` from page layouts with invented words, so the text itself teaches nothing but its shape.

Head, script, style and other parts without readable text are no blocks. Character references are decoded; white
space inside a block becomes one space; article blocks are joined by two newlines.

Defined cases: null or empty html, or a page without article blocks, gives the empty text; unclosed and stray tags
are tolerated; equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import _common as C

TRAINING_PAGES = 400
SEED = 7
STEPS = 160
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("head script style noscript template select button svg iframe object textarea title option".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SELF = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CUES = re.compile(r"©|cookie|subscri|newsletter|advert|sponsor|related|comment|repl(?:y|ies)|share|log ?in|sign ?(?:in|up)|privacy|rights reserved|read more|follow us|accept|copyright|terms", re.I)
_STOP = tuple(".!?…\"”»')")


def hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide its element; words inside other attributes' values do not."""
    if not _HIDDEN.search(attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" and value.strip().lower() != "false" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(html: str) -> list[Block]:
    """Leaf blocks in page order; path: (tag, class words) of each open element, outermost first."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = anchors = mute = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(n: int):
        nonlocal mute
        for tag, words in stack[n:]:
            mute -= tag in _OUT or "\0" in words
        del stack[n:]

    def close(name: str, within: tuple = ()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                flush()
                pop(i)
                return
            if stack[i][0] in within:
                return

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at and not mute:
            piece = html[at : m.start()]
            parts.append(piece)
            if anchors:
                linked += len(piece)
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                anchors = max(0, anchors - 1) if m[2] else 1
            continue
        if m[2]:
            if name == "p" and not any(t == "p" for t, _ in stack):
                flush()
            else:
                close(name)
            continue
        flush()
        if name in _CLOSES_P:
            close("p", ("td", "th", "li", "div", "section", "article", "body"))
        if name in _SELF:
            close(name, _SELF[name])
        if name in _VOID or (m[4] or "").endswith("/"):
            continue
        words: tuple[str, ...] = ()
        if m[4] and m[4].strip():
            named = [x for g in _NAMED.findall(m[4]) for x in g if x]
            words = tuple(w for x in named for w in _SPLIT.split(x.strip()) if w) if named else ()
            words = tuple(w.lower() for w in words)
            if hidden(m[4]):
                words += ("\0",)
        stack.append((name, words))
        mute += name in _OUT or "\0" in words
    if at < len(html) and not mute:
        parts.append(html[at:])
    flush()
    return out


def _bucket(x: float, bounds: tuple) -> int:
    return sum(x >= b for b in bounds)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    has_article = any(t in ("article", "main") for b in blocks for t, _ in b.path)
    out = []
    n = len(blocks)
    cache: dict[tuple, list[str]] = {}
    for i, b in enumerate(blocks):
        own = cache.get(b.path)
        if own is None:
            own = ["bias"]
            tags = [t for t, _ in b.path]
            words = [w for _, ws in b.path for w in ws]
            own += {f"in:{t}" for t in tags if t not in ("html", "body")}
            own += {f"class:{w}" for w in words}
            own.append(f"leaf:{tags[-1] if tags else ''}")
            own += [f"leafclass:{w}" for _, ws in b.path[-1:] for w in ws]
            if has_article:
                own.append("inside" if any(t in ("article", "main") for t in tags) else "outside")
            cache[b.path] = own
        text = b.text
        n_words = text.count(" ") + 1
        fs = [*own, f"words:{_bucket(n_words, (2, 4, 8, 15, 30, 60))}", f"links:{_bucket(b.linked / len(text), (0.01, 0.3, 0.6, 0.9))}"]
        fs.append("stop" if text.endswith(_STOP) else "nostop")
        if len(text) < 300 and _CUES.search(text):
            fs.append("cue")
        fs.append(f"place:{_bucket(i / n, (0.1, 0.3, 0.7, 0.9))}")
        out.append(fs)
    return out


def _index(pages: list[list[list[str]]], least: int = 3) -> dict[str, int]:
    seen: dict[str, int] = {}
    for page in pages:
        for fs in page:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    return {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}


class ChainField:
    """Two-label linear-chain conditional random field; weights of label 1 against label 0."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.index, self.weights, self.start, self.move = index, weights, start, move

    @classmethod
    def train(cls, pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = 0.08, decay: float = 1e-3) -> ChainField:
        feats = [features(b) for b, _ in pages]
        index = _index(feats)
        longest = max(len(f) for f in feats)
        n = len(pages)
        x = np.zeros((n, longest, len(index)), np.float32)
        y = np.zeros((n, longest), np.int64)
        mask = np.zeros((n, longest), bool)
        for i, (page, (_, labels)) in enumerate(zip(feats, pages)):
            for t, fs in enumerate(page):
                x[i, t, [index[f] for f in fs if f in index]] = 1
            y[i, : len(labels)] = labels
            mask[i, : len(labels)] = True
        flat = x.reshape(-1, len(index))
        w, s, m = np.zeros(len(index)), np.zeros(2), np.zeros((2, 2))
        first, second, step = [np.zeros_like(v) for v in (w, s, m)], [np.zeros_like(v) for v in (w, s, m)], 0
        both = mask[:, 1:] & mask[:, :-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        for _ in range(steps):
            e = np.zeros((n, longest, 2))
            e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, longest)
            a = np.zeros((n, longest, 2))
            a[:, 0] = s + e[:, 0]
            for t in range(1, longest):
                new = np.logaddexp(a[:, t - 1, 0, None] + m[0], a[:, t - 1, 1, None] + m[1]) + e[:, t]
                a[:, t] = np.where(mask[:, t, None], new, a[:, t - 1])
            b = np.zeros((n, longest, 2))
            pair = np.zeros((2, 2))
            z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
            for t in range(longest - 2, -1, -1):
                nxt = e[:, t + 1] + b[:, t + 1]
                new = np.stack([np.logaddexp(m[i, 0] + nxt[:, 0], m[i, 1] + nxt[:, 1]) for i in (0, 1)], axis=1)
                b[:, t] = np.where(mask[:, t + 1, None], new, 0)
                p = np.exp(a[:, t, :, None] + m[None] + nxt[:, None, :] - z[:, None, None])
                pair += (p * both[:, t, None, None]).sum(axis=0)
            post = np.where(mask[:, :, None], np.exp(a + b - z[:, None, None]), 0)
            gw = (flat.T @ (np.where(mask, y, 0) - post[:, :, 1]).reshape(-1).astype(np.float32)) / n - decay * w
            gs = (np.bincount(y[:, 0], minlength=2) - post[:, 0].sum(axis=0)) / n
            gm = (seen - pair) / n
            step += 1
            for v, g, f1, f2 in zip((w, s, m), (gw, gs, gm), first, second):
                f1 += 0.1 * (g - f1)
                f2 += 0.01 * (g * g - f2)
                v += rate * (f1 / (1 - 0.9**step)) / (np.sqrt(f2 / (1 - 0.99**step)) + 1e-8)
        return cls(index, w, s, m)

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi labels."""
        index, w = self.index, self.weights
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        p0 = p1 = 0.0
        for t, fs in enumerate(feats):
            e = 0.0
            for f in fs:
                k = index.get(f)
                if k is not None:
                    e += w[k]
            if t == 0:
                p0, p1 = self.start[0], self.start[1] + e
                continue
            f0, f1 = p1 + m10 > p0 + m00, p1 + m11 > p0 + m01
            back.append((f0, f1))
            p0, p1 = (p1 + m10 if f0 else p0 + m00), (p1 + m11 if f1 else p0 + m01) + e
        label = int(p1 > p0)
        out = [label]
        for f0, f1 in reversed(back):
            label = int(f1 if label else f0)
            out.append(label)
        return out[::-1]


_SYLLABLES = "an ber co de en fi ga ho in ka le mo ne or pa re sa ti un ve wa ist ung tion ment eau ado ly the".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages drawn from layouts, with the text and label of each leaf block in page order."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    pages = []
    for _ in range(n):
        parts: list[str] = []
        truth: list[tuple[str, int]] = []

        def leaf(tag, text, label, attrs="", inner=None):
            if rng.random() < 0.05:
                text = f"{text} | {word()}%%% &&&"
            parts.append(f"<{tag}{attrs}>{inner(text) if inner else text.replace('&', '&amp;')}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"))
            truth.append((text, label))

        link = lambda t: f'<a href="/{word()}">{t.replace("&", "&amp;")}</a>'

        def menu(tag, attrs):
            parts.append(f"<{tag}{attrs}><ul>")
            for _ in range(rng.randint(3, 8)):
                leaf("li", line(1, 3), 0, inner=link)
            parts.append(f"</ul></{tag}>")

        def notice(label=0):
            kind = rng.choice(["ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "cookie-notice", "cookie-banner", "newsletter", "subscribe", "social-share", "share", "breadcrumb", "breadcrumbs", "related", "popup", "alert", "notice", "widget", "toolbar"])
            tag = rng.choice(["div", "div", "section", "aside"])
            attr = rng.choice(["class", "class", "id"])
            parts.append(f'<{tag} {attr}="{kind}">')
            for _ in range(rng.randint(1, 3)):
                if rng.random() < 0.5:
                    parts.append("<p>")
                    text = line(4, 18) + "."
                    parts.append(text + "</p>")
                    truth.append((text, label))
                else:
                    text = line(2, 25) + rng.choice(["", "."])
                    parts.append(text + "<div></div>")
                    truth.append((text, label))
            parts.append(f"</{tag}>")

        def form():
            parts.append(f'<form action="/{word()}">')
            leaf("div", line(1, 8), 0)
            parts.append("<input name=q><button>Go</button></form>")

        def comments():
            tag, name = rng.choice([("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("div", "disqus"), ("section", "responses"), ("ol", "commentlist")])
            parts.append(f'<{tag} {rng.choice(["class", "id"])}="{name}">')
            if rng.random() < 0.6:
                leaf("h3", line(1, 3), 0)
            for _ in range(rng.randint(1, 5)):
                parts.append('<div class="comment">' if tag != "ol" else '<li class="comment">')
                leaf("p", line(5, 40) + ".", 0)
                parts.append("</div>" if tag != "ol" else "</li>")
            parts.append(f"</{tag}>")

        def sidebar():
            tag, attrs = rng.choice([("aside", ""), ("div", ' class="sidebar"'), ("aside", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="widget-area"')])
            parts.append(f"<{tag}{attrs}>")
            leaf("h3", line(1, 3), 0)
            for _ in range(rng.randint(1, 4)):
                leaf("p", line(6, 30) + ".", 0) if rng.random() < 0.5 else leaf("li", line(2, 6), 0, inner=link)
            parts.append(f"</{tag}>")

        parts.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
        if rng.random() < 0.6:
            parts.append("<header>" if rng.random() < 0.6 else '<div class="header">')
            closing = "</header>" if parts[-1] == "<header>" else "</div>"
            leaf(rng.choice(["div", "p", "h2"]), line(1, 5), 0)
            if rng.random() < 0.5:
                menu("nav", "")
            parts.append(closing)
        if rng.random() < 0.8:
            menu(*rng.choice([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="menu"'), ("div", ' id="nav"'), ("div", ' class="navbar"'), ("div", ' class="navigation"')]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            notice()
        if rng.random() < 0.25:
            sidebar()
        if rng.random() < 0.2:
            form()
        tag, attrs = rng.choice([("article", "")] * 5 + [("main", ""), ("main", ' id="main"'), ("article", ' class="post"'), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="post-body"'), ("div", ' class="entry-content"'), ("div", ' class="article"'), ("div", ' class="story"'), ("div", ' class="article-body"'), ("section", ' class="article"'), ("div", ' role="main"')])
        parts.append(f"<{tag}{attrs}>")
        head = rng.random()
        if head < 0.8:
            if head < 0.15:
                parts.append("<header>")
            leaf("h1", line(2, 12) + rng.choice(["", "."]), 1)
            if head < 0.15:
                parts.append("</header>")
        for _ in range(rng.randint(1, 16)):
            r = rng.random()
            if r < 0.72:
                leaf("p", line(1, 90) + rng.choice([".", ".", ".", ".", "", "!", "?"]), 1, inner=(lambda t: f"<b>{t.replace('&', '&amp;')}<br>") if rng.random() < 0.2 else None)
            elif r < 0.80:
                leaf(rng.choice(["h2", "h3"]), line(1, 8), 1)
            elif r < 0.86:
                parts.append("<ul>" if rng.random() < 0.7 else "<ol>")
                for _ in range(rng.randint(2, 5)):
                    leaf("li", line(1, 20), 1, inner=link if rng.random() < 0.1 else None)
                parts.append("</ul>")
            elif r < 0.89:
                leaf(rng.choice(["blockquote", "pre", "figcaption"]), line(3, 30) + ".", 1)
            elif r < 0.92:
                parts.append("<table><tr>")
                for _ in range(rng.randint(2, 4)):
                    leaf("td", line(1, 4), 1)
                parts.append("</tr></table>")
            elif r < 0.96:
                notice()
            elif r < 0.98:
                menu("nav", "")
            else:
                form()
        if rng.random() < 0.12:
            parts.append("<footer>")
            leaf("p", line(2, 12), 0)
            parts.append("</footer>")
        inside = rng.random() < 0.3
        if inside and rng.random() < 0.6:
            comments()
        parts.append(f"</{tag}>")
        if not inside and rng.random() < 0.4:
            comments()
        if rng.random() < 0.35:
            sidebar()
        if rng.random() < 0.3:
            notice()
        if rng.random() < 0.15:
            form()
        if rng.random() < 0.85:
            ftag, fattrs = rng.choice([("footer", ""), ("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"')])
            parts.append(f"<{ftag}{fattrs}>")
            text = "© " + line(1, 4) + " · " + line(2, 20) + "."
            parts.append(text.replace("©", "&copy;").replace("·", "&middot;"))
            truth.append((text, 0))
            parts.append(f"</{ftag}>")
        if rng.random() < 0.9:
            parts.append("</body></html>")
        pages.append(("".join(parts), truth))
    return pages


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> ChainField:
    """A field from labelled pages; a leaf block that the labels do not name is left to its neighbours' label 0."""
    data = []
    for html, truth in labelled_pages(pages, seed):
        blocks = leaf_blocks(html)
        want = iter([*truth, None])
        now = next(want)
        labels = []
        for b in blocks:
            if now and b.text == " ".join(now[0].split()):
                labels.append(now[1])
                now = next(want)
            else:
                labels.append(0)
        data.append((blocks, labels))
    return ChainField.train([x for x in data if x[0]])


def main_text(html: str | None, field: ChainField) -> str:
    blocks = leaf_blocks(html) if html else []
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, k in zip(blocks, field.decode(features(blocks))) if k)


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html)."""
    field = field or train()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, field) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return C.map_chunks(pages.select("page_id", "url", "html"), "html", "page_id long, url string, text string, n_chars long", work)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
