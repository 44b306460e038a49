"""Main text of HTML pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, each with the path of tags, classes, ids and roles above it. Every block is a
vector of hashed path names, hashed words and a few measures; a bidirectional LSTM
(numpy) reads the whole sequence, so each block is judged in the context of the
document, and labels it main text or not. Kept blocks are joined in page order.

The labeller is trained on at most ``SAMPLE`` whole pages: those of the least hashes of key
and html among the pages of at most ``SAMPLE_CHARS`` characters. Pages bear no labels, so they are made: blocks
below an article or main element are main text unless something that isn't
stands between; from these texts further pages are laid out with the
surroundings that pages have (menus, sidebars, notices, forms, comments, ...),
with texts drawn from the same blocks, so that position and path must decide.

Scripts, styles, templates, controls, comments and hidden elements are markup and
never become blocks. Character references are decoded, white space inside a block
becomes one space; a line break element counts as white space.

Edge cases: null and empty pages give an empty text; unclosed tags, stray ends and
pages cut anywhere are parsed to the end; blocks without visible characters are
none. If there is nothing to train on, article and main elements decide alone.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import column, fresh, small_batches

SAMPLE, SAMPLE_CHARS, SEED = 300, 200_000, 9
PATHS, WORDS, HIDDEN = 256, 32, 16
MADE, EPOCHS, BATCH, RATE = 2500, 6, 24, 0.02
PADDED = 1 << 16  # blocks that go through the network at once
PIECE = 400  # blocks that a training sequence has at most; longer pages are several

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|</?\Z",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDES = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none(?![\w-])", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
WORD = re.compile(r"\w+")
# Element names of HTML by how they are parsed.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head template noscript svg math select button object datalist canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption label".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol dl menu table tbody thead tfoot".split())
# Names that pages give to what isn't the article, and to the article.
ASIDE = [
    "nav ul li", "nav", "div.menu ul li", "ul.navbar li", "div#navigation ul li", "div.breadcrumb", "div.breadcrumbs ul li",
    "header", "header p", "div.header", "div#masthead", "div.site-header h1", "header div.logo", "footer", "footer p",
    "div.footer", "div#footer p", "div.copyright", "aside", "aside p", "aside div p", "div.sidebar", "div#sidebar p",
    "div.widget ul li", "div.related ul li", "section.recommended li", "div.notice", "div.cookie-notice", "div#cookie-consent p",
    "div.banner", "div.alert", "div.disclaimer", "div.newsletter", "div.subscribe p", "div.popup", "div.modal p", "div.ad",
    "div.ads", "div.advert", "div.advertisement p", "div.sponsored", "div.promo", "div#ad-top", "form", "form p", "form label",
    "form fieldset legend", "div.login form label", "div.search form", "section.comments p", "div.comments div.comment p",
    "div#comments article.comment p", "ol.commentlist li", "ul.comment-list li p", "div.replies div.reply", "div.share",
    "div.social ul li", "div.pagination", "div.tags", "div#toolbar", "section#respond form p", "div.gdpr", "div.consent",
]
WITHIN = [
    "aside", "aside p", "div.ad", "div.advert", "div.sponsored p", "nav ul li", "div.share", "div.related ul li", "form label",
    "form", "div.newsletter", "section.comments p", "div.comments div.comment p", "div#comments p", "ol.comments li", "footer",
    "footer p", "div.notice", "div.promo", "div.social", "div.tags",
]
ARTICLE = ["article", "main", "main article", "div.content article", "main div.content", "article div.body", "article section", "div#main article"]
PLAIN = ["div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "section.story", "div.post-content"]
TEXTS = ["p", "p", "p", "p", "h2", "h3", "ul li", "ol li", "blockquote p", "pre", "table tbody tr td", "div p", "section p", "figure figcaption", ""]
# Elements whose end tag also ends them from within a block.
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
NOT_MAIN = frozenset("nav aside footer form header".split())


@dataclass
class Block:
    path: list[str]
    text: str
    linked: float  # share of its characters that are links


def _names(name: str, rest: str) -> list[str]:
    found = ["t:" + name]
    if "=" in rest:
        for kind, *values in NAMED.findall(rest):
            found += [f"{'r' if kind.lower() == 'role' else 'c'}:{x.lower()}" for x in PART.findall("".join(values))]
    return found


def _hides(rest: str) -> bool:
    """Whether a tag's attributes hide the element; of attributes of one name the first counts."""
    if not HIDES.search(rest):
        return False
    own: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        own.setdefault(name.lower(), entities.unescape("".join(values)))
    return "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(own.get("style", "")))


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    found: list[Block] = []
    stack: list[tuple[str, list[str], bool]] = []  # name, names, whether its text is never shown
    held: list[str] = []
    linked, in_link, at = 0, False, 0
    text = page or ""

    def put(piece: str) -> None:
        nonlocal linked
        if piece and not any(s[2] for s in stack):
            held.append(piece)
            if in_link:
                linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if held:
            body = " ".join(entities.unescape("".join(held)).split())
            if body:
                path = [n for s in stack for n in s[1]]
                found.append(Block(path, body, min(1.0, linked / max(1, len(body)))))
            held.clear()
        linked = 0

    while (m := TAG.search(text, at)) is not None:
        put(text[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if text.startswith("<![CDATA[", m.start()):
                put(text[m.start() + 9 : m.end() - 3])
            continue
        if m["end"] or m["end2"]:
            if name == "a":
                in_link = False
            if name in BLOCKS or name in NEVER:
                flush()
                if any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
            else:
                _end_inline(stack, name)
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(text, at)
            at = end.start() if end else len(text)
        elif name == "br":
            put(" ")
        elif name in BLOCKS or name in NEVER:
            flush()
            in_link = in_link and name not in BLOCKS
            if name == "body":
                stack = [s for s in stack if s[0] != "head"]
            if name in BLOCKS and name != "label" and any(s[0] == "p" for s in stack) and name != "p":
                _close(stack, {"p"})
            if name == "p":
                _close(stack, {"p"})
            if name in CLOSES:
                _close(stack, CLOSES[name])
            if name not in VOID and not rest.endswith("/"):
                stack.append((name, _names(name, rest), name in NEVER or _hides(rest)))
        elif name not in VOID:
            in_link = in_link or name == "a"
            hides = not rest.endswith("/") and _hides(rest)
            # Elements of its name inside a hidden one stand there so that each end tag meets its own.
            if hides or not rest.endswith("/") and any(s[0] == name for s in stack):
                stack.append((name, [], hides))
    put(text[at:])
    flush()
    return found


def _end_inline(stack: list, name: str) -> None:
    """Ends the innermost inline element of this name; only formatting ends across a block's begin."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            if any(s[0] in BLOCKS or s[0] in NEVER for s in stack[i:]):
                del stack[i]
            else:
                del stack[i:]
            return
        if name not in FORMATS and (stack[i][0] in BLOCKS or stack[i][0] in NEVER):
            return


def _close(stack: list, names: set[str]) -> None:
    """Ends the innermost of these elements unless a list, table or container of its own stands between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            del stack[i:]
            return
        if stack[i][0] in LISTS or "p" not in names and stack[i][0] in ("div", "section"):
            return


class Buckets(dict):
    """Bucket of each name by its hash, kept for names seen lately."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[name] = found = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return found

    def __reduce__(self):
        return Buckets, (self.size,)


_PATH_BUCKETS, _WORD_BUCKETS = Buckets(PATHS), Buckets(WORDS)


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    n = len(blocks)
    x = np.zeros((n, PATHS + WORDS + 6), np.float32)
    sizes, words = [], []
    for i, b in enumerate(blocks):
        x[i, [_PATH_BUCKETS[name] for name in b.path]] = 1.0
        own = WORD.findall(b.text.lower())
        words += map(_WORD_BUCKETS.__getitem__, own)
        sizes.append(len(own))
        x[i, -6:] = (min(4.0, math.log1p(len(b.text)) / 2), b.linked, b.text[-1] in ".!?", len(b.path) / 8, i / n, 1 - i / n)
    if words:
        at = np.repeat(np.arange(0, n * WORDS, WORDS), sizes)
        counts = np.bincount(at + np.array(words), minlength=n * WORDS).reshape(n, WORDS)
        x[:, PATHS : PATHS + WORDS] = counts / np.maximum(1, counts.sum(1, keepdims=True))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM with a logistic output; ``weights`` by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, inputs: int, hidden: int = HIDDEN, seed: int = SEED) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        weights = {}
        for side in "fb":
            weights["x" + side] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)).astype(np.float32)
            weights["h" + side] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            weights["c" + side] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        weights["o"] = rng.normal(0, 0.3, (2 * hidden, 1)).astype(np.float32)
        weights["u"] = np.zeros(1, np.float32)
        return cls(weights)

    def _run(self, side: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step of one direction; x: page, step, input; live: page, step."""
        w, n = self.weights, len(self.weights["h" + side])
        pages, steps = live.shape
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out = np.zeros((pages, steps, n), np.float32)
        fed = x @ w["x" + side] + w["c" + side]
        for t in range(steps) if side == "f" else reversed(range(steps)):
            z = fed[:, t] + h @ w["h" + side]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            new = f * c + i * g
            up = live[:, t, None]
            if keep is not None:
                keep.append((t, i, f, o, g, c, new, h, up))
            c = np.where(up, new, c)
            h = np.where(up, o * np.tanh(new), h)
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, live), self._run("b", x, live)], axis=2)
        return (both @ self.weights["o"])[:, :, 0] + self.weights["u"]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over live blocks."""
        w, n = self.weights, len(self.weights["hf"])
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(s, x, live, kept[s]) for s in "fb"], axis=2)
        error = (_sigmoid((both @ w["o"])[:, :, 0] + w["u"]) - y) * live / live.sum()
        grads = {"o": np.einsum("pth,pt->h", both, error)[:, None], "u": np.array([error.sum()], np.float32)}
        back = error[:, :, None] * w["o"][:, 0]
        for s, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            gx, gh, gc = np.zeros_like(w["x" + s]), np.zeros_like(w["h" + s]), np.zeros_like(w["c" + s])
            dh, dc = np.zeros((len(x), n), np.float32), np.zeros((len(x), n), np.float32)
            for t, i, f, o, g, c, new, h, up in reversed(kept[s]):
                dh = dh + part[:, t]
                tanh = np.tanh(new)
                into = np.where(up, dh * o * (1 - tanh**2) + dc, 0)
                z = np.concatenate([into * g * i * (1 - i), into * c * f * (1 - f), np.where(up, dh * tanh, 0) * o * (1 - o), into * i * (1 - g**2)], axis=1)
                gx += x[:, t].T @ z
                gh += h.T @ z
                gc += z.sum(0)
                dh = np.where(up, z @ w["h" + s].T, dh)
                dc = np.where(up, into * f, dc)
            grads |= {"x" + s: gx, "h" + s: gh, "c" + s: gc}
        return grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page: whether each block is main text. Pages of like length go together."""
        found: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((p for p in range(len(pages)) if len(pages[p])), key=lambda p: len(pages[p]))
        while order:
            own, most = [], 0
            while order and (not own or (max(most, len(pages[order[0]])) * (len(own) + 1) <= PADDED and len(pages[order[0]]) <= 1.5 * len(pages[own[0]]) + 4)):
                own.append(order.pop(0))
                most = max(most, len(pages[own[-1]]))
            x, live = _padded([pages[p] for p in own])
            for p, row in zip(own, self.logits(x, live) > 0, strict=True):
                found[p] = row[: len(pages[p])]
        return found


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(len(p) for p in pages)
    x, live = np.zeros((len(pages), most, pages[0].shape[1]), np.float32), np.zeros((len(pages), most), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], live[i, : len(p)] = p, True
    return x, live


def weak_label(path: list[str]) -> bool:
    """Below an article or main element with nothing between that isn't part of it."""
    tops = [i for i, n in enumerate(path) if n in ("t:article", "t:main")]
    return bool(tops) and not any(n[2:] in NOT_MAIN for n in path[tops[0] :] if n.startswith("t:")) and not any(n == "c:ad" for n in path)


def _path(written: str) -> list[str]:
    """Names of the elements of a written path such as ``div.menu ul li``."""
    found = []
    for element in written.split():
        name, *marks = re.split(r"(?=[.#])", element)
        found += ["t:" + name, *[f"c:{x}" for m in marks for x in PART.findall(m)]]
    return found


def laid_out(texts: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page of made surroundings around some of the texts, with labels."""
    pick = lambda names: names[rng.integers(len(names))]
    some = lambda: " ".join(pick(texts).split()[: int(rng.integers(1, 40))]) or "x"
    junk = lambda: [f"c:{pick(['x', 'box', 'row', 'col', 'wrap', 'item', 'css', 'v'])}{rng.integers(99)}"] if rng.random() < 0.3 else []
    top = ["t:html", "t:body", *(_path("div.page") if rng.random() < 0.3 else [])]
    blocks, labels = [], []

    def aside(names: list[str], under: list[str]) -> None:
        elements = pick(names).split()
        holder = under + junk() + _path(" ".join(elements[:-1]))
        path = holder + _path(elements[-1])
        if rng.random() < 0.4:
            blocks.append(Block((holder if elements[1:] else path) + [f"t:h{rng.integers(2, 5)}"], some(), 0.0))
            labels.append(0)
        link = float(rng.random()) if "li" in path[-1] or rng.random() < 0.3 else 0.0
        for _ in range(int(rng.integers(1, 7)) if path[-1] in ("t:li", "t:p", "t:label") else 1):
            blocks.append(Block(path, some() if rng.random() < 0.6 else pick(texts), link))
            labels.append(0)

    for _ in range(int(rng.integers(0, 5))):
        aside(ASIDE, top)
    inner = top + junk() + _path(pick(ARTICLE if rng.random() < 0.75 else PLAIN))
    if rng.random() < 0.8:
        blocks.append(Block(inner + _path("h1" if rng.random() < 0.8 else "header h1"), some(), 0.0))
        labels.append(1)
    for _ in range(int(rng.integers(1, 25))):
        if rng.random() < 0.08:
            aside(WITHIN, inner)
        blocks.append(Block(inner + junk() + _path(pick(TEXTS)), pick(texts) if rng.random() < 0.8 else some(), float(rng.random() < 0.1) * float(rng.random())))
        labels.append(1)
    if rng.random() < 0.3:
        aside(WITHIN, inner)
    for _ in range(int(rng.integers(0, 5))):
        aside(ASIDE, top)
    return blocks, labels


def fit_labeller(pages: list[str], seed: int = SEED) -> BlockLabeller | None:
    """Trained on these pages and on pages laid out from their texts; None without texts."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(blocks_of, pages) if b]
    texts = [b.text for page in parsed for b in page]
    if not texts:
        return None
    made = [(page, [int(weak_label(b.path)) for b in page]) for page in parsed]
    made += [laid_out(texts, rng) for _ in range(MADE)]
    data = []
    for blocks, labels in made:
        x, y = features(blocks), np.array(labels, np.float32)
        data += [(x[at : at + PIECE], y[at : at + PIECE]) for at in range(0, len(y), PIECE)]
    net = BlockLabeller.fresh(PATHS + WORDS + 6)
    sums = {k: np.zeros_like(v) for k, v in net.weights.items()}
    steps = {k: np.zeros_like(v) for k, v in net.weights.items()}
    at = 0
    for epoch in range(EPOCHS):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + 3 * rng.random())
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            own = [data[i] for i in batches[b]]
            x, live = _padded([p for p, _ in own])
            y = np.zeros(live.shape, np.float32)
            for i, (_, labels) in enumerate(own):
                y[i, : len(labels)] = labels
            at += 1
            for k, g in net.gradients(x, live, y).items():  # Adam
                steps[k] = 0.9 * steps[k] + 0.1 * g
                sums[k] = 0.99 * sums[k] + 0.01 * g * g
                size = RATE * (0.5**epoch) / (1 - 0.9**at)
                net.weights[k] = net.weights[k] - (size * steps[k] / (np.sqrt(sums[k] / (1 - 0.99**at)) + 1e-6)).astype(np.float32)
    return net


def main_texts(pages: list[str | None], net: BlockLabeller | None) -> list[str]:
    parsed = [blocks_of(p) for p in pages]
    if net is None:
        kept = [[weak_label(b.path) for b in page] for page in parsed]
    else:
        kept = net.label([features(page) for page in parsed])
    return ["\n".join(b.text for b, yes in zip(page, own, strict=True) if yes) for page, own in zip(parsed, kept, strict=True)]


def fit(pages: DataFrame, key="page_id", html="html", sample: int = SAMPLE) -> BlockLabeller | None:
    """The labeller of a bounded sample of the pages."""
    body = column(html).cast("string")
    rows = pages.filter(body.isNotNull() & (F.length(body) <= SAMPLE_CHARS))
    keys = rows.select(column(key).alias("k"), F.xxhash64(column(key), body).alias("h")).orderBy("h").limit(sample)
    chosen = rows.select(body.alias("x"), F.xxhash64(column(key), body).alias("h")).join(F.broadcast(keys.select("h").distinct()), "h")
    return fit_labeller([r["x"] for r in chosen.orderBy("h").collect()])


def extracted(net: BlockLabeller | None, html: str = "html") -> Column:
    """Main text of each page."""

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series(main_texts(list(pages), net), dtype=object)

    return texts(column(html).cast("string"))


def extract(pages: DataFrame, key="page_id", html="html") -> DataFrame:
    """The pages' columns and ``main_text`` (underscored where the name is taken)."""
    (name,) = fresh(pages, "main_text")
    return small_batches(pages).withColumn(name, extracted(fit(pages, key, html), html))
