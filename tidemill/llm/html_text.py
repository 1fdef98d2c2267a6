"""Main text of HTML pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

A page is parsed to a tree of block nodes. Every node has features of its own text, its subtree (text, links, marks,
node density), depth, siblings, position, and the attribute tokens of itself and of the nodes above it. Boosted trees
give the chance that a node is, or holds, main text. Decoding picks the most likely labels of the whole tree in which
everything under a dropped node is dropped, so an ancestor and a descendant never contradict each other. The text runs
of kept nodes are joined in page order.

Training needs no labels from outside. A bounded sample of pages (``SAMPLE``, the first in the order of a digest of
id and html, so the same in every run) with one ``article`` or ``main`` element gives labelled trees: what is inside
it is main text, apart from menus, asides, forms and footers, and apart from what its own names call comments,
adverts, share bars and the like. The same texts are then wrapped in random layouts that lack such elements, or hold
comments, notices, adverts, share bars and forms beside and inside the text, with their labels known. Trees are
trained on a bounded sample of the nodes of both (``NODES``), with every attribute token, by its digest. Sampled pages are
used whole. Only the made layouts carry the attribute that marks main text; on pages it means nothing.

Defined results: null or empty html, or a page without main text, gives an empty text; repeated rows each give a row;
an empty table gives no rows; pages of any length are read whole, in time that grows with their length, and a large
page's nodes are scored some at a time; a tag that the page's end cuts off is dropped; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.html_tree import Buckets, Page, feature_chunks, parse

#: Pages of the training sample, random layouts made of their texts, nodes (labelled rows) that trees are trained on.
SAMPLE, LAYOUTS, NODES = 400, 400, 80_000
#: Numbers that attribute tokens are dealt to by a digest.
TOKENS = 256
MARK = "data-main"
#: Share of the made layouts whose main text is made of few words.
SHORT_LAYOUTS = 0.4
#: Trees, their depth, learning rate, bins of a feature, rows of a leaf, penalty, share of the features that a tree may use.
TREES, LEVELS, RATE, BINS, LEAST_ROWS, SHRINK, SHARE, SEED = 90, 4, 0.3, 24, 6, 1.0, 0.2, 5
#: Nodes of small pages whose features are computed together.
CHUNK_NODES = 6000

NOT_MAIN = {"nav", "aside", "footer", "form"}
#: Words in the names of elements that stand inside an article and are none of its text.
NOT_MAIN_NAMES = frozenset("comment comments reply replies responses discussion disqus advert advertisement ads sponsor sponsored promo newsletter subscribe signup share sharing related sidebar cookie consent".split())


class Trees:
    """Boosted trees of fixed depth for a yes/no label, on logistic loss, with split points on histograms."""

    def __init__(self) -> None:
        self.base = 0.0
        self.splits: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Trees:
        rng = np.random.default_rng(seed)
        n, every = x.shape
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(every)]
        # a rare token is 0 at all quantiles
        edges = [e if len(e) > 1 or x[:, k].min() == x[:, k].max() else np.array([(x[:, k].min() + x[:, k].max()) / 2]) for k, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
        varied = np.flatnonzero(binned.max(axis=0) > 0)
        width = max(1, int(SHARE * len(varied)))
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        for _ in range(TREES if len(varied) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p) + 1e-6
            chosen = np.sort(rng.choice(varied, width, replace=False))
            flat = binned[:, chosen] + np.arange(width) * BINS
            node = np.zeros(n, dtype=np.int64)
            split, cut = np.zeros((1 << LEVELS) - 1, dtype=np.int64), np.full((1 << LEVELS) - 1, np.inf)
            for level in range(LEVELS):
                k = 1 << level
                at = (node[:, None] * (width * BINS) + flat).ravel()
                sums = [np.bincount(at, v if v is None else np.repeat(v, width), k * width * BINS).reshape(k, width, BINS).cumsum(axis=2) for v in (g, h, None)]
                left, total = [s[:, :, :-1] for s in sums], [s[:, :1, -1:] for s in sums]
                right = [t - le for t, le in zip(total, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - total[0] ** 2 / (total[1] + SHRINK)
                gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = 0
                gain = gain.reshape(k, -1)
                best = gain.argmax(axis=1)
                feature, place = chosen[best // (BINS - 1)], best % (BINS - 1)
                for j in range(k):
                    split[k - 1 + j] = feature[j]
                    if gain[j, best[j]] > 1e-6 and place[j] < len(edges[feature[j]]):
                        cut[k - 1 + j] = edges[feature[j]][place[j]]
                node = 2 * node + (x[np.arange(n), split[k - 1 + node]] > cut[k - 1 + node])
            size = 1 << LEVELS
            leaf = -RATE * np.bincount(node, g, size) / (np.bincount(node, h, size) + SHRINK)
            score += leaf[node]
            self.splits.append((split, cut))
            self.leaves.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the label."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for (split, cut), leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(LEVELS):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, split[at]] > cut[at])
            out += leaf[node]
        return out


def decode(page: Page, odds: list[float]) -> list[bool]:
    """The most likely labels in which no node under a dropped one is kept."""
    n = len(page.tags)
    keep, drop = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        o = odds[k]
        # log p and log (1 - p); p never reaches 0 or 1
        o = 20.0 if o > 20 else -20.0 if o < -20 else o
        soft = float(np.log1p(np.exp(-abs(o))))
        keep[k] += -soft if o > 0 else o - soft
        drop[k] += -o - soft if o > 0 else -soft
        up = page.parent[k]
        if up >= 0:
            keep[up] += max(keep[k], drop[k])
            drop[up] += drop[k]
    kept = [False] * n
    for k in range(n):
        up = page.parent[k]
        kept[k] = (up < 0 or kept[up]) and keep[k] > drop[k]
    return kept


def labels(page: Page) -> list[bool] | None:
    """Which nodes are or hold main text; None where the page does not tell."""
    n = len(page.tags)
    with_text = {node for node, _, _ in page.runs}
    if any(page.marked):
        own = page.marked
    else:
        roots = [k for k, t in enumerate(page.tags) if t == "article"] or [k for k, t in enumerate(page.tags) if t == "main"]
        if len(roots) != 1:
            return None
        own = [False] * n
        for k in range(roots[0], page.end[roots[0]]):
            inside = k == roots[0] or own[page.parent[k]]
            own[k] = inside and page.tags[k] not in NOT_MAIN and (k == roots[0] or NOT_MAIN_NAMES.isdisjoint(page.tokens[k]))
        own = [o and (k in with_text or k == roots[0]) for k, o in enumerate(own)]
    out = [bool(o) and k in with_text for k, o in enumerate(own)]
    for k in range(n - 1, 0, -1):
        if out[k]:
            out[page.parent[k]] = True
    return out


#: Names that pages commonly give to the parts of their layout.
NAMES = {
    "main": "content|post|post-body|entry-content|article-body|story|main-content|text|page-content|blog-post|article__text|body-text|single|prose",
    "neutral": "container|wrapper|page|row|col-8|inner|site|layout|box|grid|block|column|outer|wrap",
    "menu": "menu|nav|navbar|navigation|topnav|main-menu|breadcrumb|breadcrumbs|pagination|tabs",
    "head": "header|masthead|site-header|top|banner|branding|logo|topbar",
    "foot": "footer|site-footer|bottom|copyright|legal|colophon|imprint",
    "side": "sidebar|side|widget|related|aside|recommended|more-stories|popular|trending|tags|rail",
    "notice": "notice|cookie|cookie-banner|consent|alert|popup|modal|gdpr|warning|message",
    "ad": "ad|ads|advert|advertisement|sponsor|sponsored|promo|banner-ad|promotion|ad-slot",
    "form": "newsletter|subscribe|signup|search|login|contact-form|search-form",
    "comments": "comments|comment-list|responses|discussion|replies|disqus|reader-comments|comment-section",
    "share": "share|social|sharing|social-links|byline-tools|actions|follow",
}


class Layout:
    """A random page around given blocks of main text."""

    def __init__(self, rng: np.random.Generator, words: list[str]):
        self.rng, self.words = rng, words or ["word"]

    def pick(self, items: list | tuple | str):
        items = items.split("|") if isinstance(items, str) else items
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def phrase(self, lo: int, hi: int) -> str:
        return escape(" ".join(self.pick(self.words) for _ in range(int(self.rng.integers(lo, hi + 1)))))

    def named(self, kind: str) -> str:
        how = self.rng.random()
        name = self.pick(NAMES[kind])
        return f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.8 else f' class="{self.pick(NAMES["neutral"])} {name}"' if how < 0.95 else ""

    def links(self, n: int, how: str) -> str:
        rows = [f'<a href="/{k}">{self.phrase(1, 4)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>" if how == "list" else self.pick((" | ", " ", " &middot; ")).join(rows)

    def extra(self, kind: str) -> str:
        a, n = self.named(kind), int(self.rng.integers(2, 9))
        if kind == "menu":
            tag = self.pick(("nav", "div", "ul", "nav"))
            return f"<ul{a}>" + "".join(f'<li><a href="#">{self.phrase(1, 2)}</a></li>' for _ in range(n)) + "</ul>" if tag == "ul" else f"<{tag}{a}>{self.links(n, self.pick(('list', 'row')))}</{tag}>"
        if kind == "head":
            tag, title = self.pick(("header", "div")), self.pick("div|h1|p|h2")
            return f'<{tag}{a}><{title}>{self.phrase(1, 5)}</{title}>{self.extra("menu") if self.chance(0.4) else ""}</{tag}>'
        if kind == "foot":
            tag = self.pick(("footer", "div"))
            return f"<{tag}{a}>" + self.pick((f"&copy; {self.phrase(2, 8)}", f"<p>{self.phrase(3, 25)}</p>{self.links(n, 'row')}", f"<p>&copy; {self.phrase(2, 6)}</p>")) + f"</{tag}>"
        if kind == "side":
            tag = self.pick(("aside", "div", "section"))
            teasers = "".join(f'<div><a href="#">{self.phrase(3, 9)}</a><p>{self.phrase(5, 25)}</p></div>' for _ in range(int(self.rng.integers(0, 4))))
            return f"<{tag}{a}><h3>{self.phrase(1, 3)}</h3>{self.links(n, 'list') if self.chance(0.7) else f'<p>{self.phrase(5, 40)}</p>'}{teasers}</{tag}>"
        if kind == "notice":
            return f"<{(t := self.pick(('div', 'section', 'aside')))}{a}>" + self.pick((self.phrase(6, 30), f"<p>{self.phrase(6, 40)}</p>")) + (f"<button>{self.phrase(1, 2)}</button>" if self.chance(0.6) else "") + f"</{t}>"
        if kind == "ad":
            return f"<div{a}>" + self.pick((self.phrase(2, 15), f'<a href="#">{self.phrase(2, 12)}</a>', f"<p>{self.phrase(4, 20)}</p>")) + "</div>"
        if kind == "form":
            return f'<form{a if self.chance(0.6) else ""} action="#"><label>{self.phrase(1, 4)}</label><input name="x"><p>{self.phrase(2, 14)}</p><button>{self.phrase(1, 2)}</button></form>'
        if kind == "comments":
            tag, item = self.pick(("section", "div")), self.pick(("div", "li", "article"))
            rows = "".join(f'<{item}{self.pick((" class=comment", "", " class=reply"))}><b>{self.phrase(1, 2)}</b><p>{self.phrase(4, 60)}</p></{item}>' for _ in range(int(self.rng.integers(1, 6))))
            return f"<{tag}{a or ' id=comments'}><h3>{self.phrase(1, 3)}</h3>{'<ol>' + rows + '</ol>' if item == 'li' else rows}</{tag}>"
        return f"<div{a}>{self.links(int(self.rng.integers(2, 5)), self.pick(('row', 'list')))}</div>"

    def block(self, text: str, k: int) -> str:
        words = escape(text).split(" ")
        for _ in range(int(self.rng.integers(0, 3))):
            at = int(self.rng.integers(len(words)))
            words[at] = self.pick((f"<b>{words[at]}</b>", f'<a href="#">{words[at]}</a>', f"<em>{words[at]}</em>"))
        inner, mark = " ".join(words), f" {MARK}"
        if k == 0 and self.chance(0.6):
            return f"<h1{mark}>{inner}</h1>" if self.chance(0.7) else f"<header><h1{mark}>{inner}</h1></header>"
        how = self.rng.random()
        if how < 0.68:
            return f"<p{mark}>{inner}</p>" if self.chance(0.85) else f"<p{mark}>{inner}"
        if how < 0.76:
            return f"<{(h := self.pick('h2|h3'))}{mark}>{self.phrase(2, 8)}</{h}>"
        if how < 0.84:
            return f"<blockquote{mark}>{inner}</blockquote>" if self.chance(0.5) else f"<blockquote><p{mark}>{inner}</p></blockquote>"
        if how < 0.92:
            return "<ul>" + "".join(f"<li{mark}>{' '.join(words[j : j + 12])}</li>" for j in range(0, len(words), 12)) + "</ul>"
        return f"<{(t := self.pick('div|pre|div'))}{mark}>{inner}</{t}>" if how < 0.97 else f"<table><tr><td{mark}>{inner}</td></tr></table>"

    def page(self, blocks: list[str]) -> str:
        inside = [self.block(b, k) for k, b in enumerate(blocks)]
        for kind in ("ad", "share", "form", "side", "notice", "menu"):
            if self.chance(0.25):
                inside.insert(int(self.rng.integers(0, len(inside) + 1)), self.extra(kind))
        tag = self.pick(("div", "div", "div", "section", "article", "main"))
        main = f"<{tag}{self.named('main' if tag in ('div', 'section') else 'neutral')}>{''.join(inside)}{self.extra('comments') if self.chance(0.25) else ''}</{tag}>"
        before = [self.extra(k) for k in ("head", "menu", "notice", "ad", "side", "form") if self.chance(0.5)]
        after = [self.extra(k) for k in ("comments", "side", "share", "form", "ad", "notice", "foot", "menu") if self.chance(0.5)]
        body = main
        if self.chance(0.5):
            body = f"<div{self.named('neutral')}>{self.extra('side') if self.chance(0.3) else ''}{body}{self.extra('side') if self.chance(0.3) else ''}</div>"
        self.rng.shuffle(before)
        return "<html><body>" + "".join(before) + body + "".join(after) + "</body></html>"


class Model:
    """Numbers of attribute tokens, and trees."""

    def __init__(self, vocabulary: Buckets, trees: Trees):
        self.vocabulary, self.trees = vocabulary, trees


def fit(pages: list[str], seed: int = SEED) -> Model:
    """Train on sampled pages and on random layouts of their texts."""
    rng = np.random.default_rng(seed)
    trees: list[tuple[Page, list[bool]]] = []
    for source in pages:
        page = parse(source)
        known = labels(page)
        if known is not None:
            trees.append((page, known))
    for k in range(LAYOUTS if trees else 0):
        page, known = trees[k % len(trees)]
        words = " ".join(run for _, run, _ in page.runs).split() or ["word"]
        blocks = [run for node, run, _ in page.runs if known[node]]
        if rng.random() < SHORT_LAYOUTS:  # not all texts are long: a few blocks of a few words, drawn from the page's
            blocks = [" ".join(words[int(i)] for i in rng.integers(len(words), size=int(rng.integers(3, 12)))) for _ in range(int(rng.integers(1, 10)))]
        made = parse(Layout(rng, words).page(blocks or ["word"]), MARK)
        trees.append((made, labels(made)))
    if not trees:
        made = [parse(Layout(rng, "some words to fill a page with text".split()).page(["Some words, and more of them. " * 3] * 4), MARK) for _ in range(50)]
        trees = [(p, labels(p)) for p in made]
    vocabulary = Buckets(TOKENS)
    share = min(1.0, NODES / max(1, sum(len(p.tags) for p, _ in trees)))
    xs, ys = [], []
    for page, known in trees:
        at = 0
        for x in feature_chunks([page], vocabulary):
            y, taken = np.array(known[at : at + len(x)], dtype=float), rng.random(len(x)) < share
            at += len(x)
            xs.append(x[taken])
            ys.append(y[taken])
    return Model(vocabulary, Trees().fit(np.concatenate(xs), np.concatenate(ys)))


def main_texts(model: Model, sources: list[str | None]) -> list[str]:
    """Main text of each page."""
    out: list[str] = []
    part: list[Page] = []

    def run() -> None:
        odds = [o for x in feature_chunks(part, model.vocabulary) for o in model.trees.score(x).tolist()]
        at = 0
        for page in part:
            kept = decode(page, odds[at : at + len(page.tags)])
            at += len(page.tags)
            out.append("\n".join(text for node, text, _ in page.runs if kept[node]))

    for source in sources:
        part.append(parse(source or ""))
        if sum(len(p.tags) for p in part) >= CHUNK_NODES:
            run()
            part = []
    if part:
        run()
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Train on a bounded sample of pages, the first in the order of a digest of id and html."""
    known = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).cast("string").alias("h"), F.xxhash64(F.col(id_col).cast("string"), html_col).alias("d"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")).first()
    # about twice the pages are let through, so that few are sorted; the first always is. Of equal rows one is taken
    draw = F.pmod("d", F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = known.where((draw < (2.0 * SAMPLE + 50) / max(size["n"], 1)) | (F.col("d") == size["first"])).dropDuplicates(["d"])
    return fit([r["h"] for r in drawn.orderBy("d").limit(SAMPLE).collect()])


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
