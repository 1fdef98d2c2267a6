"""Pages as trees of block nodes with text runs, and the nodes' features."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np

#: Fixed values of the HTML standard: elements that start a block, elements whose content is never shown as text of the
#: page or is a form's, elements whose content is no markup.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 header footer nav aside ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset blockquote pre figure figcaption address details summary hgroup menu dialog".split()
)
SKIPPED = frozenset("script style template iframe title textarea select button head".split())
RAW = frozenset("script style textarea title iframe".split())
CLOSES_P = BLOCKS - {"html", "body"}
HOLDS_P = ("td", "th", "li", "div", "section", "article", "main", "aside", "blockquote", "table")
#: An element, the open elements that its start tag ends, and the elements that this does not reach beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

#: What follows "<" in a start or end tag: its name, then attributes up to ">". An attribute's name ends at white space, "/",
#: ">" or "="; its value is quoted, or ends at white space or ">". All repeats are possessive, so a tag is read once.
NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
VALUE = r"[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^ \t\n\f\r>]*+))"
TAG = re.compile(rf"(/?)([A-Za-z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{NAME}(?:{VALUE})?+)*+)>")
ATTRIBUTE = re.compile(rf"({NAME})(?:{VALUE})?+")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")
NAMED = ("class", "id", "role", "itemprop", "aria-label")


class Page:
    """Block nodes in page order: tag, parent, end of the subtree, attribute tokens; text runs (node, text, link characters)."""

    __slots__ = ("depth", "end", "inputs", "marked", "parent", "place", "previous", "runs", "tags", "tokens")

    def __init__(self) -> None:
        self.tags, self.parent, self.end, self.depth, self.place, self.previous = [], [], [], [], [], []
        self.tokens: list[tuple[str, ...]] = []
        self.inputs: list[int] = []
        self.marked: list[bool] = []
        self.runs: list[tuple[int, str, int]] = []


def attribute_tokens(raw: str, mark: str | None = None) -> tuple[tuple[str, ...], bool]:
    """Lower-case word parts of the naming attributes, and whether the element has the attribute ``mark``."""
    if not raw or raw.isspace():
        return (), False
    found, marked = [], False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in NAMED:
            found += [w.lower() for w in WORD_PARTS.findall(a or b or c)]
        marked |= name == mark
    return tuple(dict.fromkeys(found)), marked


def parse(source: str, mark: str | None = None) -> Page:
    """A tolerant parse in one forward pass: unknown end tags are ignored, missing ones are implied.

    A tag that the page's end cuts off is dropped with what follows, as browsers do. ``mark``: an attribute of main
    text, for made training pages.
    """
    page = Page()
    stack: list[int] = []
    counts: list[int] = []
    last_child: list[int] = []
    text: list[str] = []
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
    missing: set[str] = set()  # end tags that do not come any more
    links = 0
    in_link = False

    def start(tag: str, tokens: tuple[str, ...], marked: bool) -> None:
        node, up = len(page.tags), stack[-1] if stack else -1
        page.tags.append(tag)
        page.parent.append(up)
        page.end.append(node + 1)
        page.depth.append(len(stack))
        page.place.append(counts[up] if stack else 0)
        page.previous.append(last_child[up] if stack else -1)
        page.tokens.append(tokens)
        page.inputs.append(0)
        page.marked.append(marked)
        counts.append(0)
        last_child.append(-1)
        if stack:
            counts[up] += 1
            last_child[up] = node
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)

    def flush() -> None:
        nonlocal links
        if text:
            run = " ".join("".join(text).split())
            if run:
                page.runs.append((stack[-1], run, min(links, len(run))))
            text.clear()
            links = 0

    def close_to(size: int) -> None:
        while len(stack) > size:
            node = stack.pop()
            open_at[page.tags[node]].pop()
            page.end[node] = len(page.tags)

    def innermost(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(names, within) -> None:
        """End the innermost of ``names``, unless one of ``within`` is inside it."""
        place = innermost(names)
        if place and place > innermost(within):
            close_to(place)

    def put(piece: str) -> None:
        text.append(html.unescape(piece) if "&" in piece else piece)

    start("html", (), False)
    at, n = 0, len(source)
    while at < n:
        here = source.find("<", at)
        if here < 0:
            put(source[at:])
            break
        if here > at:
            put(source[at:here])
            if in_link:
                links += here - at
        after = source[here + 1 : here + 2]
        if after in ("!", "?"):
            comment = source.startswith("<!--", here)
            end = source.find("-->" if comment else ">", here + (2 if comment else 1))
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        letter = source[here + 2 : here + 3] if after == "/" else after
        if not (letter.isascii() and letter.isalpha()):
            text.append("<")
            at = here + 1
            continue
        m = TAG.match(source, here + 1)
        if m is None:
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS and tag not in ("html", "body") and open_at.get(tag):
                flush()
                close_to(open_at[tag][-1])
                in_link = False
            continue
        if tag in SKIPPED:
            if m[3].endswith("/") and tag not in RAW:
                continue
            end = None
            if tag not in missing:
                end = re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I).search(source, at)
            if end is not None:
                at = source.find(">", end.end()) + 1 or n
            else:
                missing.add(tag)
                if tag in RAW:
                    at = n
            text.append(" ")
            continue
        if tag == "a":
            in_link = True
        elif tag in ("br", "img"):
            text.append(" ")
        elif tag == "hr":
            flush()
            close(("p",), HOLDS_P)
        elif tag == "input":
            page.inputs[stack[-1]] += 1
        elif tag in BLOCKS and tag not in ("html", "body"):
            flush()
            in_link = False
            if tag in CLOSES_P:
                close(("p",), HOLDS_P)
            if tag in ENDS:
                close(*ENDS[tag])
            start(tag, *attribute_tokens(m[3], mark))
    flush()
    close_to(0)
    return page


#: Tags with a feature of their own; others share one.
TAGS = ("html", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "header", "footer", "nav", "aside", "ul", "ol", "li", "table", "tr", "td", "form", "blockquote", "pre", "figure", "figcaption")
NUMBERS = (
    "depth place siblings alike children own_chars own_words own_links own_marks word_length chars links nodes_per_char marks share before inputs "
    "parent_chars parent_links of_parent previous_chars previous_links next_chars next_links runs"
).split()


#: Cells of a feature matrix that is made at a time.
CELLS = 3_000_000


class Buckets:
    """Numbers of attribute tokens by a digest, so that every token of every page counts and none is left out for being rare."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n

    def get(self, token: str) -> int:
        return zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.n


def feature_chunks(pages: list[Page], vocabulary: dict[str, int] | Buckets, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Feature rows of all nodes of the pages, page after page, some nodes at a time however large a page is."""
    sizes = np.array([len(p.tags) for p in pages], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    shift = np.repeat(first, sizes)
    page_of = np.repeat(np.arange(len(pages)), sizes)

    def joined(name: str) -> np.ndarray:
        return np.fromiter((v for p in pages for v in getattr(p, name)), dtype=np.int64, count=n)

    parent, previous = joined("parent"), joined("previous")
    end = joined("end") + shift
    up = np.where(parent >= 0, parent + shift, np.arange(n))
    before_me = np.where(previous >= 0, previous + shift, -1)
    after_me = np.full(n, -1)
    after_me[before_me[before_me >= 0]] = np.flatnonzero(before_me >= 0)
    own = np.zeros((n, 6))  # characters, words, link characters, marks, runs, inputs
    at, stats = [], []
    for p, f in zip(pages, first.tolist(), strict=True):
        for node, run, links in p.runs:
            at.append(f + node)
            stats.append((len(run), run.count(" ") + 1, links, len(PUNCTUATION.findall(run)), 1))
    if at:
        stats = np.array(stats, dtype=float)
        for k in range(5):
            own[:, k] = np.bincount(at, stats[:, k], n)
    own[:, 5] = joined("inputs")
    sums = np.concatenate([np.zeros((1, 6)), np.cumsum(own, axis=0)])
    below = sums[end] - sums[:-1]
    whole = below[first][page_of] if n else below
    before = sums[:-1] - sums[first][page_of] if n else below
    tag = np.fromiter((_TAG.get(t, len(TAGS)) for p in pages for t in p.tags), dtype=np.int64, count=n)
    siblings = np.bincount(up, minlength=n)[up]
    key, inverse, alike = np.unique(up * 64 + tag, return_inverse=True, return_counts=True)
    chars, links = below[:, 0], below[:, 2] / np.maximum(below[:, 0], 1)

    def of(where: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.where(where >= 0, values[where], 0)

    log = np.log1p
    columns = (
        joined("depth"), joined("place"), siblings, alike[inverse], np.bincount(up[parent >= 0], minlength=n),
        log(own[:, 0]), log(own[:, 1]), own[:, 2] / np.maximum(own[:, 0], 1), own[:, 3] / np.maximum(own[:, 1], 1), own[:, 0] / np.maximum(own[:, 1], 1),
        log(chars), links, (end - np.arange(n)) / (chars + 10), below[:, 3] / np.maximum(below[:, 1], 1), chars / np.maximum(whole[:, 0], 1), before[:, 0] / np.maximum(whole[:, 0], 1), below[:, 5],
        log(chars[up]), links[up], chars / np.maximum(chars[up], 1), log(of(before_me, chars)), of(before_me, links), log(of(after_me, chars)), of(after_me, links), own[:, 4],
    )
    # sets of tokens and tags as bits of one number: the node's own tokens, then tokens and tags of all nodes above it
    n_tokens, n_tags = len(vocabulary), len(TAGS) + 1
    mine, above = [0] * n, [0] * n
    for p, f in zip(pages, first.tolist(), strict=True):
        for k, (tokens, parent_k) in enumerate(zip(p.tokens, p.parent, strict=True)):
            bits = 0
            for t in tokens:
                c = vocabulary.get(t)
                if c is not None:
                    bits |= 1 << c
            mine[f + k] = bits
            if parent_k >= 0:
                u = f + parent_k
                above[f + k] = above[u] | mine[u] | 1 << (n_tokens + int(tag[u]))
    base = len(NUMBERS)
    width = base + n_tags + n_tokens + n_tokens + n_tags
    bytes_mine, bytes_above = (n_tokens + 7) // 8, (n_tokens + n_tags + 7) // 8

    def unpacked(numbers: list[int], n_bytes: int, n_bits: int) -> np.ndarray:
        packed = np.frombuffer(b"".join(v.to_bytes(n_bytes, "little") for v in numbers), dtype=np.uint8)
        return np.unpackbits(packed.reshape(len(numbers), n_bytes), axis=1, bitorder="little")[:, :n_bits]

    step = max(1, cells // width)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        out = np.zeros((hi - lo, width), dtype=np.float32)
        for k, c in enumerate(columns):
            out[:, k] = c[lo:hi]
        out[np.arange(hi - lo), base + tag[lo:hi]] = 1
        at = base + n_tags
        if n_tokens:
            out[:, at : at + n_tokens] = unpacked(mine[lo:hi], bytes_mine, n_tokens)
        out[:, at + n_tokens :] = unpacked(above[lo:hi], bytes_above, n_tokens + n_tags)
        yield out


def features(pages: list[Page], vocabulary: dict[str, int] | Buckets) -> np.ndarray:
    """All feature rows together."""
    parts = list(feature_chunks(pages, vocabulary))
    return np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)


_TAG = {t: k for k, t in enumerate(TAGS)}
