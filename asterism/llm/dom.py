"""Pages of HTML as trees of elements and texts, in flat arrays over many pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

#: Elements that end a line of text; all others run on.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTROLS = frozenset("button fieldset input label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without text of the page: their content is passed over, up to the end of the page (RAW) or only if they are closed.
RAW = frozenset("iframe noembed noframes script style textarea title".split())
APART = frozenset("audio canvas datalist noscript select svg template video".split())
#: What a start tag closes: elements to close, and those that they are not looked for behind.
_P = (frozenset(["p"]), frozenset("button caption td th".split()))
_LI = (frozenset(["li"]), frozenset("ol ul menu dir".split()))
_DD = (frozenset("dd dt".split()), frozenset(["dl"]))
_TD = (frozenset("td th".split()), frozenset("tr table".split()))
_TR = (frozenset(["tr"]), frozenset(["table"]))
_BODY = (frozenset("tbody thead tfoot".split()), frozenset(["table"]))
CLOSES = {"li": (_LI,), "dd": (_DD,), "dt": (_DD,), "td": (_TD,), "th": (_TD,), "tr": (_TR,), "tbody": (_BODY,), "thead": (_BODY,), "tfoot": (_BODY,)}
ENDS_P = BLOCKS - frozenset("body button caption head html legend optgroup option tbody td tfoot th thead tr".split())
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
CELLS = frozenset("td th caption".split())
#: Elements within each other; deeper ones add their text to the last.
DEEPEST = 512

START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
COMMENT = re.compile(r"--!?>")
NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|style|aria-label)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TOKENS = 16


def tokens_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id, role and the like, without a plural s; ``hidden`` where it is not shown."""
    out: list[str] = []
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"(display:\s*none|visibility:\s*hidden)", value):
            out.append("hidden")
        elif name != "style":
            for w in PIECES.findall(value):
                w = w.lower()
                out.append(w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w)
    return tuple(dict.fromkeys(out[:TOKENS]))


@dataclass
class Trees:
    """Nodes of many pages in order of appearance: elements and texts (tag ``#``)."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    glued: list[bool] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)

    def add(self, page: int, parent: int, depth: int, tag: str, tokens: tuple[str, ...] = (), text: str | None = None, glued: bool = False, links: int = 0) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(depth)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.glued.append(glued)
        self.links.append(links)
        self.controls.append(0)
        return len(self.page) - 1


class _Builder:
    """The tree of one page."""

    def __init__(self, trees: Trees, page: int) -> None:
        self.trees, self.page = trees, page
        root = trees.add(page, -1, 0, "html")
        self.stack: list[tuple[str, int]] = [("html", root)]  # element, its node or the one around
        self.open: dict[str, int] = {"html": 1}
        self.over = 0
        self.pieces: list[str] = []
        self.linked = self.in_link = 0
        self.glued = False

    def write(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(text)

    def flush(self, boundary: bool) -> None:
        """What was written becomes a text; the next one stands on its own behind a boundary or white space."""
        if self.pieces:
            text = "".join(self.pieces)
            if text.isspace() or not text:
                self.glued = self.glued and not text
            else:
                node = self.stack[-1][1]
                self.trees.add(self.page, node, self.trees.depth[node] + 1, "#", (), text, self.glued, self.linked)
                self.glued = True
            self.pieces, self.linked = [], 0
        if boundary:
            self.glued = False

    def pop(self) -> None:
        tag, node = self.stack.pop()
        self.open[tag] -= 1
        if tag == "a":
            self.in_link -= 1
        if tag in BLOCKS:
            self.flush_at(node, True)
        elif node != self.stack[-1][1]:
            self.flush_at(node, False)

    def flush_at(self, node: int, boundary: bool) -> None:
        self.stack.append(("", node))
        self.flush(boundary)
        self.stack.pop()

    def close(self, wanted: frozenset, barriers: frozenset) -> None:
        """End the nearest open element of ``wanted``, unless a barrier comes first."""
        if not any(self.open.get(w) for w in wanted):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in wanted:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in barriers:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        for wanted, barriers in CLOSES.get(tag, ()):
            self.close(wanted, barriers)
        if tag in ENDS_P:
            self.close(*_P)
        if tag == "a" and self.open.get("a"):
            self.end("a")
        if tag in CONTROLS:
            self.trees.controls[self.stack[-1][1]] += 1
        if tag in VOID:
            if tag == "hr":
                self.flush(True)
            elif tag == "br":
                self.pieces.append("\n")
            return
        if len(self.stack) >= DEEPEST:
            self.over += 1
            return
        block, node = tag in BLOCKS, self.stack[-1][1]
        tokens = tokens_of(attributes) if attributes and attributes != " " else ()
        if block or tokens:
            self.flush(block)
            node = self.trees.add(self.page, node, self.trees.depth[node] + 1, tag, tokens)
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "a":
            self.in_link += 1

    def end(self, tag: str) -> None:
        if self.over:
            self.over -= 1
            return
        if tag == "br":
            self.pieces.append("\n")
        if tag == "p" and not self.open.get("p"):
            self.flush(True)  # an empty paragraph
        if not self.open.get(tag) or tag == "html":
            return
        block = tag in BLOCKS
        for k in range(len(self.stack) - 1, 0, -1):
            now = self.stack[k][0]
            if now == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if now in BLOCKS and not block or now in CELLS and tag not in TABLE:
                return


def parse(html: str, trees: Trees, page: int) -> None:
    """Add a page's nodes to ``trees``, in one pass over its characters.

    Tags need not be closed or nested rightly: paragraphs, items and cells end
    where HTML says, ends without a start are passed over. Character references are decoded. A tag or comment without
    an end takes what follows it, as in browsers.
    """
    b, at, n = _Builder(trees, page), 0, len(html)
    gone: set[str] = set()
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            b.write(html[at:])
            break
        if lt > at:
            b.write(html[at:lt])
        c = html[lt + 1 : lt + 2]
        if "a" <= c <= "z" or "A" <= c <= "Z":
            m = START.match(html, lt)
            if not m:
                break
            tag, at = m[1].lower(), m.end()
            if tag in RAW or tag in APART and tag not in gone and not m[2].endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if found:
                    at = found.end()
                    continue
                if tag in RAW:
                    break
                gone.add(tag)
            elif tag not in APART:
                b.start(tag, m[2])
        elif c == "/":
            m = END.match(html, lt)
            if m:
                b.end(m[1].lower())
                at = m.end()
            else:
                at = html.find(">", lt) + 1
                if not at:
                    break
        elif c == "!" and html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                at = html.index(">", lt) + 1
                continue
            m = COMMENT.search(html, lt + 4)
            if not m:
                break
            at = m.end()
        elif c in ("!", "?") and c:
            at = html.find(">", lt) + 1
            if not at:
                break
        else:
            b.write("<")
            at = lt + 1
    while len(b.stack) > 1:
        b.pop()
    b.flush(True)


@dataclass
class Shape:
    """Order of the nodes of ``Trees`` by level and parent."""

    parent: np.ndarray
    depth: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, trees: Trees) -> Shape:
        parent, depth = np.array(trees.parent, np.int64), np.array(trees.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1))
        return cls(parent, depth, np.split(order, cuts))

    def total(self, own: np.ndarray) -> np.ndarray:
        """Sums over each node and all below it."""
        out = own.astype(float).copy()
        for level in self.levels[:0:-1]:
            out += np.bincount(self.parent[level], out[level], len(out))
        return out

    def handed_down(self, own: np.ndarray, combine: np.ufunc) -> np.ndarray:
        """``combine`` over each node and all above it."""
        out = own.astype(float).copy()
        for level in self.levels[1:]:
            out[level] = combine(out[level], out[self.parent[level]])
        return out

    def handed_up(self, own: np.ndarray, combine: np.ufunc) -> np.ndarray:
        """``combine`` over each node and all below it."""
        out = own.astype(float).copy()
        for level in self.levels[:0:-1]:
            combine.at(out, self.parent[level], out[level])
        return out


def text_of(trees: Trees, nodes: list[int]) -> str:
    """The texts of some nodes in order: white space becomes one space, and so does the end of a block."""
    parts: list[str] = []
    for k, i in enumerate(nodes):
        if not (trees.glued[i] and k and nodes[k - 1] == _before(trees, i)):
            parts.append(" ")
        parts.append(trees.text[i])
    return " ".join("".join(parts).split())


def _before(trees: Trees, i: int) -> int:
    """The text before text i."""
    i -= 1
    while i >= 0 and trees.text[i] is None:
        i -= 1
    return i
