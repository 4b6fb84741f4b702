"""The main text of web pages, by boosted trees over the nodes of their document trees."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit_boosted
from .dom import CONTROLS, HEADINGS, Shape, Trees, parse, text_of

#: Pages that the trees are fitted on, those of least hash, each of at most so many characters; and layouts made from their sentences.
FIT_PAGES, FIT_CHARS, LAYOUTS = 300, 100_000, 900
#: Pages and characters that are worked on together.
TOGETHER, TOGETHER_CHARS = 256, 4_000_000
#: Names that authors give to the parts of a page, for the layouts. Fixed values.
NAMES = {
    "main": "article post entry story content main text body blog single prose article-body post-content entry-content story-text markdown reader",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toc links main-menu top-nav",
    "header": "header masthead topbar branding logo site-header page-head",
    "footer": "footer colophon copyright legal site-footer bottom page-foot credits",
    "sidebar": "sidebar aside rail widget related recommended popular trending more secondary",
    "notice": "cookie consent gdpr notice alert popup modal overlay newsletter subscribe message toast",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense promoted commercial",
    "form": "form search login signup contact register searchbox",
    "comments": "comments comment disqus discussion replies respond thread reactions responses",
    "share": "share social sharing tags byline-links follow",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
NEUTRAL = "page wrapper container site inner layout row col outer grid block section box".split()
ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
MARK = "\ue000"
#: Elements that mark the main text on real pages, and those that take parts out of it.
SAYS_MAIN, SAYS_OTHER = frozenset(["article", "main"]), frozenset("nav aside footer form".split())


class Layouts:
    """Pages put together from sentences, in which MARK leads every piece of the main text."""

    def __init__(self, sentences: list[str], seed: int = 0) -> None:
        self.random, self.sentences = random.Random(seed), sentences or ["Text."]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.random.choice(self.sentences) for _ in range(self.random.randint(low, high)))

    def words(self, most: int) -> str:
        return " ".join(self.random.choice(self.sentences).split()[: self.random.randint(1, most)]) or "x"

    def tag(self, kind: str, inner: str, named: float, element: str | None = None) -> str:
        r, attributes = self.random, ""
        element = element or (ELEMENTS.get(kind, "div") if r.random() < 0.5 else r.choice(["div", "div", "section"]))
        if r.random() < named and (element in ("div", "section") or r.random() < 0.5):
            own = r.choice(NAMES[kind] if kind in NAMES else NEUTRAL)
            more = [r.choice(NEUTRAL)] if r.random() < 0.3 else []
            attributes = f' {r.choice(["class", "class", "id"])}="{" ".join([own, *more])}"'
        elif r.random() < 0.2:
            attributes = f' class="{r.choice(["css", "sc", "jsx"])}-{r.randrange(1 << 30):x}"'
        return f"<{element}{attributes}>{inner}</{element}>"

    def links(self, low: int, high: int) -> str:
        r = self.random
        each = [f'<a href="/{i}">{self.words(4)}</a>' for i in range(r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>" if r.random() < 0.7 else " ".join(each)

    def noise(self, kind: str, named: float) -> str:
        r = self.random
        if kind == "menu":
            inner = self.links(2, 12)
        elif kind == "header":
            inner = f"<a href='/'>{self.words(4)}</a>" + (f"<p>{self.words(8)}</p>" if r.random() < 0.5 else "") + (self.tag("menu", self.links(2, 8), named) if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = ("<p>" if r.random() < 0.5 else "") + "&copy; " + self.some(1, 2) + (self.links(1, 6) if r.random() < 0.5 else "")
        elif kind == "sidebar":
            inner = f"<h3>{self.words(4)}</h3>" + (self.links(2, 8) if r.random() < 0.6 else f"<p>{self.some(1, 4)}</p>")
        elif kind == "comments":
            inner = f"<h3>{self.words(3)}</h3>" + "".join(f"<div><b>{self.words(2)}</b><p>{self.some(1, 6)}</p></div>" for _ in range(r.randint(1, 8)))
            return self.tag(kind, inner, 1.0, r.choice(["div", "section", "ol"]))  # nothing else tells them from the article
        elif kind == "form":
            inner = f"<label>{self.words(3)}</label><input name=q><button>{self.words(2)}</button>" + (f"<p>{self.some(1, 1)}</p>" if r.random() < 0.3 else "")
        elif kind == "share":
            inner = self.links(2, 6)
            named = 1.0
        else:
            inner = f"<p>{self.some(1, 2)}</p>" if r.random() < 0.5 else self.some(1, 2)
            named = 1.0
            return self.tag(kind, inner, named, r.choice(["div", "div", "aside", "section"]))
        return self.tag(kind, inner, named)

    def paragraph(self) -> str:
        r = self.random
        text = MARK + (self.words(3) if r.random() < 0.15 else self.some(1, 8))
        what = r.random()
        if what < 0.05:
            return "<ul>" + "".join(f"<li>{MARK}{self.some(1, 2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if what < 0.09:
            return f"<h2>{MARK}{self.words(6)}</h2>"
        if what < 0.12:
            return f"<blockquote><p>{text}</p></blockquote>"
        if what < 0.15:
            return "<table>" + "".join(f"<tr><td>{MARK}{self.words(3)}</td><td>{MARK}{self.words(3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if what < 0.18:
            return f"<figure><img src=x><figcaption>{text}</figcaption></figure>"
        if what < 0.21:
            return f"<pre>{text}</pre>"
        if what < 0.25:
            return f'<p>{text} <a href="/x">{self.words(5)}</a></p>'
        if what < 0.28:
            return f'<p><a href="/x">{MARK}{self.words(5)}</a></p>'
        if what < 0.33:
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>" if r.random() < 0.9 else f"<div>{text}</div>" if r.random() < 0.5 else f"{text}<br><br>"

    def page(self) -> str:
        r = self.random
        named = r.choice([1.0, 1.0, 0.7, 0.3])
        body = [f"<h1>{MARK}{self.words(10)}</h1>"] if r.random() < 0.8 else []
        body += [self.paragraph() for _ in range(r.choice([1, 2, 3, 5, 8, 15, 30]))]
        for kind in ("advert", "share", "notice", "sidebar", "form"):
            if r.random() < 0.15:
                body.insert(r.randint(0, len(body)), self.noise(kind, 1.0))
        element = r.choice(["article", "article", "main", "div", "div", "div", "section"])
        article = self.tag("main", "".join(body), 1.0 if element == "div" and r.random() < 0.85 else 0.4, element)
        for _ in range(r.choice([0, 0, 1, 2])):
            beside = self.noise(r.choice(["sidebar", "advert", "menu", "share"]), named) if r.random() < 0.5 else ""
            article = self.tag(r.choice(["neutral", "neutral", "main"]), article + beside if r.random() < 0.5 else beside + article, 0.8, r.choice(["div", "div", "main", "section"]))
        before = [self.noise(k, named) for k in ("header", "menu", "notice", "form", "advert", "sidebar") if r.random() < 0.35]
        after = [self.noise(k, named) for k in ("share", "comments", "sidebar", "advert", "footer", "notice", "form") if r.random() < 0.4]
        r.shuffle(before)
        pieces = [*before, article, *after]
        if r.random() < 0.1:
            pieces = ["<table>", *(f"<tr><td>{x}</td></tr>" for x in pieces), "</table>"]
        parts = "".join(pieces)
        for _ in range(r.choice([0, 0, 1, 2])):
            parts = self.tag("neutral", parts, 0.8, "div")
        return f"<html><head><title>{self.words(5)}</title></head><body>{parts}</body></html>"


FEATURES = (
    "depth", "chars", "linked", "tags", "density", "before", "behind", "share", "of_parent", "index", "siblings", "alike", "previous", "next", "stops",
    "own", "worst_above", "best_above", "around", "best_below", "worst_below", "beside", "tag", "tag_around", "worst_tag_above", "best_tag_above", "best_tag_below",
    "is_text", "is_item", "controls", "heading", "in_paragraph", "items", "pages_best", "rank",
)


def features(trees: Trees, shape: Shape, token_odds: dict[str, float], tag_odds: dict[str, float]) -> np.ndarray:
    """(nodes, FEATURES): how much text, links and elements each node holds, what stands around it, and how often its names and its neighbours' hold main text."""
    n, parent, depth, page = len(trees.tag), shape.parent, shape.depth, np.array(trees.page, np.int64)
    up = np.maximum(parent, 0)
    text = np.array([t is not None for t in trees.text])
    chars = np.array([len(t) if t else 0 for t in trees.text], float)
    stops = np.array([t.count(",") + t.count(".") + t.count("?") + t.count("!") if t else 0 for t in trees.text], float)
    own_token = np.array([sum(token_odds.get(w, 0.0) for w in t) for t in trees.tokens])
    own_tag = np.array([tag_odds.get(t, 0.0) for t in trees.tag])
    heading, item = (np.array([t in kinds for t in trees.tag]) for kinds in (HEADINGS, frozenset(["li", "dd", "dt", "td", "option"])))
    paragraph = np.array([t in ("p", "pre", "blockquote") for t in trees.tag])
    controls = np.array(trees.controls, float) + np.array([t in CONTROLS for t in trees.tag])
    total = {k: shape.total(v) for k, v in {"chars": chars, "links": np.array(trees.links, float), "tags": ~text, "stops": stops, "controls": controls, "items": item & ~text}.items()}
    c = total["chars"]
    first = np.r_[True, page[1:] != page[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    whole = np.maximum(c[start], 1.0)
    running = np.cumsum(chars) - chars
    before = (running - running[start]) / whole
    share = c / whole
    order = np.argsort(parent, kind="stable")
    group = np.r_[True, parent[order][1:] != parent[order][:-1]]
    head = np.maximum.accumulate(np.where(group, np.arange(n), 0))
    index = np.empty(n)
    index[order] = np.arange(n) - head
    count = np.bincount(parent + 1, minlength=n + 1)[parent + 1].astype(float)
    ids: dict[str, int] = {}
    kind = np.array([ids.setdefault(t, len(ids)) for t in trees.tag], np.int64)
    pair = parent * len(ids) + kind
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    last, following = np.zeros(n), np.zeros(n)
    together = ~group[1:]
    last[order[1:][together]] = c[order[:-1][together]]
    following[order[:-1][together]] = c[order[1:][together]]
    around_sum = np.bincount(parent + 1, own_token, n + 1)[parent + 1]
    tag_up = np.where(depth > 0, own_tag[up], 0.0)
    best = np.maximum.reduceat(own_token, np.flatnonzero(first))[np.cumsum(first) - 1]
    down = {k: shape.handed_down(v, f) for k, v, f in (("wt", own_token, np.minimum), ("bt", own_token, np.maximum), ("wg", own_tag, np.minimum), ("bg", own_tag, np.maximum))}
    below = {k: shape.handed_up(v, f) for k, v, f in (("bt", own_token, np.maximum), ("wt", own_token, np.minimum), ("bg", own_tag, np.maximum))}
    log = np.log1p
    columns = (
        depth, log(c), total["links"] / np.maximum(c, 1), log(total["tags"]), log(c / (total["tags"] + 1)), before, 1 - before - share, share, c / np.maximum(c[up], 1), index / np.maximum(count, 1), log(count), times[back] / np.maximum(count, 1), log(last), log(following), total["stops"] / np.maximum(c, 1),
        own_token, down["wt"], down["bt"], np.where(depth > 0, own_token[up], 0.0), below["bt"], below["wt"], (around_sum - own_token) / np.maximum(count - 1, 1), own_tag, tag_up, down["wg"], down["bg"], below["bg"],
        text, item | (text & item[up]), log(total["controls"]), heading | (text & heading[up]), paragraph | (text & paragraph[up]), total["items"] / np.maximum(total["tags"], 1), best, best - own_token,
    )
    return np.column_stack([np.asarray(x, float) for x in columns])


@dataclass
class PageModel:
    """Boosted trees over FEATURES, and the log odds that a name's or an element's nodes hold main text."""

    trees: Boosted
    token_odds: dict[str, float]
    tag_odds: dict[str, float]


def _holds(trees: Trees, shape: Shape, main: np.ndarray) -> np.ndarray:
    """Whether a node or one below it is main text."""
    return shape.handed_up(main, np.maximum) > 0


def _odds(seen: list[tuple[str, bool]]) -> dict[str, float]:
    """Smoothed log odds by name, of names seen three times at least."""
    yes, all_ = Counter(k for k, held in seen if held), Counter(k for k, _ in seen)
    return {k: math.log((yes[k] + 1) / (n - yes[k] + 1)) for k, n in sorted(all_.items()) if n >= 3}


def fit_pages(pages: list[str], layouts: int = LAYOUTS, seed: int = 0) -> PageModel:
    """Learn from pages and from layouts made of their sentences.

    A page teaches by its own elements where it has an ``article`` or ``main``;
    in layouts the main text is known. A node is taught as holding main text or not, given that
    the node around it holds some, as the decoding asks. Half of the layouts
    are fitted on after names have been counted in the other half, so their odds are not seen twice.
    """
    real, main = Trees(), []
    for k, html in enumerate(pages):
        parse(html, real, k)
    sentences = sorted({s for t in real.text if t for s in _sentences(t)})
    maker = Layouts(sentences, seed)
    made = Trees()
    for k in range(layouts):
        parse(maker.page(), made, k)
    main_made = np.array([bool(t) and MARK in t for t in made.text], float)
    made.text = [t.replace(MARK, "") if t else t for t in made.text]
    shape_made = Shape.of(made)
    held = _holds(made, shape_made, main_made)
    page = np.array(made.page)
    counted = page % 2 == 0
    up = np.maximum(shape_made.parent, 0)
    # by the element of the node itself, where the one around holds main text
    asked = (shape_made.depth > 0) & held[up]
    use = np.flatnonzero(counted & asked)
    token_odds = _odds([(w, bool(held[i])) for i in use for w in made.tokens[i]])
    tag_odds = _odds([(made.tag[i], bool(held[i])) for i in use])
    fit = np.flatnonzero(~counted & asked)
    x, y = [features(made, shape_made, token_odds, tag_odds)[fit]], [held[fit]]
    if pages:
        shape = Shape.of(real)
        says = shape.handed_down(np.array([t in SAYS_MAIN for t in real.tag], float), np.maximum) > 0
        other = shape.handed_down(np.array([t in SAYS_OTHER or "ad" in w for t, w in zip(real.tag, real.tokens, strict=True)], float), np.maximum) > 0
        main = np.array([t is not None for t in real.text]) & says & ~other
        held_real = _holds(real, shape, main.astype(float))
        taught = np.bincount(np.array(real.page), main, len(pages))[np.array(real.page)] > 0
        use = np.flatnonzero(taught & (shape.depth > 0) & held_real[np.maximum(shape.parent, 0)])
        x.append(features(real, shape, token_odds, tag_odds)[use])
        y.append(held_real[use])
    x, y = np.concatenate(x), np.concatenate(y).astype(float)
    return PageModel(fit_boosted(x, y, np.ones(len(y))), token_odds, tag_odds)


def _sentences(text: str) -> list[str]:
    """Pieces of up to 40 words, for layouts."""
    words = text.replace(MARK, "").replace("&", " ").replace("<", " ").split()
    return [" ".join(words[i : i + 12 + i % 29]) for i in range(0, min(len(words), 400), 40)]


def main_texts(pages: list[str | None], model: PageModel) -> list[str]:
    """The main text of each of some pages, worked on together.

    The trees give the chance that a node holds main text if the node around it
    does; the product along the way from the page's root is its own chance. A
    node's chance is then never over that of one above it, so no text is kept
    inside a part that is dropped, and none is dropped alone without reason.
    """
    trees = Trees()
    for k, html in enumerate(pages):
        parse(html or "", trees, k)
    if not pages:
        return []
    shape = Shape.of(trees)
    chance = model.trees.chance(features(trees, shape, model.token_odds, model.tag_odds))
    chance[shape.depth == 0] = 1.0
    chance = shape.handed_down(chance, np.multiply)
    kept: list[list[int]] = [[] for _ in pages]
    for i in np.flatnonzero(chance >= 0.5).tolist():
        if trees.text[i] is not None:
            kept[trees.page[i]].append(i)
    return [text_of(trees, nodes) for nodes in kept]


def sample_pages(pages: DataFrame, html_col: str = "html", rows: int = FIT_PAGES, chars: int = FIT_CHARS) -> list[str]:
    """At most ``rows`` distinct pages of at most ``chars`` characters, those of least hash."""
    texts = pages.select(F.col(html_col).alias("html")).filter(F.length("html").between(1, chars))
    slim = texts.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(rows)
    found = texts.withColumn("h", F.xxhash64("html")).join(F.broadcast(slim), "h").dropDuplicates(["h"])
    return [r["html"] for r in found.orderBy("h").collect()]


def extract_text(pages: DataFrame, model: PageModel, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each row's whole page; an older column is replaced. Null and empty pages have the empty text.

    One pass without a shuffle; a task holds a few pages' trees.
    """
    if html_col == "text":
        raise ValueError("the column of pages is named as the result")
    pages = pages.drop("text")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at, texts, some, size = batch.schema.names.index(html_col), [], [], 0
            for h in batch.column(at):
                html = h.as_py() or ""
                if some and (len(some) == TOGETHER or size + len(html) > TOGETHER_CHARS):
                    texts += main_texts(some, model)
                    some, size = [], 0
                some.append(html)
                size += len(html)
            texts += main_texts(some, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return pages.mapInArrow(run, pages.select("*", F.lit(None).cast("string").alias("text")).schema)


def op13_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = extract_text(pages, fit_pages(sample_pages(pages)))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
