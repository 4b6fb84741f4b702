import re
import time
from html import unescape

import numpy as np
import pytest

from asterism.llm.boosting import fit_boosted
from asterism.llm.dom import Trees, parse, text_of, tokens_of
from asterism.llm.html_extraction import Layouts, MARK, extract_text, fit_pages, main_texts, op13_html, sample_pages


def texts(html):
    trees = Trees()
    parse(html, trees, 0)
    return [(trees.tag[trees.parent[i]], " ".join(t.split())) for i, t in enumerate(trees.text) if t is not None]


def whole(html):
    trees = Trees()
    parse(html, trees, 0)
    return text_of(trees, [i for i, t in enumerate(trees.text) if t is not None])


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return fit_pages(sample_pages(pages))


def test_tree_of_careless_markup():
    assert texts("<p>a<p><b>b<br><p>c</b>d<div>e</p>f</div>") == [("p", "a"), ("p", "b"), ("p", "cd"), ("div", "e"), ("div", "f")]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>x<td>y</div><tr><td>z</table>w") == [("li", "a"), ("li", "b"), ("li", "c"), ("td", "x"), ("td", "y"), ("td", "z"), ("html", "w")]
    assert texts("<div title='a>b' class=c>1 < 2 &amp; 3&nbsp;&lt;b&gt; &notit; <!-- x > y --><!-->z<?php q ?></unknown>!</div>") == [("div", "1 < 2 & 3 <b> ¬it; z!")]
    assert texts("<script>var a='<p>x</p>';</script><style>p{}</style><title>t</title><textarea><p>no</textarea><noscript>js</noscript>x") == [("html", "x")]
    assert texts("<svg><text>no</text></svg>a<svg/>b<select><option>c</select>d") == [("html", "abd")]
    assert texts("a<!-- never closed <p>b</p>") == [("html", "a")] and texts("a<script>b") == [("html", "a")] and texts("a<p title='b") == [("html", "a")]
    assert texts("") == [] and texts(" \n ") == []


def test_words_run_on_over_inline_elements_alone():
    assert whole("un<b>closed</b> <span class=ad>x</span>y<p>z</p>w<br>v <i> u</i>t") == "unclosed xy z w v ut"
    assert whole("<td>a<td>b<hr>c") == "a b c"


def test_names():
    assert tokens_of(' class="mainNav site-comments" id=top style="display: none"') == ("main", "nav", "site", "comment", "top", "hidden")
    assert tokens_of(' title="class" data-id="x"') == ()


def test_bad_pages_take_time_in_proportion():
    for unit in ("<div>", "<p><b>", "<a x='\"", "<!-", "</", "<svg>", "&", "<td><table>", "<a href=\"", "<script", "<p></div></b>", "<button><p>"):
        took = []
        for size in (20_000, 200_000):
            began = time.time()
            texts(unit * size)
            took.append(time.time() - began)
        assert took[1] < 30 * took[0] + 2, unit


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6))
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.3)).astype(float)
    fitted = fit_boosted(x[:3000], y[:3000], np.ones(3000), trees=40, depth=3)
    assert ((fitted.chance(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    plain = np.full(1000, fitted.base)
    for f, c, leaf in zip(fitted.feature, fitted.cut, fitted.leaf, strict=True):
        for r, row in enumerate(x[3000:]):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            plain[r] += leaf[at - len(f)]
    assert np.allclose(plain, fitted.log_odds(x[3000:]))
    assert fit_boosted(x[:50], np.ones(50), np.ones(50), trees=2).chance(x[:5]).min() > 0.9


def article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_query_gives_the_whole_articles(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op13_html(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], article(pages[r["page_id"]]["html"]), len(r["text"]))


def test_layouts_that_the_model_has_not_seen(model):
    maker = Layouts([f"Sentence {i} of many, with {i * i} things in it." for i in range(300)], seed=77)
    pages = [maker.page() for _ in range(300)]
    same = 0
    for page, got in zip(pages, main_texts([p.replace(MARK, "") for p in pages], model), strict=True):
        trees = Trees()
        parse(page, trees, 0)
        same += got == text_of(trees, [i for i, t in enumerate(trees.text) if t and MARK in t]).replace(MARK, "")
    assert same > 0.95 * len(pages)


def test_layouts_written_by_hand(model):
    blog = "<html><body class='home'><div id=page><header class='site-header'><a href=/>My Site</a><nav class='main-navigation'><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul></nav></header><div id=content><div class='entry-content'><h1>Big title</h1><p>First paragraph of the story, with words.</p><p>Second one. It goes on, and on.</p><div class='ad-slot advert'>Buy now!</div><p>Third.</p></div><div id=comments><h3>2 comments</h3><p>I think this is a great article, thanks for it.</p><p>Me too. I agree with all of it, really.</p></div></div><aside id=sidebar><h3>Related</h3><a href=x>Another story</a></aside><footer>&copy; 2020 All rights</footer></div></body></html>"
    news = "<body><form class=search><label>Search</label><input></form><div class=cookie-banner>We use cookies. Accept?</div><main><article><h2>Head</h2><p>Body text &amp; more&nbsp;text.<p>Un<b>closed</b> here</article><section class=comment-list><article class=comment><p>Reader says hello and more.</p></article></section></main><div class='footer'>Imprint</div></body>"
    table = "<html><body><table><tr><td><a href=a>Home</a> | <a href=b>News</a> | <a href=c>Sport</a></td></tr><tr><td><h1>Title here</h1><p>Long text of the main article, which goes on for a while. It has stops, commas, and more.</p><p>And another paragraph which is also long enough to be found.</p></td></tr><tr><td class=footer>Copyright 1999</td></tr></table></body></html>"
    assert main_texts([blog, news, table, "Just a text. It is the page."], model) == [
        "Big title First paragraph of the story, with words. Second one. It goes on, and on. Third.",
        "Head Body text & more text. Unclosed here",
        "Title here Long text of the main article, which goes on for a while. It has stops, commas, and more. And another paragraph which is also long enough to be found.",
        "Just a text. It is the page.",
    ]


def test_no_text_without_the_part_around_it(model):
    maker = Layouts(["One two three, four.", "Five."], seed=3)
    from asterism.llm import html_extraction as E

    trees = Trees()
    for k in range(50):
        parse(maker.page().replace(MARK, ""), trees, k)
    shape = E.Shape.of(trees)
    chance = model.trees.chance(E.features(trees, shape, model.token_odds, model.tag_odds))
    down = shape.handed_down(chance, np.multiply)
    inner = shape.depth > 0
    assert (down[inner] <= down[shape.parent[inner]] + 1e-12).all()


def test_odd_rows(spark, model):
    long = "<article>" + "<p>Word, and word.</p>" * 30_000 + "</article><footer>x</footer>"
    rows = [(1, None), (2, ""), (3, "  "), (4, "<article><p>A b.</p></article><nav><a href=x>n</a></nav>"), (4, "<article><p>A b.</p></article><nav><a href=x>n</a></nav>"), (None, long)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_text(pages, model).collect()]
    assert got == [(1, "", 2), (2, "", 2), (3, "", 2), (4, "A b.", 2), (4, "A b.", 2), (None, " ".join(["Word, and word."] * 30_000), 2)]
    assert extract_text(pages.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        extract_text(pages.drop("text").withColumnRenamed("html", "text"), model, "text")


def test_without_pages_the_layouts_teach(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    model = fit_pages(sample_pages(empty), layouts=200)
    assert main_texts(["<article><p>A b, c.</p></article><footer>z</footer>"], model) == ["A b, c."]
