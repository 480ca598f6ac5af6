import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import html_extract as H
from fathomline.llm.html_tree import Tree, blocks_of
from tests.llm import page_shapes


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_held_out_accuracy(model):
    r = random.Random(12345)
    pages = [H.labelled_page(r) for _ in range(200)]
    forest, y = H.forest_and_labels(pages)
    content, _ = forest.marginals(np.array(model[0]), np.array(model[1]).reshape(2, 2))
    assert ((content > 0.5) == (y > 0.5)).mean() > 0.97


def enumerated(forest, weights, edge):
    """P(content) of each node, by the sum over all assignments."""
    n = forest.n
    y = np.array(list(itertools.product((0, 1), repeat=n)))
    own = forest.scores(weights)
    score = sum(own[v, y[:, v]] for v in range(n)) + sum(edge[y[:, forest.parent[v]], y[:, v]] for v in range(n) if forest.parent[v] >= 0)
    p = np.exp(score - score.max())
    return (p[:, None] * y).sum(0) / p.sum()


def random_page(r, depth=0):
    tags = ["p", "div", "li", "ul", "section", "nav", "b", "i", 'div class="ad"', 'span class="post"']
    out = []
    for _ in range(r.randint(1, 3)):
        tag = r.choice(tags)
        inner = random_page(r, depth + 1) if depth < 2 and r.random() < 0.5 else r.choice(["x y.", "a  b &amp; c", "", "Long, long text\nof it!", "z"])
        out.append(f"<{tag}>{inner}</{tag.split()[0]}>" if r.random() < 0.9 else inner + "<br>")
    return "".join(out)


def test_texts_equal_enumeration(model):
    """Marginals of many small random pages by enumeration, then the rule for blocks said anew."""
    r, g = random.Random(1), np.random.default_rng(3)
    seen = 0
    for i in range(400):
        page = random_page(r)
        tree = Tree(page)
        forest = H.Forest([tree])
        if forest.n > 13:
            continue
        seen += 1
        weights, edge = (np.array(model[0]), np.array(model[1]).reshape(2, 2)) if i % 2 else (g.normal(size=len(H.INDEX)), g.normal(size=(2, 2)))
        p = enumerated(forest, weights, edge)
        assert np.allclose(forest.marginals(weights, edge)[0], p)
        blocks = [re.sub(r"\s+", " ", "".join(t for _, v, _, t in runs if p[v] > 0.5)).strip() for _, runs in itertools.groupby(tree.runs, key=lambda x: x[0])]
        assert H.Extractor((tuple(weights), tuple(edge.ravel()))).texts([page]) == ["\n".join(b for b in blocks if b)]
    assert seen > 200


def test_other_pages(model):
    """Words of the article and of the outcome, on pages that the training generator didn't shape."""
    made = list(page_shapes.pages(350, 5))
    shared = got_words = article_words = 0
    for (_, _, article), got in zip(made, H.Extractor(model).texts([h for _, h, _ in made]), strict=True):
        a, b = Counter(got.split()), Counter(article.split())
        shared, got_words, article_words = shared + (a & b).total(), got_words + a.total(), article_words + b.total()
    assert shared / got_words > 0.99 and shared / article_words > 0.99


STORY = "The council met on Monday, and voted to keep the library open. Residents cheered."


def test_articles_of_one_block(model):
    shapes = ("{}", "<p>{}</p>", "<div>{}</div>", "<html><body>{}</body></html>", "<html><body><p>{}</p></body></html>", "<html><body><div>{}</div></body></html>", "<html><body><article>{}</article></body></html>")
    assert H.Extractor(model).texts([s.format(STORY) for s in shapes]) == [STORY] * len(shapes)
    others = ('<div class="cookie-notice">{}</div>', "<footer>{}</footer>", '<html><body><nav><a href="/">Home</a></nav><footer>&copy; 2024</footer></body></html>')
    assert H.Extractor(model).texts([s.format(STORY) for s in others]) == [""] * len(others)


def test_a_mark_anywhere_in_a_long_text(model):
    """All of a node's text is looked at: where in it the first mark stands changes nothing."""
    words = [f"word{i}" for i in range(2000)]
    for shape in ("<article><p>{}</p></article>", "<html><body><p>{}</p></body></html>", "<html><body><nav><a>Home</a></nav><div>{}</div></body></html>"):
        features = []
        for at in (1, 50, 100, 1500):
            text = " ".join([*words[:at], words[at] + ",", *words[at + 1 :]])
            features.append(H.features(Tree(shape.format(text))))
            assert H.Extractor(model).texts([shape.format(text)]) == [text]
        assert all(f == features[0] for f in features)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>Caf&eacute; &amp; more&nbsp;here</h1><p>First <b>bold</b>
  line, with a<a href="#">link</a>.<p>Second paragraph without end<br>new line.
<div class="ad">Buy now.</div><ul><li>One item.<li>Two items.</ul><p>A &lt;tag&gt; &#233; &am x.</p>
<section class="comments"><h3>Comments</h3><p>Nice article, thank you.</p></section></article>
<aside><h3>Related</h3><p>More to read.</p></aside><form><label>Mail</label><input><p>Subscribe to it.</p></form>
<footer>&copy; 2024 Someone</footer>"""


def test_parts_of_a_page(model):
    got = H.Extractor(model).texts([PAGE, "", "<p>"])
    assert got[0] == "Café & more here\nFirst bold line, with alink.\nSecond paragraph without end new line.\nOne item.\nTwo items.\nA <tag> é &am x."
    assert got[1:] == ["", ""]


def test_broken_markup_and_depth():
    deep = "<div>" * 5000 + "x" + "</div>" * 10
    assert blocks_of(Tree(deep).runs, [True] * 10000) == "x"
    assert blocks_of(Tree("a<p>b<p><b>c<td>d</x>e < f &lt").runs, [True] * 99) == "a\nb\nc\nde < f <"
    assert blocks_of(Tree("<svg/><p>t</p><script/>x</script><p>u").runs, [True] * 99) == "t\nu"


def test_parts_below_many_open_elements(model):
    parts = '<article><p>The long story of the hills, told in full by those who were there.</p></article><footer class="footer">&copy; All of us</footer>'
    story = "The long story of the hills, told in full by those who were there."
    for opened in ("<b>" * 500, "<div>" * 500, "<div>" * 5000, "<b>" * 5000):
        tree = Tree(opened + parts)
        assert len({node for _, node, _, data in tree.runs if data.strip()}) == 2
        assert H.Extractor(model).texts([opened + parts]) == [story]
    menu = '<nav><ul><li><a href="/">Home</a></li></ul></nav>'
    assert H.Extractor(model).texts(["<div>" * 5000 + menu + parts + "</div>" * 5000]) == [story]


def test_rows(spark, model):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", PAGE, "x"), (None, "u", "<article><p>Long text of it. " + "word " * 50000, "x")]
    got = sorted(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect(), key=lambda g: str(g.page_id))
    assert [(g.page_id, g.n_chars == len(g.text)) for g in got] == [(1, True), (1, True), (2, True), (3, True), (None, True)]
    assert got[0].text == got[1].text and got[2].text == got[3].text == "" and got[4].text.count("word") == 50000
    assert H.extract(spark.createDataFrame(rows[:0], "page_id long, url string, html string")).count() == 0
