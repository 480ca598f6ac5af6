"""Main-text extraction with a tree-structured graphical model over the DOM.

Each element of a page is a binary variable: does its own text belong to the article? A node has a
potential from its features (name, words in class, id and role, length, links, punctuation), and
each parent-child edge a 2 x 2 potential. Sum-product message passing, once up and once down the
tree, gives exact marginals; text of nodes with a marginal of over one half is kept.

The potentials are trained here, by gradient ascent on the likelihood of labelled pages, whose
gradient needs just these marginals. The labelled pages come from a generator of page layouts (a
documented, bounded sample: ``PAGES`` pages from a fixed seed); training takes seconds on the
driver and the weights are a few hundred numbers. Pages are then read in one narrow pass.

Defined cases: null or empty html has the empty text; broken markup is read as browsers do in the
common cases; a page without any article has the empty text; repeated rows give equal results;
pages are read whole, however long; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.html_tree import BLOCKS, Tree, blocks_of

#: Labelled pages that the model is trained on, and the share of those that are an article alone.
PAGES, BARE = 800, 0.12
#: A labelled page that begins so is an article where no element says otherwise.
MAIN = "<!--main-->"
# Words of class, id and role that tell parts of a page, by part.
LEXICON = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pagination pager sitemap skip toolbar",
    "head": "header masthead banner logo topbar branding hero",
    "foot": "footer foot bottom colophon copyright contentinfo legal imprint",
    "side": "sidebar side aside complementary widget rail related recommended recommendations more popular trending tags categories archive",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog toast announcement warning disclaimer",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner-ad dfp",
    "form": "form search login signin signup register subscribe newsletter subscription contact poll",
    "reader": "comment comments reply replies respond discussion disqus feedback reactions review reviews responses",
    "share": "share sharing social follow likes tools print meta byline author",
    "article": "article content post entry story body text main maincontent page-content blog document prose",
}
_PART = {word: part for part, words in LEXICON.items() for word in words.split()}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Elements that say what all within them is.
_REGIONS = ("article", "aside", "footer", "form", "header", "main", "nav")
_TAGS = sorted(BLOCKS) + ["#page", "a", "span", "other"]
_NAMES = ["bias"] + [f"tag {t}" for t in _TAGS] + [f"{kind} {part}" for kind in ("named", "role", "within") for part in LEXICON] + [f"within <{t}>" for t in _REGIONS] + [f"words {i}" for i in range(8)] + [f"links {i}" for i in range(4)] + [f"{kind} {t}" for kind in ("owns", "plain") for t in _TAGS] + [f"part {i}" for i in range(5)] + ["stops", "ends"]
INDEX = {n: i for i, n in enumerate(_NAMES)}


def _parts(value: str) -> set[str]:
    return {_PART[w] for w in _SPLIT.split(_CAMEL.sub(" ", value).lower()) if w in _PART}


def features(tree: Tree) -> list[list[int]]:
    """The active features of each node."""
    n = len(tree.tag)
    words, linked, stops, ends = [0] * n, [0] * n, [False] * n, [False] * n
    for _, node, link, data in tree.runs:
        k = len(data.split())
        if k:  # the whole text counts, however long
            words[node] += k
            linked[node] += k if link else 0
            stops[node] = stops[node] or any(c in data for c in ".!?,;")
            ends[node] = data.rstrip()[-1] in ".!?"
    under, under_linked = words[:], linked[:]
    for v in range(n - 1, 0, -1):
        under[tree.parent[v]] += under[v]
        under_linked[tree.parent[v]] += under_linked[v]
    out = []
    within: list[frozenset[int]] = []  # what the elements around a node are
    for v in range(n):
        tag, attrs = tree.tag[v], tree.attrs[v]
        around = within[tree.parent[v]] if v else frozenset()
        own = [INDEX["bias"], INDEX.get(f"tag {tag}", INDEX["tag other"]), *around]
        named = _parts(attrs.get("class", "") + " " + attrs.get("id", ""))
        role = _parts(attrs.get("role", ""))
        own += [INDEX[f"named {p}"] for p in named] + [INDEX[f"role {p}"] for p in role]
        here = [INDEX[f"within {p}"] for p in named | role] + ([INDEX[f"within <{tag}>"]] if tag in _REGIONS else [])
        within.append(around.union(here) if here else around)
        own.append(INDEX[f"words {min(7, under[v].bit_length())}"])
        share = under_linked[v] / under[v] if under[v] else 0
        own.append(INDEX[f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}"])
        if stops[v]:
            own.append(INDEX["stops"])
        if ends[v]:
            own.append(INDEX["ends"])
        if words[v]:
            own.append(INDEX.get(f"owns {tag}", INDEX["owns other"]))
            if not (around or named or role):  # nothing above says what this is
                own.append(INDEX.get(f"plain {tag}", INDEX["plain other"]))
            part = words[v] / under[0]  # of the page's words
            own.append(INDEX[f"part {0 if part < 0.1 else 1 if part < 0.4 else 2 if part < 0.8 else 3 if part < 1 else 4}"])
        out.append(own)
    return out


class Forest:
    """The pages of a batch as one forest, in arrays, by depth."""

    def __init__(self, trees: list[Tree]):
        parents, active, counts, depth = [], [], [], []
        self.begin = [0]
        for t in trees:
            base = self.begin[-1]
            d = [0] * len(t.tag)
            for v, p in enumerate(t.parent):
                parents.append(p + base if p >= 0 else -1)
                d[v] = d[p] + 1 if p >= 0 else 0
            depth += d
            for f in features(t):
                active += f
                counts.append(len(f))
            self.begin.append(base + len(t.tag))
        self.parent, self.active = np.array(parents), np.array(active)
        self.node = np.repeat(np.arange(len(counts)), counts)
        self.n = len(counts)
        depth = np.array(depth)
        by_depth = np.argsort(depth, kind="stable")
        self.levels = np.split(by_depth, np.cumsum(np.bincount(depth)))[1:-1] if self.n else []
        self.above = [np.unique(self.parent[x], return_inverse=True) for x in self.levels]  # parents, and each node's place among them
        self.children = np.flatnonzero(self.parent >= 0)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.node, weights[self.active], minlength=self.n)
        return own

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint of (parent, child) of each child."""
        own = self.scores(weights)
        up = own.copy()  # own potential and all messages from below
        message = np.zeros((self.n, 2))  # from a child to its parent
        for level, (above, place) in zip(reversed(self.levels), reversed(self.above), strict=True):
            message[level] = np.logaddexp(edge[None, :, 0] + up[level, 0][:, None], edge[None, :, 1] + up[level, 1][:, None])
            for y in (0, 1):
                up[above, y] += np.bincount(place, message[level, y])
        belief = up.copy()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels:
            outside = belief[self.parent[level]] - message[level]  # the parent without this child
            both = outside[:, :, None] + edge[None] + up[level][:, None, :]
            down = np.logaddexp(both[:, 0] - up[level], both[:, 1] - up[level])
            belief[level] = up[level] + down
            joint[level] = np.exp(both - np.logaddexp.reduce(both.reshape(len(level), 4), axis=1)[:, None, None])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


# Plain words that labelled pages are worded with, beside made-up ones.
PLAIN = "a the of and to in that it is was for on are as with his they at be this from or had by but some what there we can out other were all your when up use how each she many then them these so her would make like him into time has look two more write go see no way could my than been call who oil now find long down day did get come made may part".split()
_VOWELS, _OTHERS = "aeiou\u00e4\u00e9\u00f3", "bcdfghjklmnprstvwz"


def _word(r: random.Random) -> str:
    if r.random() < 0.5:
        return r.choice(PLAIN)
    return "".join(r.choice(_OTHERS) + r.choice(_VOWELS) + r.choice(("", "", "n", "r", "s")) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, least: int, most: int) -> str:
    w = [_word(r) for _ in range(r.randint(least, most))]
    if r.random() < 0.15:  # wordings of all kinds: commas, repeats, marks, capitals
        w = [x + r.choice(("", ",", ".", "!!", "***")) for x in w]
    elif r.random() < 0.05:
        w = [x for x in w for _ in range(5)]
    text = " ".join(w)
    return (text.upper() if r.random() < 0.03 else text.capitalize()) + r.choice(("", "", ".", ".", ".", "!", "?", ":", ","))


def _bare_page(r: random.Random) -> str:
    """An article with nothing about it: plain text, or one block or a few."""
    text = lambda: " ".join(_sentence(r, 1, 24) for _ in range(r.choice((1, 2, 2, 3, 5, 9))))
    kind = r.random()
    if kind < 0.25:
        return MAIN + "\n".join(text() for _ in range(r.choice((1, 1, 2, 4))))
    tag = r.choice(("p", "p", "div", "div", "section", "article", "main", "blockquote", "pre"))
    inner = "".join(f'<{tag} data-main="1">{text()}</{tag}>' for _ in range(r.choice((1, 1, 1, 2, 3))))
    if kind < 0.35:
        inner = text()
    elif kind < 0.5:
        inner = f'<div data-main="1">{inner}</div>'
    if r.random() < 0.3:
        inner = f'<h{r.choice("123")} data-main="1">{_sentence(r, 1, 9)}</h1>' + inner
    if r.random() < 0.3:
        return MAIN + inner
    return f'<html data-main="0"><body data-main="1">{inner}</body></html>'


def labelled_page(r: random.Random) -> str:
    """A page whose elements say in ``data-main`` whether their text belongs to the article."""
    s = lambda a, b: _sentence(r, a, b)
    pick = r.choice
    if r.random() < BARE:
        return _bare_page(r)

    def links(n: int) -> str:
        return "".join(f'<li data-main="0"><a href="/x{i}">{s(1, 4)}</a></li>' for i in range(n))

    def off(tag: str, name: str, inner: str) -> str:
        inner = re.sub(r"<(p|li|ul|div|h[1-6]|form|section|article|blockquote|label)(?=[ >])(?! data-main)", r'<\1 data-main="0"', inner)
        return f'<{tag} {name} data-main="0">{inner}</{tag}>'

    def named(tags: str, part: str, inner: str) -> str:
        tag, words = pick(tags.split()), LEXICON[part].split()
        attr = pick(['class="{}"', 'id="{}"', 'class="site-{}"', 'class="{} box"', 'id="{}-1"']).format(pick(words))
        plain = {"nav": 1, "header": 1, "footer": 1, "aside": 1, "form": 1}.get(tag)
        return off(tag, "" if plain and r.random() < 0.5 else attr, inner)

    title = lambda: "<h{0}>{1}</h{0}>".format(pick("22334"), s(1, 4))
    menu = lambda: named("nav nav div ul", "menu", pick([f"<ul>{links(r.randint(2, 9))}</ul>", links(r.randint(2, 6)), "".join(f'<a href="#">{s(1, 2)}</a> ' for _ in range(5))]))
    head = lambda: named("header header div", "head", f"<h1>{s(1, 4)}</h1>" * r.randint(0, 1) + f"<p>{s(2, 9)}</p>" + menu() * r.randint(0, 1))
    foot = lambda: named("footer footer div", "foot", pick([f"&copy; {s(1, 9)} &middot; {s(3, 14)}", f"<p>{s(3, 20)}</p>", f"<ul>{links(4)}</ul><p>{s(2, 9)}</p>"]))
    side = lambda: named("aside aside div section", "side", title() + pick([f"<ul>{links(r.randint(2, 7))}</ul>", f"<p>{s(5, 30)}</p>", f'<div>{s(4, 12)}</div><div><a href="#">{s(2, 6)}</a></div>']))
    notice = lambda: named("div div section p", "notice", pick([s(4, 25), f"<p>{s(4, 30)}</p>", f"<p>{s(4, 20)}</p><button>{s(1, 2)}</button>"]) if r.random() < 0.9 else s(3, 9))
    advert = lambda: named("div div aside section p", "advert", pick([s(3, 14), f"<p>{s(3, 18)}</p>", f'<a href="#">{s(3, 9)}</a>', title() + f"<p>{s(4, 20)}</p>"]))
    form = lambda: named("form form div", "form", title() * r.randint(0, 1) + f"<label>{s(1, 3)}</label><input><p>{s(2, 9)}</p><button>{s(1, 2)}</button>")
    reader = lambda: named("section div div ol", "reader", title() * r.randint(0, 1) + "".join(off(pick(["div", "div", "li", "li", "article"]), pick(['class="comment"', 'class="reply"', ""]), f"<p>{s(4, 40)}</p>" + f"<p>{s(4, 20)}</p>" * r.randint(0, 1)) for _ in range(r.randint(1, 5))))
    share = lambda: named("div ul div", "share", pick([links(3), s(1, 4)]))
    kinds = [menu, head, side, notice, advert, form, share]

    def content() -> str:
        out = [f'<h1 data-main="1">{s(2, 10)}</h1>'] * (r.random() < 0.7)
        for _ in range(pick((1, 1, 2, 3, 4, 6, 9, 14))):
            x = r.random()
            if x < 0.62:
                many = r.choice((1, 1, 2, 4, 8))
                out.append(f'<p data-main="1">{" ".join(s(1 if many == 1 else 3, 24) for _ in range(many))}</p>')
            elif x < 0.70:
                out.append('<h{0} data-main="1">{1}</h{0}>'.format(pick("223344"), s(1, 6)))
            elif x < 0.77:
                out.append('<ul data-main="1">' + "".join(f'<li data-main="1">{s(1, 14)}</li>' for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.82:
                out.append(f'<blockquote data-main="1"><p data-main="1">{s(4, 30)}</p></blockquote>')
            elif x < 0.85:
                out.append('<table data-main="1"><tr data-main="1">' + f'<td data-main="1">{s(1, 3)}</td>' * 3 + "</tr></table>")
            elif x < 0.88:
                out.append(f'<pre data-main="1">{s(3, 20)}</pre>')
            elif x < 0.91:
                out.append(f'<p data-main="1">{s(2, 9)} <a href="#">{s(1, 4)}</a> {s(2, 12)}</p>')
            elif x < 0.94:
                out.append(f'<div data-main="1">{s(3, 40)}</div>')
            else:
                out.append(pick([advert, share, notice, side])())
        return "".join(out)

    shape = r.random()
    inner = content()
    if shape < 0.36:
        body = f'<article data-main="1">{inner}{reader() * (r.random() < 0.2)}</article>'
    elif shape < 0.46:
        body = f'<main data-main="1">{inner}</main>'
    elif shape < 0.62:
        body = pick(['<div class="{}" data-main="1">{}</div>', '<div id="{}" data-main="1">{}</div>', '<section class="{}" data-main="1">{}</section>']).format(pick(LEXICON["article"].split()), inner)
    elif shape < 0.78:
        body = f'<div data-main="1">{inner}</div>'
    else:
        body = ""
    if body and r.random() < 0.3:
        body = f'<div class="{pick(["wrapper", "container", "row", "page"])}" data-main="0">{body}{side() * (r.random() < 0.5)}</div>'
    before = [k() for k in r.sample(kinds, r.randint(0, 4))]
    after = [k() for k in (reader, side, form, advert, notice) if r.random() < 0.3] + [foot()] * (r.random() < 0.9)
    main = 0 if body else int(r.random() < 0.9)
    page = "".join(before) + (body or inner * main) + "".join(after)
    if body and r.random() < 0.2:  # a fragment
        return page
    return f'<html data-main="0"><body data-main="{main}">{page}</body></html>'


@lru_cache(maxsize=4)
def trained(pages: int = PAGES, seed: int = 11, steps: int = 300) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Weights of the features and the edge potentials (parent 0 with child 0, 1, then parent 1)."""
    r = random.Random(seed)
    forest, y = forest_and_labels([labelled_page(r) for _ in range(pages)])
    weights, edge = np.zeros(len(INDEX)), np.zeros((2, 2))
    seen = np.bincount(forest.active, y[forest.node], minlength=len(INDEX))
    c, p = forest.children, forest.parent[forest.children]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[p].astype(int), y[c].astype(int)), 1)
    m, v = np.zeros(len(INDEX) + 4), np.zeros(len(INDEX) + 4)
    for step in range(1, steps + 1):
        content, joint = forest.marginals(weights, edge)
        slope = np.concatenate((seen - np.bincount(forest.active, content[forest.node], minlength=len(INDEX)) - 0.1 * weights, (pairs - joint[c].sum(0) - 0.1 * edge).ravel()))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weights, edge = weights + move[: len(INDEX)], edge + move[len(INDEX) :].reshape(2, 2)
    return tuple(weights.tolist()), tuple(edge.ravel().tolist())


def forest_and_labels(pages: list[str]) -> tuple[Forest, np.ndarray]:
    trees = [Tree(p) for p in pages]
    y = []
    for page, t in zip(pages, trees, strict=True):
        for v in range(len(t.tag)):
            own = t.attrs[v].get("data-main")
            y.append(float(own) if own is not None else (y[len(y) - v + t.parent[v]] if v else float(page.startswith(MAIN))))
    return Forest(trees), np.array(y)


class Extractor:
    def __init__(self, model: tuple[tuple[float, ...], tuple[float, ...]]):
        self.weights, self.edge = np.array(model[0]), np.array(model[1]).reshape(2, 2)

    def texts(self, pages: list[str]) -> list[str]:
        if not pages:
            return []
        trees = [Tree(p) for p in pages]
        forest = Forest(trees)
        content, _ = forest.marginals(self.weights, self.edge)
        return [blocks_of(t.runs, content[a:b] > 0.5) for t, a, b in zip(trees, forest.begin, forest.begin[1:], strict=False)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: tuple | None = None, batch_chars: int = 1_000_000) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:  # bounded groups of pages, whole pages each
                group, size, hi = [], 0, lo
                while hi < batch.num_rows and (hi == lo or size < batch_chars) and hi - lo < 256:
                    group.append(batch.column(2)[hi].as_py() or "")
                    size += len(group[-1])
                    hi += 1
                texts = extractor.texts(group)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                lo = hi

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
