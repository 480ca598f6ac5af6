import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from fathomline.llm import dartminhash as D
from fathomline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    lo, hi = sum((a & b).values()), sum((a | b).values())
    return lo / hi if hi else 0


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and similarity(sets[i], sets[j]) >= 0.8:
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {g: min((rows[i][0] for i in m), key=lambda x: (x is not None, x)) for g, m in groups.items()}
    return sorted(((rows[i][0], least[root(i)]) for i in range(len(rows))), key=str)


def made(seed, n=200):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(400)]
    bases = [[r.choice(v) for _ in range(r.choice([3, 5, 6, 30, 80, 200]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else [r.choice(v) for _ in range(r.randint(1, 90))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(v)
        if r.random() < 0.1:
            w += w
        rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = made(1) + [(500, ""), (501, None), (502, " \n"), (3, made(1)[3][1]), (7, "the same id but another text"), (600, "one two"), (601, "one  two")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node int").repartition(3)
    got = D.classes(docs).collect()
    assert sorted(((g.doc, g.class_id) for g in got), key=str) == brute(rows)
    assert {(g.class_id, g.class_key) for g in got} == {(g.doc, g.key) for g in got if g.kept}
    assert D.classes(docs.limit(0)).count() == 0


def test_hub_that_is_no_link_loses_none(spark):
    """A chain whose hubs are far from most members: the prefix join finds the rest."""
    r = random.Random(4)
    w = [f"x{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(w)))
        w[(i * 7) % 120] = f"y{i}"
        w[(i * 7 + 3) % 120] = f"z{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.classes(docs)
    assert sorted(((g.doc, g.class_id) for g in got.collect()), key=str) == brute(rows)


def test_cloud_of_copies(spark):
    """Copies at all distances from one text, few of them near to each other."""
    r = random.Random(14)
    base = [f"x{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = f"y{r.randrange(4) if r.random() < 0.5 else i}"
        rows.append((i, " ".join(w)))
    got = D.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((g.doc, g.class_id) for g in got.collect()), key=str) == brute(rows)


def test_texts_of_common_blocks(spark, monkeypatch):
    """Texts of 5 of 14 blocks meet in many buckets, and few are similar: pairs don't grow with their square."""
    pairs = {}
    own = D._prefix_pairs

    def counted(rest, similarity):
        out = own(rest, similarity)
        pairs[n] = out.count()
        return out

    monkeypatch.setattr(D, "_prefix_pairs", counted)
    blocks = [" ".join(f"w{b}_{i}" for i in range(24)) for b in range(14)]
    for n in (250, 1000):
        r = random.Random(1)
        rows = [(i, " ".join(r.sample(blocks, 5))) for i in range(n)]
        got = D.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        if n == 250:
            assert sorted(((g.doc, g.class_id) for g in got), key=str) == brute(rows)
    assert all(found <= n for n, found in pairs.items()), pairs


def test_sketches_never_overstate():
    """Sketches differ in no more bits than the texts differ in elements, and in as many where few do."""
    g = np.random.default_rng(5)
    for n, gone, new in ((1, 0, 0), (5, 1, 1), (116, 10, 16), (116, 40, 40), (3000, 300, 30)):
        a = g.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate((a[gone:], g.integers(0, 1 << 63, new, dtype=np.uint64)))
        one, two = (D.sketches(x, np.array([0])) for x in (a, b))
        differ = sum(int(x[0] ^ y[0]).bit_count() for x, y in zip(one, two, strict=True))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist())) and (gone + new > 50 or differ >= (gone + new) * 0.7 - 1)
    both = D.sketches(np.concatenate((a, b)), np.array([0, len(a)]))
    assert [int(x[0]) for x in both] == [int(x[0]) for x in one] and [int(x[1]) for x in both] == [int(x[0]) for x in two]


def test_texts_longer_than_a_block(spark):
    """Near copies of over a megabyte, which are hashed in several pieces, are one class; half a copy isn't."""
    r = random.Random(9)
    w = [f"word{r.randrange(10**5)}" for _ in range(150_000)]
    near = list(w)
    for _ in range(3000):
        near[r.randrange(len(near))] = "changed"
    rows = [(5, " ".join(w)), (6, " ".join(near)), (7, " ".join(w[: len(w) // 2])), (8, "\n".join(w)), (9, "short text")]
    assert len(rows[0][1]) > D.W.BLOCK
    got = {g.doc: g.class_id for g in D.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 7, 8: 5, 9: 9}


def test_agreement_is_the_weighted_similarity():
    r = random.Random(6)
    w = [f"a{i}" for i in range(300)]
    x = [r.choice(w) for _ in range(250)] + ["q"] * 60
    y = list(x)
    for _ in range(10):
        y[r.randrange(250)] = "other"
    y += ["q"] * 30
    rows, hashes = next(D.whole_texts(pa.array([" ".join(x), " ".join(y)])))
    _, owner, element, _ = D.elements(rows, hashes, 5)
    s = D.signatures(owner, element, 2, 4096)
    assert abs(np.mean(s[0] == s[1]) - similarity(shingles(" ".join(x)), shingles(" ".join(y)))) < 0.03


def test_white_space_that_fills_a_piece():
    blank = " " * (3 * D.W.BLOCK)
    texts = ["a b", f"{blank}c d e{blank}f g{blank}", blank, None, "h", f"i{blank}j"]
    parts = [np.unique(rows).tolist() for rows, _ in D.whole_texts(pa.array(texts))]
    assert sorted(sum(parts, [])) == [0, 1, 4, 5]
    counts = Counter(r for rows, _ in D.whole_texts(pa.array(texts)) for r in rows.tolist())
    assert counts == {0: 2, 1: 5, 4: 1, 5: 2}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[n] == min(seen)
    assert set(got) == set(near)
