import hashlib
import random
import re

import pytest

from fathomline.llm import words as W
from fathomline.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for a in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[a : a + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["é", "the", "of", "x1", "日本", "word", "a.b", "Z"] + [f"v{i}" for i in range(60)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(5, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages)[r.randint(0, 3) :] if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
        rows.append((r.randint(0, n) if r.random() < 0.1 else i, "".join(x + r.choice([" ", "  ", "\n", "\t", "  ", "\r\n"]) for x in w)))
    same = rows[3]
    return rows + [same, (None, rows[5][1]), (7, None), (8, ""), (9, " \n ")]


@pytest.mark.parametrize("seed,window,inner", [(1, 8, 3), (2, 12, 5), (3, 4, 4), (4, 50, 16)])
def test_equals_brute_force(spark, seed, window, inner):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs, window=window, inner=inner).select("doc_id", "dedup.*").collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows, window)
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r.kept or "")).encode()).hexdigest() == r.kept_sha256
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


def test_long_texts_come_in_blocks(spark, monkeypatch):
    rows = made(9, 30) + [(1000, made(9, 30)[2][1] * 40), (1001, "x" * 500 + " " + made(9, 30)[2][1] * 40)]
    import pyarrow as pa

    column = pa.array([t for _, t in rows])
    for block in (64, 300, 1 << 20):
        seen = {}
        for row, at, h in W.blocks(column, carry=3, block=block):
            for a, b, c in zip(row.tolist(), at.tolist(), h.tolist()):
                assert seen.setdefault((a, b), c) == c
        assert len(seen) == sum(len(WORD.findall(t or "")) for _, t in rows)
        if block == 64:
            reference = seen
        assert seen == reference


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "k"), (2, "a b c", 6, None)], "doc_id long, text string, anchor int, parts string")
    got = {r.doc_id: r for r in remove_repeats(docs, window=3, inner=2).collect()}
    assert got[1].dedup.n_removed == 0 and got[2].dedup.n_removed == 3 and got[2].anchor == 6 and got[2].dedup.kept == ""
    assert remove_repeats(docs.limit(0), window=3, inner=2).count() == 0


def test_whole_texts_over_block_borders(spark):
    """Texts of over a block, parts of which repeat across its borders, and many copies of one row."""
    r = random.Random(12)
    long = [f"w{r.randrange(10**6)}" for _ in range(220_000)]
    assert len(" ".join(long)) > W.BLOCK
    middle = [f"z{r.randrange(10**6)}" for _ in range(300)]
    rows = [(5, " ".join(long)), (9, " ".join(middle + long[100_000:190_000] + middle)), (2, " ".join(long[130_000:130_060]))]
    rows += [(11, " ".join(middle[10:200]))] * 200
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=50).collect()
    assert sorted([(g.doc_id, g.dedup.n_words, g.dedup.n_removed, g.dedup.kept_sha256) for g in got], key=str) == brute(rows, 50)
