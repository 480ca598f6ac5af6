import random
import re

from fathomline.llm.quality_rules import STOP_WORDS, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base)


def test_equals_brute_force(spark):
    r = random.Random(5)
    v = ["the", "of", "é#", "a|b", "日本", "x", "***", " ", "y."] + [f"w{i}" for i in range(8)]
    texts = [None, "", " \n\t ", "a", "a b\r\na b\na b", "# " * 50, "the of " * 4000]
    for _ in range(150):
        texts.append("".join(r.choice(v) + r.choice([" ", " ", "\n", "  ", "\t\x0b", "\r\n"]) for _ in range(r.randint(1, 90))))
        if r.random() < 0.3:
            texts[-1] += texts[-1][r.randint(0, 30) :]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {x.doc_id: x.quality for x in judge(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()}
    for i, t, _ in rows:
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(t), (i, t)
        assert q.kept == (not q.base_failed and not q.failed)


def test_rules(spark):
    clean = " ".join(f"{a} word{i} and thing{i}" for i, a in enumerate(STOP_WORDS[:20])) + "."
    rows = [(1, clean), (2, clean.replace(" ", "*** ")), (3, " ".join(f"qwrt{i}" for i in range(90))), (4, "\n".join([clean] + ["same line of the text"] * 9)), (5, "a b"), (1, clean)]
    got = [(x.doc_id, x.quality.failed, x.quality.kept) for x in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [k for _, _, k in got] == [True, False, False, False, False, True]
    assert "symbols" in got[1][1] and "stop_words" in got[2][1] and "duplicate_lines" in got[3][1] and "word_count" in got[4][1]
    assert judge(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0
