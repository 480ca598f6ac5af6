import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from fathomline.llm.packing import WordTokenizer, lengths, pack

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts(seed, n=200):
    r = random.Random(seed)
    a = list("abcABC  \n\t' \u0085\x1c　éÉ12½#.,İΣςß日本한́​") + ["<|endoftext|>", "'s", "it's ", "the ", "\r\n", "🙂", "ﬁ", "ẛ̣"]
    return ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_librarys():
    plain, ours = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    r = random.Random(5)
    ends = [".", "!!", "...", "###", "%%%", "&&&", "$$$", "|", ">", ")", "'s.", "'.", "\u0301.", "1.", "É.", "ñ,", "ÿ.", "ÿ", "Σ.", "İ!", "<|endoftext|>.", "<|endoftext|>", "µ.", "×.", "÷,", "ª.", "º,", "¿", "³.", "Ã.", "à."]
    texts = ["", " ", *odd_texts(3, 600)]
    texts += [" ".join(r.choice(["The", "é", "ÉA", "x", "", "Straße", "ΟΔΟΣ", "don't", "I'M", "a.b", "#a"]) + r.choice(ends) for _ in range(4)) for _ in range(3000)]
    for part in (texts, texts[:1], texts[7:9], []):
        ids, starts = ours.ids(pa.array(part, pa.string()))
        assert len(starts) == len(part) + 1
        for t, a, b in zip(part, starts, starts[1:], strict=False):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_lengths():
    for n in range(1, 300):
        x = lengths(n, 64)
        assert sum(x) == n and all(k & (k - 1) == 0 and k <= 64 for k in x) and sorted(x, reverse=True) == x and len(set(k for k in x if k < 64)) == sum(k < 64 for k in x)


def test_pieces(spark):
    texts = [None, "", *odd_texts(4, 60), "word " * 9001]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1), (None, "a b", "x", 1)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, bucket string, start int").repartition(3), with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    wanted = {}
    for i, t, _, _ in rows:
        wanted.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    assert len({p.sequence_id for p in got}) == len(got)
    docs = {}
    for p in got:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert p.length == len(ids) == 1 << p.bucket and p.length <= 4096 and p.offset == 0 and p.ids_crc32 == zlib.crc32(bytes(p.ids))
        docs.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    assert set(docs) == set(wanted)
    for i, pieces in docs.items():
        if len(wanted[i]) > 1:  # repeated rows have pieces each
            each = Counter()
            for ids in wanted[i]:
                at = 0
                for n in lengths(len(ids), 4096):
                    each[at, tuple(ids[at : at + n]), len(ids)] += 1
                    at += n
            assert Counter((a, tuple(x), n) for a, x, n in pieces) == each
        else:
            pieces.sort()
            assert sum((x for _, x, _ in pieces), []) == wanted[i][0]
            assert [s for s, _, _ in pieces] == [sum(len(x) for _, x, _ in pieces[:k]) for k in range(len(pieces))]
            assert all(n == len(wanted[i][0]) for _, _, n in pieces)
    assert pack(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0
