import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from fathomline.llm.sentencepiece_codec import Codec, encode_decode

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(seed, n=400):
    r = random.Random(seed)
    a = list("abcAB   \n\n\t éÉ12#.,日本▁　́\x01") + ["the ", "\r\n", "🙂", "ﬁ", "<s>", "</s>", "<0x0A>", " \n ", "<unk>"]
    return ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_equals_the_library():
    plain, ours = sentencepiece.SentencePieceProcessor(model_file=PATH), Codec(PATH, cache=20_000)
    assert ours.by_chunk
    for t in ["", " ", "  ", "\n", " \n", "▁", "a ", " a", *odd_texts(1, 1500)]:
        assert ours.encode(t) == plain.encode(t, add_bos=True, add_eos=True), repr(t)


def test_rows(spark):
    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", *odd_texts(2, 60), "long words " * 5000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x"), (3, texts[3], "x")]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3), with_ids=True).collect()
    assert len(got) == len(rows)
    for g in got:
        t = "a b" if g.doc_id is None else texts[g.doc_id] or ""
        ids = plain.encode(t, add_bos=True, add_eos=True)
        assert list(g.ids) == ids and g.n_tokens == len(ids) and g.decoded == plain.decode(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and g.decoded_sha256 == hashlib.sha256(plain.decode(ids).encode()).hexdigest()
    assert encode_decode(spark.createDataFrame(rows[:0], "doc_id long, text string, ids string")).count() == 0
