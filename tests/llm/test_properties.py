"""Properties over generated inputs, without Spark."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import media, packing, substring_dedup, warc, words
from fathomline.llm.html_tree import Tree, blocks_of
from fathomline.llm.sentencepiece_codec import Codec

TEXT = st.text(st.characters(codec="utf-8"), max_size=80)
SPACED = st.lists(st.sampled_from(["a", "Bc", "é", "日本", ".", "!!", " ", "\n", "\t", "  ", "'s", "12"]), max_size=40).map("".join)

WORD_PATH, PIECE_PATH = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
PLAIN, OURS = Tokenizer.from_file(WORD_PATH), packing.WordTokenizer(WORD_PATH)
LIBRARY, CODEC = sentencepiece.SentencePieceProcessor(model_file=PIECE_PATH), Codec(PIECE_PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | SPACED, max_size=6))
def test_word_ids(texts):
    ids, starts = OURS.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXT | SPACED)
def test_piece_ids(text):
    assert CODEC.encode(text) == LIBRARY.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_images(text):
    payload = media.padded(text.encode())
    assert media.decode(media.encode(payload)) == payload and payload.rstrip(b"\xff") == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), TEXT), max_size=30))
def test_bundles(records):
    writer, made = warc.BundleWriter(), []
    for i, text in records:
        data = warc.record(i, None, text.encode(), warc.base32_sha1(text.encode()), None, "1970-01-01T00:00:00Z")
        made.append(data)
        writer.add(f"r{i}", data)
    bundle = writer.finish()
    for entry, data in zip(writer.index, made, strict=True):
        head, block = warc.read_record(bundle, entry["frame"], entry["offset"], entry["length"])
        assert data.endswith(block + b"\r\n\r\n") and head["X-Page-Id"] == data.split(b"X-Page-Id: ")[1].split(b"\r\n")[0].decode()


@settings(max_examples=300, deadline=None)
@given(st.lists(SPACED, max_size=8), st.integers(1, 40))
def test_word_hashes_do_not_depend_on_blocks(texts, block):
    seen = {}
    for size in (block, 1 << 20):
        got = {}
        for row, at, h in words.blocks(pa.array(texts, pa.string()), carry=2, block=size):
            got.update(zip(zip(row.tolist(), at.tolist(), strict=True), h.tolist(), strict=True))
        assert seen in ({}, got)
        seen = got
    assert len(seen) == sum(len(t.encode().split()) for t in texts)
    by_word = {}
    for (row, at), h in seen.items():
        word = texts[row].encode().split()[at]
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


@given(SPACED, st.lists(st.tuples(st.integers(0, 30), st.integers(1, 5)), max_size=4))
def test_cut_takes_whole_words(text, spans):
    all_words = text.encode().split()
    parts = [{"first": a, "n": 1, "hits": None} for a, _ in spans if a + 3 <= len(all_words)]
    gone = substring_dedup.merged(parts, 3)
    out = {i for a, b in gone for i in range(a, b)}
    assert substring_dedup.cut(text, gone).encode().split() == [w for i, w in enumerate(all_words) if i not in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<td>", "<table>", "</table>", "<script>", "</script>", "<br>", "x", " y ", "&amp;", "<", "&", "<!--", "-->"]), max_size=30))
def test_any_markup_is_read(parts):
    tree = Tree("".join(parts))
    assert all(p < i for i, p in enumerate(tree.parent)) and all(0 <= n < len(tree.tag) for _, n, *_ in tree.runs)
    blocks_of(tree.runs, np.ones(len(tree.tag), bool))
