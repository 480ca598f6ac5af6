"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of the vocabulary crosses a white-space marker (a marker follows nothing but
markers) and none holds a line feed, merging can't act across these places. A text is then cut
before each run of markers and each line feed, each distinct chunk is segmented once, and the ids
are joined back in the order of the chunks. A vocabulary that has crossing pieces is found when it
is loaded; texts are then segmented whole.

One narrow pass without a shuffle: the table is a worker's own and bounded.

Defined cases: a null text is an empty one, which has the begin and end ids alone; repeated rows
give equal results; texts are encoded whole, however long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import tokenizer_path

MARK = "▁"
#: Bytes of distinct chunks and their ids that a worker keeps, with about so many for each entry; beyond that it starts anew.
CACHE, ENTRY = 64 << 20, 250
_CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Codec:
    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) or " " in p or "\n" in p for p in pieces)
        self.most, self.known, self.held = cache, {}, 0
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        # the library adds one marker before a text and keeps all other characters as they are
        probe = "  a\n ﬁ Å  "
        kept = self.model.decode(self.model.encode(probe)) == probe and self.model.encode(" a", out_type=str)[0].startswith(MARK)
        self.by_chunk = kept and not crossing and self._chunked("a  b\n\nc") == self.model.encode("a  b\n\nc") and MARK in pieces
        self.known, self.held = {}, 0

    def _segment(self, chunk: str) -> bytes:
        if chunk[0] == "\n":  # the added marker stands alone before a line feed
            ids = self.model.encode(chunk)[1:]
        else:  # the added marker stands for the first of the chunk's own
            ids = self.model.encode(chunk[1:]) if len(chunk) > 1 else [self.model.piece_to_id(MARK)]
        return np.array(ids, "<u4").tobytes()

    def _bytes(self, text: str) -> bytes:
        chunks = _CHUNK.findall(" " + text.replace(MARK, " "))
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            distinct = set(chunks)
            made = {c: self._segment(c) for c in distinct if c not in self.known}
            size = sum(4 * len(c) + len(ids) + ENTRY for c, ids in made.items())
            if self.held + size > self.most:  # anew; a text of more than fits is segmented without the table
                made |= {c: self.known[c] for c in distinct if c in self.known}
                self.known, self.held = {}, 0
                return b"".join(map(made.__getitem__, chunks))
            self.known.update(made)
            self.held += size
            return b"".join(map(self.known.__getitem__, chunks))

    def _chunked(self, text: str) -> list[int]:
        return np.frombuffer(self._bytes(text), "<u4").tolist() if text else []

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end, as the library gives them."""
        own = self._chunked(text) if self.by_chunk else self.model.encode(text)
        return [self.begin, *own, self.end]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, digests, decoded, kept = [], [], [], []
                for text in part.column(1):
                    ids = codec.encode(text.as_py() or "")
                    back = codec.decode(ids)
                    n.append(len(ids))
                    digests.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        kept.append((ids, back))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([x for x, _ in kept], pa.list_(pa.int32())), pa.array([x for _, x in kept], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(path, with_ids), schema)
