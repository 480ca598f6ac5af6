"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces of binary lengths: as many of the full sequence length as
fit, then one piece for each set bit of the rest, longest first. Each piece is a sequence of its
own, filed in the bucket of its length; so no sequence crosses documents and none needs padding.

The work is one narrow pass: no shuffle, no sort, no state beyond a batch.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows and
ids give pieces each; a very long text has many pieces of full length; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import tokenizer_path

#: Bytes of text whose words are looked up together.
TOGETHER = 1 << 24
# Latin letters whose lower case is one letter, composed already; and ASCII marks that
# part from a letter before them and begin no special token.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ý]+)(?P<marks>[.,!?;:#%&*$)]*)$"


class WordTokenizer:
    """Ids of texts as the tokenizer gives them, with each distinct word of a batch encoded once.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its
    words in turn. It lower-cases, and marks part from the letter before them, so a word of plain
    letters and last marks has the ids of its letters in lower case, then those of the marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        # for lower-case letters alone, which the full rules would neither change nor part
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
        bare = rules | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        suffix = rules["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in rules["model"]["vocab"].items():
            self.last[i] = token.endswith(suffix)

    def _letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters: encoded as one text, and parted where a token ends a word."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.flatnonzero(self.last[ids]) + 1

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where those of each word begin."""
        found = pc.extract_regex(words, _PLAIN)
        plain = np.asarray(found.is_valid())
        letters = pc.utf8_lower(found.field("letters").filter(pa.array(plain))).dictionary_encode()
        marks = found.field("marks").filter(pa.array(plain)).dictionary_encode()
        others = words.filter(pa.array(~plain)).to_pylist()
        flat, ends = [], [np.zeros(1, np.int64)]
        base = 0
        distinct = letters.dictionary.to_pylist()
        for lo in range(0, len(distinct), 1 << 15):
            ids, at = self._letters(distinct[lo : lo + (1 << 15)])
            flat.append(ids)
            ends.append(at + base)
            base += len(ids)
        for text in (*marks.dictionary.to_pylist(), *others):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            flat.append(ids)
            base += len(ids)
            ends.append(np.array([base]))
        ids, starts = np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate(ends)
        n, m = len(distinct), len(marks.dictionary)
        # two parts for each word: its letters and its marks, or the word and nothing
        part = np.zeros((len(words), 2), np.int64)
        part[plain, 0] = letters.indices.to_numpy()
        part[plain, 1] = n + marks.indices.to_numpy()
        part[~plain, 0] = n + m + np.arange(len(others))
        part[~plain, 1] = len(starts) - 1
        size = np.append(np.diff(starts), 0)
        two = size[part]
        return gathered(ids, np.append(starts, len(ids))[part.ravel()], two.ravel()), np.append(0, np.cumsum(two.sum(1)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where those of each text begin (one more at the end)."""
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        table, starts = self._table(each.dictionary)
        which = each.indices.to_numpy(zero_copy_only=False)
        size = np.diff(starts)[which]
        reach = np.append(0, np.cumsum(size))
        return gathered(table, starts[which], size), reach[np.asarray(words.offsets) - words.offsets[0].as_py()]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, opened once."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def _parts_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``TOGETHER`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    reach = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + TOGETHER, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def lengths(n: int, most: int) -> list[int]:
    """Binary piece lengths of n tokens, longest first; ``most`` is a power of two."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def _pieces(path: str, most: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for batch in batches:
            for part in _parts_of(batch, 1):
                found, starts = tokenizer.ids(part.column(1).fill_null(""))
                docs = len(starts) - 1
                total = np.diff(starts) + 1
                ids = np.full(len(found) + docs, end_id, "<u4")  # every text's ids, then the end
                ids[np.arange(len(found)) + np.repeat(np.arange(docs), total - 1)] = found
                whole = memoryview(ids.tobytes())
                out = [[] for _ in range(7)]
                at = 0
                for doc, tokens in zip(part.column(0).to_pylist(), total.tolist(), strict=True):
                    start = 0
                    for n in lengths(tokens, most):
                        own = whole[4 * at : 4 * (at + n)]
                        for column, value in zip(out, (doc, start, n, zlib.crc32(own), tokens, n.bit_length() - 1, bytes(own) if with_ids else None), strict=True):
                            column.append(value)
                        at += n
                        start += n
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
                m = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out[:m], kinds[:m], strict=True)], names[:m])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, end_id: int = 2, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    ``bucket`` is the binary logarithm of the length; ``with_ids`` adds the ids as little-endian
    32-bit bytes. A sequence id holds the task's number and the row's number in it, so ids are unique without
    a global sort; a task that is run again reads the same rows and gives the same ids.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    path = path or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(path, most, end_id, with_ids), COLUMNS + (", ids binary" if with_ids else ""))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return rows.select(*own, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *(["ids"] if with_ids else []))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes packed sequences in one folder per length, ready to be read batch by batch."""
    pieces.write.partitionBy("bucket").parquet(path)
