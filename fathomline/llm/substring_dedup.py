"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``window`` consecutive words is hashed. A word goes if a window that covers it
also starts in a document with a smaller id; overlapping windows merge into maximal intervals.

How the count avoids a shuffle of one row per word:

* Each window is filed under its *anchor*, the least hash among its inner ``inner``-word grams.
  Equal windows have equal anchors, so windows under different anchors never need to meet.
  Neighbouring windows mostly share an anchor; such a run of windows is a *segment*.
* Segments are counted by (anchor, hash of the segment's words), with partial aggregation, so a
  passage copied into a third of all rows arrives as a few rows. An anchor found in one document
  alone is settled: none of its windows repeats.
* Under an anchor with several different segments, windows are counted one by one, from one
  occurrence of each different segment, by (anchor, window hash).

Two words, windows or segments count as equal when their 64-bit hashes and those of their anchors do.

Defined cases: a null text has no words; a document without ``window`` words keeps all; a null id
is neither smaller nor larger than another, so such rows keep all and remove nothing elsewhere;
rows that share an id don't remove each other's words (no smaller id); repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomline.llm import words as W
from fathomline.llm.common import materialize, text_key

SEGMENTS = "anchor long, span long, doc long, key long, first long, n int"
WINDOWS = "anchor long, h long, span long, i int, lo long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def segments_of(column: pa.Array, window: int, inner: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor, span, first window, number of windows) of each segment of a text column."""
    for rows, at, hashes in W.blocks(column, carry=window - 1):
        m = len(hashes) - window + 1
        if m < 1:
            continue
        whole = np.flatnonzero(rows[:m] == rows[window - 1 :])
        if not len(whole):
            continue
        sums = W.Prefix(hashes)
        grams = sums.windows(inner)
        least = W.sliding_argmin(grams, window - inner + 1)[whole]
        new = np.empty(len(whole), bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(whole)))
        start = whole[begin]
        yield rows[start], grams[least[begin]], sums.of(start, start + n + window - 1), at[start], n


def _segments(window: int, inner: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for row, anchor, span, first, n in segments_of(batch.column(2), window, inner):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(anchor), _signed(span), ids[row], keys[row], first.astype(np.int64), n.astype(np.int32))], ["anchor", "span", "doc", "key", "first", "n"])

    return run


def _windows(window: int):
    """Window hashes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            counts = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            anchor, span, first, n, lo = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            owner = np.repeat(np.arange(len(counts)), counts)
            for rows, at, hashes in W.blocks(batch.column(0), carry=window - 1):
                if len(hashes) < window:
                    continue
                # segments never cross blocks: both come from the same cutting of the text
                lo_row, hi_row = rows[0], rows[-1]
                mine = np.flatnonzero((owner >= lo_row) & (owner <= hi_row))
                begin = np.searchsorted(rows, np.arange(lo_row, hi_row + 2))
                local = begin[owner[mine] - lo_row]
                ends = begin[owner[mine] - lo_row + 1]
                base = at[np.minimum(local, len(at) - 1)]
                start = local + first[mine] - base
                good = (first[mine] >= base) & (start + n[mine] + window - 1 <= ends)
                mine, start = mine[good], start[good]
                if not len(mine):
                    continue
                size = n[mine].astype(np.int64)
                which = np.repeat(np.arange(len(mine)), size)
                i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                begins = start[which] + i
                h = W.Prefix(hashes).of(begins, begins + window)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[mine][which], _signed(h), span[mine][which], i.astype(np.int32), lo[mine][which])], ["anchor", "h", "span", "i", "lo"])

    return run


def removal_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, inner: int = 16) -> DataFrame:
    """Per document with something to remove: (doc, key, parts), parts being runs of word numbers.

    ``key`` tells rows apart that share an id. A part is (first, n, hits): windows ``first`` to
    ``first + n - 1`` or, where hits isn't null, only those with these numbers counted from first.
    """
    if not 1 <= inner <= window:
        raise ValueError("inner must be between 1 and window")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("key"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    segments = keyed.select("doc", "key", "text").mapInArrow(_segments(window, inner), SEGMENTS)

    contents = segments.groupBy("anchor", "span").agg(F.min(F.struct("doc", "key", "first", "n")).alias("rep"), F.max("doc").alias("hi"))
    contents = materialize(contents, "substring-contents")
    anchors = contents.groupBy("anchor").agg(F.min("rep.doc").alias("least"), F.max("hi").alias("most"), F.count("*").alias("kinds")).where("least < most").select("anchor", "kinds")
    # tables of their own, here and below: a join of two exchanges splits a key that many rows share
    anchors = materialize(anchors, "substring-anchors")
    shared = materialize(contents.join(anchors, "anchor").select("anchor", "span", F.col("rep.doc").alias("lo"), "hi", "kinds", "rep"), "substring-shared")

    wanted = shared.where("kinds > 1").groupBy(F.col("lo").alias("doc"), F.col("rep.key").alias("key")).agg(F.collect_list(F.struct("anchor", "span", "rep.first", "rep.n", "lo")).alias("wanted"))
    # repeated rows would give the same windows again, which changes no minimum; hits are made distinct
    found = keyed.join(wanted, ["doc", "key"]).select("text", "wanted").mapInArrow(_windows(window), WINDOWS)
    found = materialize(found, "substring-found")
    least = found.groupBy("anchor", "h").agg(F.min("lo").alias("m"), F.max("lo").alias("x")).where("m < x").select("anchor", "h", "m")
    least = materialize(least, "substring-windows")
    hits = found.join(least, ["anchor", "h"]).where("m < lo").groupBy("anchor", "span").agg(F.collect_set("i").alias("hits"))
    resolved = shared.where("kinds = 1 and lo < hi").select("anchor", "span", "lo", F.lit(None).cast("array<int>").alias("hits")).unionByName(
        shared.where("kinds > 1").join(hits, ["anchor", "span"], "left").where("lo < hi or hits is not null").select("anchor", "span", "lo", "hits")
    )
    resolved = materialize(resolved, "substring-resolved")
    parts = segments.join(resolved, ["anchor", "span"]).where("doc > lo or hits is not null").select("doc", "key", F.struct("first", "n", F.when(F.col("doc") == F.col("lo"), F.col("hits")).alias("hits")).alias("part"))
    # a set: a row repeated a million times has the same parts, which are made one before the exchange
    return parts.groupBy("doc", "key").agg(F.collect_set("part").alias("parts"))


def merged(parts: list | None, window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) word intervals that the windows of ``parts`` cover."""
    spans = []
    for p in parts or ():
        first, n, hits = p["first"], p["n"], p["hits"]
        if hits is None:
            spans.append((first, first + n + window - 1))
        else:
            spans.extend((first + i, first + i + window) for i in hits)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(text: str, gone: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``gone``; white space between kept words stays."""
    if not gone:
        return text
    data = text.encode()
    starts, _ = W.bounds(np.frombuffer(data, np.uint8), np.zeros(0, np.int64))
    out, at = [], 0
    for a, b in gone:
        out.append(data[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(data)
    out.append(data[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, inner: int = 16, with_text: bool = True, out: str = "dedup") -> DataFrame:
    """One row per row of ``docs``: its columns, then a struct ``out`` with the outcome.

    It has n_words, n_removed, kept_sha256 (of the kept words, joined by one space), removed
    (maximal intervals of word numbers) and, with ``with_text``, kept (the text without them).
    """
    if out.lower() in [c.lower() for c in docs.columns]:  # names are compared as Spark does
        raise ValueError(f"{out} is a column already; name another")
    parts = removal_intervals(docs, id_col, text_col, window, inner)
    columns = docs.columns
    inside = [f"_{i}" for i in range(len(columns))]
    plain = docs.toDF(*inside)
    own_id, own_text = inside[columns.index(id_col)], inside[columns.index(text_col)]
    left = plain.withColumns({"__doc": F.col(own_id).cast("long"), "__key": text_key(own_text)})
    joined = left.join(parts.withColumnsRenamed({"doc": "__doc", "key": "__key", "parts": "__parts"}), ["__doc", "__key"], "left").select(*inside, "__parts")
    kind = "struct<n_words:long,n_removed:long,kept_sha256:string,removed:array<struct<start:long,end:long>>" + (",kept:string" if with_text else "") + ">"
    schema = joined.select(*inside, F.lit(None).cast(kind).alias("__dedup")).schema
    at = inside.index(own_text)
    out_type = to_arrow_type(schema["__dedup"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for text, own in zip(part.column(at), part.column(len(inside)), strict=True):
                    text, own = text.as_py(), own.as_py()
                    words = (text or "").encode().split()
                    n, gone = len(words), merged(own, window)
                    for a, b in reversed(gone):
                        del words[a:b]
                    row = {"n_words": n, "n_removed": n - len(words), "kept_sha256": hashlib.sha256(b" ".join(words)).hexdigest(), "removed": [{"start": a, "end": b} for a, b in gone]}
                    rows.append(row | ({"kept": None if text is None else cut(text, gone)} if with_text else {}))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(inside)], pa.array(rows, out_type)], [*inside, "__dedup"])

    return joined.mapInArrow(run, schema).toDF(*columns, out)
