"""Media columns as interleaved document sequences.

HTML is parsed into an ordered list of structs: text, or a reference to a medium with its caption.
References name media by digest; a join with the media store resolves them, and each sequence is put
together again in the order of its positions, so text, media and captions stay aligned.

The store keeps payloads losslessly as 8-bit grey PNG images of 576 samples a row. A payload is
read back from the stored bytes alone. A task leaves out digests that it has stored already; what
several tasks have stored is made one after reading, when each medium is a small row of facts.

Defined cases: a null text or page is empty (an empty text has one row of padding; an empty page has
an empty sequence); a reference whose medium isn't in the store keeps null facts; a medium without a
caption or alt text, or with a null one, has a null caption; equal texts have equal values; repeated
rows have results each; a sequence's parts are put together by row number, so repeated or null ids
are fine; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize
from fathomline.llm.html_tree import BLOCKS

WIDTH = 576
#: Texts that are shown on one page.
FIGURES = 8
#: Digests that a task remembers to leave out media that it has stored.
REMEMBERED = 100_000
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of the row width; UTF-8 never has a byte 255."""
    return text + b"\xff" * ((-len(text)) % WIDTH if text else WIDTH)


def encode(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, row by row."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload fills whole rows")
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an image that ``encode`` made; chunk sums are checked."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, head, packed = 8, b"", []
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = data
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head)
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or colour or rows[:, 0].any():
        raise ValueError("not an image of the store")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and a 4-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    total = int((counts * np.arange(256)).sum())
    square = int((counts * np.arange(256) ** 2).sum())
    mean = total / len(x)
    bins = ",".join(str(int(b)) for b in counts.reshape(4, 64).sum(1))
    return f"mean={mean:.6f};std={max(0.0, square / len(x) - mean * mean) ** 0.5:.6f};hist={bins}"


def _store(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests: list[str] = []
            data: list[bytes] = []
            size = 0
            for text in batch.column(0):
                raw = (text.as_py() or "").encode()
                name = hashlib.sha256(raw)
                if name.digest() in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name.digest())
                digests.append(name.hexdigest())
                data.append(encode(padded(raw), level))
                size += len(data[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(data, pa.binary())], ["digest", "media"])
                    digests, data, size = [], [], 0
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(data, pa.binary())], ["digest", "media"])

    return run


def store(docs: DataFrame, text_col: str = "text", level: int = 1) -> DataFrame:
    """Writes the texts of ``docs`` as media into the shared folder: (digest of the text, media)."""
    return materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(_store(level), "digest string, media binary"), "media")


FACTS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(media: DataFrame) -> DataFrame:
    """One row per medium: what is read back from its stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                payload = decode(data)
                row = (digest, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["digest", *FACTS])

    read = media.select("digest", "media").mapInArrow(run, _FACTS)
    # a table of its own: the join with references then splits a medium that many rows refer to
    return materialize(read.groupBy("digest").agg(*[F.min(c).alias(c) for c in FACTS]), "media-facts")


class Sequence(HTMLParser):
    """``items``: (kind, text or caption, digest) in the order of the page."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.figures: list[int] = []  # where the open figures began
        self.caption: list[str] | None = None
        self.hidden = 0
        self.feed(page)
        self.close()
        self._block()

    def _block(self) -> None:
        joined = " ".join("".join(self.text).split())
        if joined:
            self.items.append(["text", joined, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "template", "title"):
            self.hidden += 1
        if tag in BLOCKS:
            self._block()
        if tag == "br":
            self.text.append(" ")
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed"):
            found = {k: v or "" for k, v in attrs}
            source = found.get("src", "")
            if source:
                self._block()
                self.items.append(["media", found.get("alt", "") or None, source.removeprefix("sha256:")])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template", "title"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            joined, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item[0] == "media" and joined:
                    item[1] = joined
        elif tag == "figure" and self.figures:
            self.figures.pop()
        if tag in BLOCKS:
            self._block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


_ITEMS = "array<struct<position:int,kind:string,text:string,digest:string>>"


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(row, id, items): each page as its ordered structs; a medium's ``text`` is its caption.

    The row number is the task's and the row's in it: write the outcome as a table before it is joined.
    """
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                items = [[{"position": i, "kind": k, "text": t, "digest": d} for i, (k, t, d) in enumerate(Sequence(page.as_py() or "").items)] for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(items, kind)], ["row", "id", "items"])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"row long, id long, items {_ITEMS}")


def resolved(items: DataFrame, found: DataFrame) -> DataFrame:
    """(row, id, position, kind, text, digest, facts...) of sequences, media resolved by their digest; texts don't take part in the join."""
    each = items.select("row", "id", F.explode("items").alias("x")).select("row", "id", "x.*")
    media = each.where("kind = 'media'").join(found, "digest", "left").select(*each.columns, *[c for c in found.columns if c != "digest"])
    return media.unionByName(each.where("kind <> 'media'"), allowMissingColumns=True)


def interleaved(pages: DataFrame, found: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(row, id, sequence): each page's structs in order, with the facts of its media."""
    items = materialize(sequences(pages, id_col, html_col), "sequences")
    extra = [c for c in found.columns if c != "digest"]
    parts = resolved(items, found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("position", "kind", "text", "digest", *extra))).alias("sequence"))
    return items.select("row", "id").join(parts, "row", "left").select("row", "id", F.coalesce("sequence", F.array().cast(parts.schema["sequence"].dataType)).alias("sequence"))


def _album(docs: pa.RecordBatch, first: int) -> str:
    """A page that shows texts as figures, one after another, each with words before it and a caption."""
    out = ["<h1>Documents</h1>"]
    for k, (digest, caption) in enumerate(zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True)):
        shown = html.escape(caption) if caption else ""
        out.append(f'<p>Number {first + k + 1}</p><figure><img src="sha256:{digest}"><figcaption>{shown}</figcaption></figure>')
    return "".join(out)


def albums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", caption_col: str | None = None, figures: int = FIGURES) -> DataFrame:
    """(page_id, ids, html): pages of up to ``figures`` texts, with the ids of those in order. Narrow: a page's texts are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.slice(lo, figures) for lo in range(0, batch.num_rows, figures)]
            yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_pylist() for p in parts], pa.list_(pa.int64())), pa.array([_album(p, 0) for p in parts], pa.string())], ["ids", "html"])

    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), (F.col(caption_col).cast("string") if caption_col else F.lit(None).cast("string")).alias("caption"))
    made = rows.mapInArrow(run, "ids array<long>, html string")
    return materialize(made.select(F.monotonically_increasing_id().alias("page_id"), "ids", "html"), "albums")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", caption_col: str | None = None) -> DataFrame:
    """Every text as a medium of an interleaved page of several; one row per row of ``docs``.

    It has doc_id, the facts, and where the medium stands: sequence_id, position and caption. The
    k-th medium of a sequence is that of the page's k-th id, so ids come from positions alone.
    """
    found = facts(store(docs, text_col))
    pages = albums(docs, id_col, text_col, caption_col)
    media = interleaved(pages, found).select("id", F.filter("sequence", lambda x: x["kind"] == "media").alias("media"))
    each = media.join(pages.select(F.col("page_id").alias("id"), "ids"), "id").select("id", "ids", F.posexplode("media").alias("k", "m"))
    return each.select(F.get("ids", F.col("k")).alias("doc_id"), *[F.col(f"m.{c}").alias(c) for c in FACTS], F.col("id").alias("sequence_id"), F.col("m.position").alias("position"), F.col("m.text").alias("caption"))
