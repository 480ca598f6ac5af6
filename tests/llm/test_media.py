import hashlib
import html
import re
import struct
import zlib

import pytest

from fathomline.llm import media as M


def test_images_are_lossless():
    for n in (0, 1, 575, 576, 577, 60000):
        raw = bytes(i * 7 % 251 for i in range(n))
        payload = M.padded(raw)
        assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.rstrip(b"\xff") == raw and len(payload) - n <= 576
        image = M.encode(payload)
        assert M.decode(image) == payload
    with pytest.raises(ValueError):
        M.decode(image[:60] + b"x" + image[61:])


def plain_png(data):
    """(width, height, bit depth, colour type, samples) by the format's rules alone, all five row filters."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        chunks.append((kind, body))
        at += 12 + n
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    width, height, depth, colour, method, filtering, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    assert (method, filtering, interlace) == (0, 0, 0)
    raw = zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT"))
    assert len(raw) == height * (width + 1)
    out, above = bytearray(), bytes(width)
    for y in range(height):
        kind, row = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[x] = (row[x] + (0, a, b, (a + b) // 2, near)[kind]) % 256
        out += row
        above = bytes(row)
    return width, height, depth, colour, bytes(out)


def plain_feature(payload):
    mean = sum(payload) / len(payload)
    deviation = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
    return mean, deviation, [sum(64 * k <= x < 64 * (k + 1) for x in payload) for k in range(4)]


def test_stored_form_and_feature_by_other_means(spark):
    texts = ["", "abc", "é日本 " * 300, "z" * 5000, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.digest: bytes(r.media) for r in M.store(docs).collect()}
    rows = {r.doc_id: r for r in M.text_media(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        image = kept[hashlib.sha256(raw).hexdigest()]
        width, height, depth, colour, samples = plain_png(image)
        assert (width, depth, colour) == (576, 8, 0) and samples == raw + b"\xff" * (576 * height - len(raw)) and 0 <= 576 * height - len(raw) <= 576
        r = rows[i]
        assert (r.media_sha256, r.media_bytes, r.payload_sha256) == (hashlib.sha256(image).hexdigest(), len(image), hashlib.sha256(samples).hexdigest())
        mean, deviation, bins = plain_feature(samples)
        got = re.fullmatch(r"mean=(.*);std=(.*);hist=(.*)", r.feature).groups()
        assert abs(float(got[0]) - mean) < 1e-5 and abs(float(got[1]) - deviation) < 1e-4 and got[2] == ",".join(map(str, bins))


def test_rows_come_by_position(spark):
    """Repeated texts share a digest: only the position on the page tells whose a figure is."""
    rows = [(i, ["same", f"text {i}", ""][i % 3], [None, "a<b>&", "plain"][i % 3]) for i in range(53)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = M.text_media(docs, caption_col="source").collect()
    assert sorted((g.doc_id, g.payload_sha256, g.caption) for g in got) == sorted(((i, hashlib.sha256(M.padded(t.encode())).hexdigest(), c) for i, t, c in rows), key=lambda x: x[0])
    assert max(sum(g.sequence_id == s for g in got) for s in {g.sequence_id for g in got}) == M.FIGURES
    for g in got:  # a heading, then a text and a figure for each document
        assert g.position == 2 * (g.doc_id % M.FIGURES) + 2


def test_pages_of_the_tables(spark, sf):
    from fathomline.llm.queries import media_page_sequences

    got = {g.page_id: g for g in media_page_sequences(spark, sf).collect()}
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages) > 20
    for p in pages:
        body = re.sub(r"(?s)<(title|style|script)>.*?</\1>|<!--.*?-->", "", p.html)
        body = re.sub(r"</?(?:html|body|nav|ul|li|div|article|h1|p|footer|head)(?: [^>]*)?>", "\x01", body).replace("<br>", " ")
        body = html.unescape(re.sub(r"<[^>]*>", "", body))
        blocks = [b for b in (" ".join(x.split()) for x in body.split("\x01")) if b]
        g, d = got[p.page_id], docs.get(p.page_id)
        assert g.text_sha256 == hashlib.sha256("\n".join(blocks).encode()).hexdigest(), p.page_id
        assert (g.n_media, g.n_items, g.position, g.caption) == ((1, len(blocks) + 1, len(blocks), d.lang) if d else (0, len(blocks), None, None))
        assert not d or g.n_bytes == len((d.text or "").encode())


PAGE = """<h1>Title &amp; more</h1><p>Before <img src="sha256:{a}" alt="first"> after.</p>
<figure><img src="{b}"><img src="missing"><figcaption>Both of
them</figcaption></figure><script>no</script><p>End"""


def test_sequences_stay_aligned(spark):
    texts = ["abc", "é" * 700, "", None, "abc"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = M.facts(M.store(docs))
    assert found.count() == 3
    a, b = (hashlib.sha256(t.encode()).hexdigest() for t in ("abc", "é" * 700))
    html = PAGE.format(a=a, b=b)
    pages = spark.createDataFrame([(1, html, "x"), (1, html, "x"), (None, "", "x"), (3, None, "x")], "page_id long, html string, digest string")
    got = M.interleaved(pages, found).collect()
    assert sorted(len(g.sequence) for g in got) == [0, 0, 7, 7]
    s = next(g.sequence for g in got if g.sequence)
    assert [(x.kind, x.text) for x in s] == [("text", "Title & more"), ("text", "Before"), ("media", "first"), ("text", "after."), ("media", "Both of them"), ("media", "Both of them"), ("text", "End")]
    assert [x.n_bytes for x in s] == [None, None, 3, None, 1400, None, None] and [x.position for x in s] == list(range(7))


def test_every_text(spark):
    texts = ["abc", "é" * 700, "", None, "abc", "x" * 576, "long text 日本 " * 30000, "ÿ ÿ"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "abc", 5), (0, "abc", 5)]
    got = M.text_media(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(3)).collect()
    assert sorted((str(g.doc_id) for g in got)) == sorted(str(i) for i, *_ in rows)
    for g in got:
        raw = ("abc" if g.doc_id is None else texts[g.doc_id] or "").encode()
        payload = M.padded(raw)
        image = M.encode(payload)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (g.media_bytes, g.media_sha256, g.feature) == (len(image), hashlib.sha256(image).hexdigest(), M.feature(payload))
    assert M.text_media(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0
