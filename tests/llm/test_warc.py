import random

import pytest
import zstandard

from fathomline.llm import warc as A


def made():
    r = random.Random(8)
    rows = [(i, f"http://h/{i}", "".join(r.choice("ab<é日\r\n ") for _ in range(r.randint(0, 900)))) for i in range(60)]
    rows += [(100 + i, "http://c", rows[i % 5][2]) for i in range(40)]
    return rows + [(200, None, None), (201, "u\r\nX: y", ""), (None, "n", rows[1][2]), (None, "n2", "only here"), (0, "again", rows[0][2]), (300, "big", "long é " * 90000)]


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        own = i is None or first[h or ""] == i
        out.append((i, len(data), A.base32_sha1(data), "response" if own else "revisit", None if own else first[h or ""]))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = made()
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, d int").repartition(3)
    archives = A.archive(pages)
    got = A.read_back(archives).collect()
    assert sorted([(g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got], key=str) == brute(rows)
    assert A.read_back(A.archive(pages.limit(0))).count() == 0
    # single records by the index, and files that any zstd tool can unpack
    seen = 0
    for b in archives.collect():
        data = bytes(b.data)
        for e in b["index"]:
            head, block = A.read_record(data, e.frame, e.offset, e.length)
            assert head["WARC-Record-ID"] == e.record_id and len(block) == int(head["Content-Length"])
            seen += 1
    assert seen == len(rows)
    wrote = A.export(archives, str(tmp_path)).collect()
    files = sorted(tmp_path.iterdir())
    assert len(files) == len(wrote)
    n = 0
    for f in files:
        whole = zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read()
        n += sum(1 for _ in A.parse(whole))
    assert n == len(rows)


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {g.page_id: (g.record_type, g.refers_to) for g in A.read_back(A.archive(pages, least=4)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_reading_goes_through_the_index():
    """Places decide what is read: order doesn't matter, a wrong place or a record left out is an error."""
    writer = A.BundleWriter()
    for i in range(900):
        payload = f"page {i} ".encode() * (i % 97 + 1)
        digest = A.base32_sha1(payload)
        writer.add(A.record_id(i, digest), A.record(i, "u", payload, digest, None, "1970-01-01T00:00:00Z"))
    bundle, index = writer.finish(), writer.index
    assert len(A.seek_table(bundle)) > 1
    places = lambda es: [[e[k] for e in es] for k in ("record_id", "frame", "offset", "length")]
    assert [int(h["X-Page-Id"]) for _, h, _ in A.indexed_records(bundle, *places(index))] == list(range(900))
    assert [int(h["X-Page-Id"]) for _, h, _ in A.indexed_records(bundle, *places(index[::-1]))] == list(range(900))[::-1]
    swapped = [dict(e) for e in index]
    swapped[3]["offset"], swapped[4]["offset"] = swapped[4]["offset"], swapped[3]["offset"]
    for wrong in (swapped, index[:-1]):
        with pytest.raises(ValueError):
            list(A.indexed_records(bundle, *places(wrong)))
