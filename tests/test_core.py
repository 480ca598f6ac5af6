import hashlib
import json
import shutil
import subprocess
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from fathomline import cli, shared
from fathomline.functions import exprs as E
from fathomline.operators import dedup, formats, index, results, search
from fathomline.plans import pipeline
from fathomline.plans.progress import Progress
from fathomline.schema import RECORD, QuerySet, ResultSet
from fathomline.server import Client, made
from fathomline.sources import files, text
from fathomline.streaming import incremental


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "line string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


PEOPLE = [("foo@bar.com", "foo", "bar.com", "hunter2"), ("foo2@bar.com", "foo2", "bar.com", "password"), ("foo3@baz.com", "foo3", "baz.com", "monkey12")]


@pytest.fixture(scope="module")
def people(spark):
    more = [(f"u{i}@d{i % 3}.org", f"u{i}", f"d{i % 3}.org", ["", "xxx", "a" * 32, "pw"][i % 4]) for i in range(40)]
    return spark.createDataFrame(PEOPLE + more, RECORD)


@pytest.mark.parametrize("name,mark", [("colon-newline", ":"), ("semicolon-newline", ";"), ("whitespace-newline", "  "), ("whitespace-newline", "\t"), ("colon", ":"), ("semicolon", ";"), ("whitespace", " ")])
def test_formats(spark, name, mark):
    raw = [f"{e}{mark}{p}" for e, _, _, p in PEOPLE]
    assert got(formats.normalize(lines(spark, raw), name)) == sorted(PEOPLE)
    other = ";" if mark != ";" else ":"
    assert formats.normalize(lines(spark, [x.replace(mark, other) for x in raw]), name).count() == 0


def test_format_edges(spark):
    cases = {"a@b.co:": ("a@b.co", "a", "b.co", ""), "a@b.c:x": None, "a@b..co:x": ("a@b..co", "a", "b..co", "x"), "FOO@Bar.com:AbC": ("foo@bar.com", "foo", "bar.com", "AbC"), "a@b.co:x:y": None, "x a@b.co:y": None, "a@b@c.com:x": None, "a@b_c.com:x": None, "": None, " ": None, "  a@b.co:x\r": ("a@b.co", "a", "b.co", "x"), "a@" + "b." * 33 + "co:x": None}
    for line, wanted in cases.items():
        assert got(formats.normalize(lines(spark, [line]), "colon-newline")) == ([wanted] if wanted else []), line
    assert got(formats.normalize(lines(spark, ["a@b.co:x:y"]), "colon"))[0][3] == "xy"
    assert got(formats.normalize(lines(spark, ["a@b.co x y"]), "whitespace"))[0][3] == "xy"
    assert formats.normalize(lines(spark, ["a@b.co "]), "whitespace-newline").count() == 0
    with pytest.raises(ValueError):
        formats.named("none")
    with pytest.raises(ValueError):
        formats.register(formats.COLON)
    counts = formats.line_counts(lines(spark, [*cases, None]), "colon-newline").first()
    assert (counts["lines"], counts["blank"], counts["accepted"]) == (13, 2, 4), counts


DIGESTS = [("rscarratt6@yelp.com", 200218147811857), ("kbeeho0@51.la", 192572758851943), ("mmathivath@gov.uk", 267964999583888), ("jfashion16@ebay.co.uk", 151217208071787)]


def test_digests(spark):
    rows = spark.createDataFrame([*DIGESTS, ("", None), (None, None), ("é", None)], "v string, d long")
    for v, d, ours, back in rows.select("v", "d", E.digest48(F.col("v")), E.le_encode48(E.digest48(F.col("v")))).collect():
        first = hashlib.sha256((v or "").encode()).digest()[:6]
        assert ours == int.from_bytes(first, "little") and back == first.hex() and d in (None, ours)


def test_predicates(spark):
    cases = [("", True, False), ("xxx", True, False), ("XXX", False, False), ("a" * 32, False, True), ("a" * 31, False, False), ("A" * 22 + "==", False, True), ("A" * 22, False, False), ("abcdefg", False, False), ("Abcdefghijklmnopqrstuvwx", False, True), ("éééé", False, False), ("a" * 32 + "\n", False, False)]
    rows = spark.createDataFrame(cases, "p string, b boolean, h boolean")
    assert rows.where((E.is_blank(F.col("p")) != F.col("b")) | (E.is_hash(F.col("p")) != F.col("h"))).count() == 0
    assert all((E.value_is_blank(p), E.value_is_hash(p)) == (b, h) for p, b, h in cases)
    assert [r[0] for r in lines(spark, [" 　a b \t\r"]).select(E.utrim(F.col("line"))).collect()] == ["a b"]


def test_json(spark):
    one = spark.createDataFrame([("a@b.co", "a", "b.co", 'q"<&>\\é')], RECORD)
    plain, safe, spaced = one.select(E.record_json(), E.record_json(html_safe=True), E.record_json(spaced=True)).first()
    assert json.loads(plain) == json.loads(safe) == json.loads(spaced) and "\\u003c\\u0026\\u003e" in safe and '", "user": "a"' in spaced
    raw = [plain, '{"EMAIL":"x","Password":"y"}', "not json", "{}", '{"email":5}', "[1]", '{"email":null,"user":"u"}']
    raw += ['{"email":"z"} trailing', '{"email":"z"}{"email":"y"}', '{"domain":{"x":1},"user":"u"}', '{"email":"a","email":"b"}', '{"Email":"a","email":"b"}', '{"email":"z"', '{"email":["z"],"password":"p\\u00e9\\n"}', '{"email":"z"}]']
    back = [tuple(r[0]) for r in lines(spark, raw).select(E.decoded(F.col("line"))).collect()]
    assert back == [("a@b.co", "a", "b.co", 'q"<&>\\é'), ("x", "", "", "y"), ("",) * 4, ("",) * 4, ("",) * 4, ("",) * 4, ("", "u", "", ""), ("",) * 4, ("",) * 4, ("", "u", "", ""), ("",) * 4, ("b", "", "", ""), ("",) * 4, ("", "", "", "p\u00e9\n"), ("",) * 4]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_bytes(b"a@b.co:1\r\n\n  \nb@b.co:2\rx")
    (tmp_path / "in" / "b.txt").write_text("c@b.co:3")
    (tmp_path / "skip.log").write_text("d@b.co:4\n")
    read = lambda **o: sorted(r.line for r in text.read_lines(spark, str(tmp_path), **o).collect())
    assert read() == ["a@b.co:1", "b@b.co:2\rx", "d@b.co:4"]
    assert read(recursive=True, skip_suffix=".log") == ["a@b.co:1", "b@b.co:2\rx", "c@b.co:3"]
    assert read(skip_prefix="skip") == ["a@b.co:1", "b@b.co:2\rx"]
    assert read(skip_prefix="file:", whole_path=True) == []
    some = text.read_collecting_errors(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none")])
    assert some.lines.count() == 2 and [p for p, _ in some.errors] == [str(tmp_path / "none")]
    assert text.read_collecting_errors(spark, [str(tmp_path / "none")]).lines is None
    assert got(text.read_with_offsets(spark, str(tmp_path / "a.txt"))) == [(0, "a@b.co:1\r"), (10, ""), (11, "  "), (14, "b@b.co:2\rx")]
    assert text.splits(spark, str(tmp_path)).agg(F.sum("lines")).first()[0] == 5
    assert got(text.line_counts_by_file(text.read_lines(spark, str(tmp_path))).select("lines")) == [(1,), (2,)]


def test_dedup(spark, tmp_path):
    rows = lines(spark, ["a", " a", "b", "", " ", "a\r", "c"])
    assert got(dedup.dedup_lines(rows)) == [("a",), ("b",), ("c",)]
    assert tuple(dedup.dedup_stats(rows).first()) == (5, 3, 2)
    assert tuple(dedup.dedup_stats(rows.limit(0)).first()) == (0, 0, 0)
    dedup.save_seen(lines(spark, ["a", "z"]), str(tmp_path / "seen"))
    assert got(dedup.dedup_incremental(rows, spark.read.parquet(str(tmp_path / "seen")))) == [("b",), ("c",)]
    dedup.write_dedup(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        dedup.write_dedup(rows, str(tmp_path / "out"))
    dedup.write_dedup(rows, str(tmp_path / "out"), append=True)
    assert text.read_lines(spark, str(tmp_path / "out")).count() == 6
    assert dedup.bloom_filter(rows, "line", 100, 0.01).mightContainString("b")


def test_index(spark, people, tmp_path):
    files.write_records(people, str(tmp_path / "j"))
    one = sorted((tmp_path / "j").glob("part-*"), key=lambda p: -p.stat().st_size)[0]
    held = text.records_with_offsets(spark, str(one))
    raw = one.read_bytes()
    for key in ("email", "user", "domain", "password"):
        made_ = index.index_build(held, key)
        entries = got(made_)
        assert len(entries) == raw.count(b"\n")
        for d, o in entries:
            value = json.loads(raw[o:].split(b"\n")[0])[key]
            assert d == int.from_bytes(hashlib.sha256(value.encode()).digest()[:6], "little")
        assert files.export_entries(made_, str(tmp_path / key)) == len(entries)
        flat = (tmp_path / key).read_bytes()
        assert len(flat) % 12 == 0 and got(files.read_entries(spark, str(tmp_path / key))) == entries
        order = [int.from_bytes(flat[i : i + 6], "little") for i in range(0, len(flat), 12)]
        assert order == sorted(order)
    with pytest.raises(ValueError):
        index.index_build(held, "name")
    numbers = spark.createDataFrame([(d, i) for i, d in enumerate([1, 2, 2, 9, 3, 4, 1])], "digest long, p long")
    assert tuple(index.sort_check(numbers, "p").first()) == (7, 2) and not index.is_sorted(numbers, "p")
    assert index.is_sorted(numbers.where("p < 4"), "p") and tuple(index.sort_check(numbers.limit(0), "p").first()) == (0, 0)
    assert [r.digest for r in index.sort_index(numbers.select("digest", F.col("p").alias("offset"))).collect()] == [1, 1, 2, 2, 3, 4, 9]
    files.write_index_parts(index.index_build(held, "email"), str(tmp_path / "parts"))
    files.merge_index(spark, str(tmp_path / "parts"), str(tmp_path / "merged"))
    assert got(spark.read.parquet(str(tmp_path / "merged"))) == got(index.index_build(held, "email"))


def test_sort_check_over_several_ranges(spark):
    """Inversions within the first range, within later ones and at their borders all count."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        falling = spark.range(40).select((-F.col("id")).alias("digest"), F.col("id").alias("p"))
        assert tuple(index.sort_check(falling, "p").first()) == (40, 39)
        first = falling.select(F.when(F.col("p") < 2, F.col("digest")).otherwise(F.col("p")).alias("digest"), "p")
        assert tuple(index.sort_check(first, "p").first()) == (40, 1) and not index.is_sorted(first, "p")
        assert index.is_sorted(falling.select(F.col("p").alias("digest"), "p"), "p")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_search(spark, people, tmp_path):
    index.write_lookup(people, "domain", str(tmp_path / "d"), partitions=3)
    lookup = index.read_lookup(spark, str(tmp_path / "d"))
    wanted = got(people.where("domain = 'd1.org'"))
    found = search.search(lookup, "domain", "d1.org")
    assert got(found.drop("digest_domain")) == wanted
    spark.conf.set("spark.sql.maxMetadataStringLength", 500)  # filters are shown whole
    plan = search.search(lookup, "domain", "d1.org")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(digest_domain" in plan and "EqualTo(domain,d1.org)" in plan
    held = people.withColumn("offset", F.monotonically_increasing_id())
    assert got(search.search_index(index.index_build(held, "domain"), held, "domain", "d1.org").drop("offset")) == wanted
    assert got(search.search_sql(people, "domain", "d1.org")) == got(people.where("domain = 'd1.org'").select("email", "password"))
    assert search.search_email(people, "FOO@bar.com").count() == 0 and search.search_user(people, "foo").count() == 1
    assert got(search.search_batch(people, spark.createDataFrame([("foo",), ("u1",), ("foo",)], "value string"), "user").select("email")) == [("foo@bar.com",), ("u1@d1.org",)]
    with pytest.raises(ValueError):
        search.search(people, "name", "x")


def test_a_lookup_answers_for_its_own_key_alone(spark, people, tmp_path):
    lookups = {}
    for key in ("email", "user", "domain"):
        index.write_lookup(people, key, str(tmp_path / key), partitions=2)
        lookups[key] = index.read_lookup(spark, str(tmp_path / key))
    asked = {"email": "foo@bar.com", "user": "foo2", "domain": "d1.org"}
    for built, lookup in lookups.items():
        for key, value in asked.items():
            if key == built:
                assert search.search(lookup, key, value).count() == people.where(F.col(key) == value).count() > 0
            else:
                with pytest.raises(ValueError, match=f"{key} is not indexed"):
                    search.search(lookup, key, value)
    for key, value in asked.items():
        status, body = results.answer(lookups, json.dumps({key: value}))
        assert status == 200 and json.loads(body)["count"] == people.where(F.col(key) == value).count()
    del lookups["user"]
    for paged in (False, True):
        status, body = results.answer(lookups, '{"user": "foo"}', paged)
        assert status == 400 and "user is not indexed" in body


def test_answers_are_bounded(people):
    with pytest.raises(ValueError, match="by pages"):
        results.handle(people, QuerySet(domain="d1.org"), most=5)
    one = people.where("domain = 'd1.org'").select("email", "password")
    with pytest.raises(Exception, match="by pages"):
        results.result_json(one, most=5).collect()
    assert json.loads(results.result_json(one, most=one.count()).first()[0])["count"] == one.count()


def test_one_body_holds_all_results(spark):
    """Beyond 100,000 results too, in the total order over several ranges."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(100_003).select(F.concat(F.lit("u"), F.lpad((F.col("id") * 7919 % 100_003).cast("string"), 6, "0"), F.lit("@x.org")).alias("email"), F.lit('"p\\é\n').alias("password"))
        assert results.result_texts(rows).count() > 1
        body = results.result_json(rows).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = json.loads(body)
    assert found["results"] == [{"email": f"u{i:06d}@x.org", "password": '"p\\é\n'} for i in range(100_003)]
    assert list(found) == ["count", "page", "pages", "results"] and (found["count"], found["page"], found["pages"]) == (100_003, 0, 1)
    assert results.result_json(rows.limit(0)).first()[0] == '{"count":0,"page":0,"pages":1,"results":[]}'


def test_stored_index_of_offsets(spark, people, tmp_path, capsys):
    """Entries on disk, sorted by the command, then lines at their offsets, by point reads and by a join."""
    files.write_records(people.coalesce(1), str(tmp_path / "j"))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("index", tmp_path / "j", "--output", tmp_path / "parts", "--key", "domain", "--offsets")
    run("sort", tmp_path / "parts", "--output", tmp_path / "sorted", "--partitions", 3, "--progress")
    assert f"sort: merged: rows {people.count()}" in capsys.readouterr().err
    assert index.is_sorted(pipeline.placed(spark, str(tmp_path / "sorted")), "place")
    wanted = got(people.where("domain = 'd1.org'"))
    for most in (1000, 2):
        found = search.search_stored(spark, str(tmp_path / "sorted"), str(tmp_path / "j"), "domain", "d1.org", most)
        assert got(found.drop("offset")) == wanted
    assert search.search_stored(spark, str(tmp_path / "sorted"), str(tmp_path / "j"), "domain", "none").count() == 0
    run("search", tmp_path / "sorted", "domain", "d1.org", "--lines", tmp_path / "j", "--json")
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["count"] == len(wanted)


def test_overwrite_and_saved_lines(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.txt").write_text("a@b.co:1\nb@b.co:2\n")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    for flags, n in (([], 2), ([], 4), (["--overwrite"], 2), (["--overwrite"], 2)):
        run("normalize", tmp_path / "one", "--output", tmp_path / "json", *flags)
        assert text.read_records(spark, str(tmp_path / "json")).count() == n
    with pytest.raises(ValueError):
        files.write_records(text.read_records(spark, str(tmp_path / "json")), "x", append=True, overwrite=True)
    # a run saves what it emits, not what the output had before
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.txt").write_text("earlier\n")
    pipeline.dedup_stage(spark, str(tmp_path / "one"), str(tmp_path / "old"), append=True, save=str(tmp_path / "seen"))
    assert got(spark.read.parquet(str(tmp_path / "seen"))) == [("a@b.co:1",), ("b@b.co:2",)]
    assert text.read_lines(spark, str(tmp_path / "old")).count() == 3


def test_progress(spark):
    p = Progress()
    rows = p.watch(spark.range(100), "all", even=F.count_if(F.col("id") % 2 == 0))
    kept = p.watch(rows.where("id < 30"), "kept")
    assert kept.count() == 30
    assert p.report() == {"all": {"rows": 100, "even": 50}, "kept": {"rows": 30}} and p.share("kept", "all") == 30.0
    p.note("none", 0)
    assert p.share("kept", "none") == 100.0 and "kept: rows 30" in p.lines()
    with pytest.raises(ValueError):
        p.watch(rows, "all")


def test_files_that_are_left_out(spark, tmp_path):
    for name in ("y.txt", "_x.txt", ".h.txt"):
        (tmp_path / name).write_text(f"line of {name}\n")
    assert [p.rsplit("/", 1)[-1] for p in text.left_out(spark, str(tmp_path))] == [".h.txt", "_x.txt"]
    some = text.read_collecting_errors(spark, [str(tmp_path)])
    assert [r.line for r in some.lines.collect()] == ["line of y.txt"]
    assert sorted(p.rsplit("/", 1)[-1] for p, _ in some.errors) == [".h.txt", "_x.txt"]


def test_shared_folder_on_a_cluster(monkeypatch, spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_pages(spark):
    rows = spark.createDataFrame([(f"e{i:04d}@x.org", f"e{i:04d}", "x.org", "p") for i in range(2500)], RECORD)
    sizes = {p: (lambda r: (r.page, r.pages, len(r.results), r.count))(results.handle_paged(rows, QuerySet(domain="x.org", page=p))) for p in (-1, 0, 999)}
    assert sizes == {-1: (1, 2, 1000, 2500), 0: (0, 2, 1000, 2500), 999: (2, 2, 500, 2500)}
    none = results.handle_paged(rows, QuerySet(domain="y.org"))
    assert none == ResultSet(0, -1, -1, [])
    assert results.page_window(1000, 5) == (0, 0) and results.page_window(1001, -5) == (1, 1)


def test_routing_and_answers(people):
    q = QuerySet("e", "d", "u")
    assert results.route(q, results.PLAIN_ORDER) == ("email", "e") and results.route(q, results.PAGED_ORDER) == ("domain", "d")
    status, body = results.answer(people, b'{"email": "foo@bar.com"}')
    assert status == 200 and json.loads(body) == {"count": 1, "page": 0, "pages": 1, "results": [{"email": "foo@bar.com", "password": "hunter2"}]}
    assert results.answer(people, b"{}")[0] == results.answer(people, b"nope")[0] == results.answer(people, b"[]", True)[0] == 400
    assert json.loads(results.result_json(search.query_all(people, "user", "foo")).first()[0]) == json.loads(body)


def test_output(spark, people, tmp_path):
    rows = people.where("domain = 'd1.org'").select("email", "password")
    assert {r.password for r in results.shown(rows, True, True).collect()} == {"pw"}
    with pytest.raises(ValueError):
        results.save_lines(rows, True, True)
    results.save(rows, str(tmp_path / "s"), email_only=True)
    results.save(rows, str(tmp_path / "s"), password_only=True)
    assert text.read_raw(spark, str(tmp_path / "s")).count() == 2 * rows.count()
    numbers = results.numbered(rows).orderBy("row").collect()
    assert [r.row for r in numbers] == list(range(1, len(numbers) + 1)) and [r.email for r in numbers] == sorted(r.email for r in numbers)
    one = results.handle(people, QuerySet(domain="d1.org"))
    shown = results.table_text(one, True, True)
    assert shown.startswith("1 ") and shown.endswith(f"Displaying page 1 of 2 ({one.count} total results)")
    assert results.table_text(one, True, True, password_only=True) == "\n".join(["pw"] * 3) or "pw" in results.table_text(one, True, True, password_only=True)
    assert results.table_text(ResultSet(0, 0, 1)) == "No results for query"


def test_whole_run_and_command_line(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_text("\n".join(f"{e}:{p}" for e, _, _, p in PEOPLE * 2))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("normalize", raw, "--output", tmp_path / "json", "--skip-suffix", ".log")
    run("auto", tmp_path / "json", "--output", tmp_path / "made", "--keys", "email,domain")
    made_ = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert got(spark.read.parquet(made_["records"])) == sorted(PEOPLE)
    run("search", made_["lookups"]["domain"], "domain", "bar.com", "--json", "--save", tmp_path / "saved")
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["count"] == 2 and text.read_raw(spark, str(tmp_path / "saved")).count() == 2
    run("dedup", tmp_path / "json", "--output", tmp_path / "distinct", "--save", tmp_path / "seen")
    run("dedup", tmp_path / "json", "--output", tmp_path / "again", "--seen", tmp_path / "seen")
    run("index", tmp_path / "distinct", "--output", tmp_path / "index", "--key", "user")
    assert index.read_lookup(spark, str(tmp_path / "index")).count() == 3 and text.read_raw(spark, str(tmp_path / "again")).count() == 0
    assert run("version") == 0 and run("template") == 0
    with pytest.raises(ValueError):
        pipeline.lookup(spark, pipeline.Curated("r", {}), "email")
    with pytest.raises(ValueError):
        pipeline.curate(spark, pipeline.Curation("a", "b", ("password",)))


@pytest.mark.skipif(not shutil.which("openssl"), reason="openssl makes the certificate")
def test_tls(people, tmp_path):
    key, certificate = str(tmp_path / "key.pem"), str(tmp_path / "cert.pem")
    subprocess.run(["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", key, "-out", certificate, "-days", "1", "-subj", "/CN=localhost"], check=True, capture_output=True)
    server = made(people, port=0, certificate=certificate, private_key=key)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"https://127.0.0.1:{server.server_address[1]}/"
    assert Client(url, verify=False).query(QuerySet(user="foo"))["count"] == 1
    with pytest.raises(urllib.error.URLError, match="(?i)certificate"):
        Client(url).query(QuerySet(user="foo"))
    server.shutdown()


def test_proxy_and_client_command(people, tmp_path, capsys):
    server = made(people, port=0)
    seen = []

    class Forward(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, self.headers["x-api-key"]))
            with urllib.request.urlopen(urllib.request.Request(self.path, body, method="POST")) as found:
                data = found.read()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    proxy = ThreadingHTTPServer(("127.0.0.1", 0), Forward)
    for s in (server, proxy):
        threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/"
    through = f"http://127.0.0.1:{proxy.server_address[1]}"
    assert cli.main(["query", "domain", "d1.org", "--url", url, "--proxy", through, "--token", "t", "--timeout", "20", "--no-empty", "--no-hashes", "--password-only", "--save", str(tmp_path / "out")]) == 0
    assert seen == [(url, "t")]
    wanted = ["pw"] * people.where("domain = 'd1.org' and password = 'pw'").count()
    assert capsys.readouterr().out.split() == wanted and (tmp_path / "out").read_text().split() == wanted
    assert cli.main(["query", "user", "foo", "--url", url, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["results"] == [{"email": "foo@bar.com", "password": "hunter2"}]
    for s in (server, proxy):
        s.shutdown()


def test_server_and_client(people):
    for paged in (False, True):
        server = made(people, port=0, paged=paged)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_address[1]}/"
        client = Client(url, token="t")
        assert client.query(QuerySet(user="foo"))["results"] == [{"email": "foo@bar.com", "password": "hunter2"}]
        with pytest.raises(ValueError, match="status 400"):
            client.query(QuerySet())
        if paged:
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(url)
        server.shutdown()


def test_plain_server_answers_whole(spark):
    """Beyond 100,000 results too, in the total order; without results as well."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    email = F.concat(F.lit("u"), F.lpad((F.col("id") * 7919 % 100_003).cast("string"), 6, "0"), F.lit("@x.org"))
    server = made(spark.range(100_003).select(email.alias("email"), F.lit("u").alias("user"), F.lit("x.org").alias("domain"), F.lit('"é').alias("password")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = Client(f"http://127.0.0.1:{server.server_address[1]}/")
    try:
        found = client.query(QuerySet(domain="x.org"))
        assert client.query(QuerySet(domain="y.org")) == {"count": 0, "page": 0, "pages": 1, "results": []}
    finally:
        server.shutdown()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert (found["count"], found["page"], found["pages"]) == (100_003, 0, 1)
    assert found["results"] == [{"email": f"u{i:06d}@x.org", "password": '"é'} for i in range(100_003)]


def test_places_in_files_that_are_split(spark, tmp_path):
    path = str(tmp_path / "sorted")
    rows = spark.range(40000).select((F.col("id") * 7919 % 40009).alias("digest"), F.col("id").alias("offset"))
    index.sort_index(rows, 3).write.option("parquet.block.size", 1024).option("parquet.page.row.count.limit", 500).option("parquet.block.row.count.limit", 1000).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() > 3
        found = got(pipeline.placed(spark, path).select("place", "digest"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == list(enumerate(sorted(i * 7919 % 40009 for i in range(40000)), 1))


def test_few_and_many_hits_of_a_stored_index(spark, tmp_path):
    lines_, parts, path = (str(tmp_path / x) for x in ("lines", "parts", "sorted"))
    rows = [(json.dumps({"email": f"u{i}@d{i % 3}.org", "user": f"u{i}", "domain": f"d{i % 3}.org", "password": str(i)}),) for i in range(60)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(lines_)
    pipeline.offsets_stage(spark, lines_, parts, "domain")
    pipeline.sort_stage(spark, parts, path, 2)
    few, many = (search.search_stored(spark, path, lines_, "domain", "d1.org", most=n) for n in (100, 5))
    assert got(few) == got(many) and got(many.select("password")) == sorted((str(i),) for i in range(1, 60, 3))
    tree = many._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" not in tree[tree.index("Join Inner") + tree[tree.index("Join Inner"):].index("\n") :]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate((["a@b.co:1", "a@b.co:1", "b@b.co:2"], ["b@b.co:2", "c@b.co:3", ""])):
        (folder / f"{k}.txt").write_text("\n".join(batch))
        incremental.start(incremental.arriving_lines(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state"), "colon-newline").awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "out")).select("email")) == [("a@b.co",), ("b@b.co",), ("c@b.co",)]


def test_shared_tables_can_be_cleared(spark):
    rows = shared.materialize(spark.range(5), "numbers")
    assert rows.count() == 5 and shared.clear(spark) >= 1
    with pytest.raises(Exception, match="(?i)exist"):
        rows.collect()
