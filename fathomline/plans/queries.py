"""Every operator as a registered query over the star-schema tables, with the same in SQL.

The tables hold no delimited records, so raw lines are derived from orders, customer and nation:
an address made of the customer's and the nation's name, one of three delimiters, and a value that
is empty, a placeholder, holds the delimiter, is a hash, or is plain. Source and sink queries write
the lines to the shared folder in the form under test and read them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import exprs as E
from fathomline.operators import dedup, formats, index, results, search
from fathomline.plans import pipeline
from fathomline.plans.progress import Progress
from fathomline.schema import FIELDS, QuerySet, ResultSet
from fathomline.shared import materialize, shared_path
from fathomline.sources import files, text
from fathomline.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


_LINE = """concat(replace(c_name, '#', '.'), '@', replace(n_name, '_', '-'), '.example.com',
  case when o_orderkey % 11 = 0 then ';' when o_orderkey % 13 = 0 then '  ' else ':' end,
  case when o_orderkey % 7 = 0 then '' when o_orderkey % 5 = 0 then 'xxx' when o_orderkey % 17 = 0 then 'a:b'
    when o_orderkey % 19 = 0 then {hash}(cast(o_orderkey as string){bits}) else concat('pw', cast(o_orderkey % 10 as string)) end)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, line): nation is a fixed small table; customer is joined as its size commands."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("line_id"), F.expr(_LINE.format(hash="sha2", bits=", 256")).alias("line"))


def records(spark: SparkSession, sf: str, format: str = "colon-newline") -> DataFrame:
    return formats.normalize(lines(spark, sf), format, keep=("line_id",))


def _text(df: DataFrame, label: str, column: str = "line", parts: int | None = None) -> str:
    path = shared_path(df.sparkSession, label)
    out = df.select(F.col(column).alias("value"))
    (out.coalesce(parts) if parts else out).write.text(path)
    return path


_SPACE = r"'^[\s\x{00a0}]+|[\s\x{00a0}]+$'"
L = f"lines as (select o_orderkey as line_id, {_LINE.format(hash='sha256', bits='')} as line from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"
T = L + f", t as (select line_id, regexp_replace(line, {_SPACE}, '', 'g') as t from lines)"
# The address pattern and, below, the shapes of hashed values, as the engine has them.
_ADDRESS = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]{2,63}"


def _records_sql(delimiter: str, strict: bool = True) -> str:
    gate = f"regexp_matches(t, '{_ADDRESS}{delimiter}')"
    pieces = r"regexp_split_to_array(t, '\s+')" if "[" in delimiter else f"string_split(t, '{delimiter}')"
    value = "p[2]" if strict else "array_to_string(p[2:], '')"
    more = " and len(p) = 2" if strict else ""
    return f"""rec as (select line_id, lower(p[1]) as email, string_split(lower(p[1]), '@')[1] as "user", string_split(lower(p[1]), '@')[2] as domain, {value} as password
from (select line_id, t, {pieces} as p from t) where {gate}{more})"""


R = T + ", " + _records_sql(":")
_FOUR = 'email, "user", domain, password'
_DIGEST = "cast(concat('0x', substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) as bigint)"


def _digest_sql(c: str) -> str:
    return _DIGEST.replace("h,", f"sha256({c}),")


_HASHED = """(strlen(password) >= 8 and ((regexp_matches(password, '^[0-9a-fA-F]+$') and strlen(password) >= 32)
  or (regexp_matches(password, '^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$') and strlen(password) >= 22)))"""

# ---------------------------------------------------------------- flagship


@_query("pipeline_flagship", f"with {R} select distinct email, password from rec where domain = 'nation-3.example.com'")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines to distinct records of one domain."""
    return search.search_domain(dedup.dedup_records(records(spark, sf)), "nation-3.example.com").select("email", "password")


# ---------------------------------------------------------------- 2.A sources

_TRIMMED = f"with {T} select t as line from t where length(t) > 0"


@_query("src_text_file", _TRIMMED)
def src_text_file(spark: SparkSession, sf: str) -> DataFrame:
    return text.read_lines(spark, _text(lines(spark, sf), "text", parts=1)).select("line")


@_query("src_text_dir", _TRIMMED)
def src_text_dir(spark: SparkSession, sf: str) -> DataFrame:
    path = _text(lines(spark, sf), "dir")
    lines(spark, sf).select(F.lit("not read").alias("value")).write.text(f"{path}/inner")
    return text.read_lines(spark, path).select("line")


@_query("src_text_dir_recursive", f"with {T} select t as line from t union all select t as line from t")
def src_text_dir_recursive(spark: SparkSession, sf: str) -> DataFrame:
    path = _text(lines(spark, sf), "tree")
    lines(spark, sf).select(F.col("line").alias("value")).write.text(f"{path}/inner")
    return text.read_lines(spark, path, recursive=True).select("line")


def _two_kinds(spark: SparkSession, sf: str) -> str:
    """A folder whose files are text and JSON files of the same lines."""
    path = _text(lines(spark, sf), "kinds")
    records(spark, sf).select(E.record_json().alias("j")).write.mode("append").json(path)
    return path


def _two_prefixes(spark: SparkSession, sf: str) -> str:
    """A folder whose files begin with even- and odd-, by the lines that they have."""
    path = shared_path(spark, "prefixes")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for half, name in enumerate(("even", "odd")):
        at = _text(lines(spark, sf).where(f"line_id % 2 = {half}"), name)
        fs = fs_path(at).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(fs_path(path))
        for status in fs.listStatus(fs_path(at)):
            if status.getPath().getName().startswith("part-"):
                fs.rename(status.getPath(), fs_path(f"{path}/{name}-{status.getPath().getName()}"))
    return path


@_query("src_queue_skip_prefix", f"with {T} select t as line from t where line_id % 2 = 0")
def src_queue_skip_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return text.read_lines(spark, _two_prefixes(spark, sf), skip_prefix="odd-").select("line")


@_query("src_queue_skip_suffix", _TRIMMED)
def src_queue_skip_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return text.read_lines(spark, _two_kinds(spark, sf), skip_suffix=".json").select("line")


@_query("src_multi_error_collect", f"with {T} select t as line, cast(1 as int) as errors from t")
def src_multi_error_collect(spark: SparkSession, sf: str) -> DataFrame:
    good = _text(lines(spark, sf), "good")
    found = text.read_collecting_errors(spark, [good, good + "-missing"])
    return found.lines.select("line", F.lit(len(found.errors)).alias("errors"))


def _json_path(spark: SparkSession, sf: str, label: str, **options) -> str:
    path = shared_path(spark, label)
    files.write_records(records(spark, sf), path, **options)
    return path


@_query("src_jsonl_lines", f"with {R} select cast(to_json({{'email': email, 'user': \"user\", 'domain': domain, 'password': password}}) as varchar) as line from rec")
def src_jsonl_lines(spark: SparkSession, sf: str) -> DataFrame:
    return text.read_lines(spark, _json_path(spark, sf, "jsonl")).select("line")


# good, odd and broken JSON lines of the records, by the line's number
_ODD_JSON = """case line_id % 9 when 0 then j when 1 then replace(j, '"email"', '"Email"') when 2 then concat(j, ' trailing')
  when 3 then replace(j, '"email":"', '"email":5,"was":"') when 4 then replace(j, '"user":"', '"user":{"x":1},"was":"') when 5 then substr(j, 1, length(j) - 1)
  when 6 then replace(j, '"password"', '"pass"') when 7 then replace(j, '"domain":"', '"domain":null,"was":"') else concat('[', j, ']') end"""
_JSON = "to_json({'email': email, 'user': \"user\", 'domain': domain, 'password': password})"


def _odd_json(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, line): records as JSON, of which many are odd or broken."""
    return records(spark, sf).select("line_id", E.record_json().alias("j")).select("line_id", F.expr(_ODD_JSON).alias("line"))


def _decoded_sql(keep: str) -> str:
    own = lambda f: f"""coalesce(case when l is null or json_type(l) <> 'OBJECT' then '' when json_type(l, '$.{f}') = 'VARCHAR' then json_extract_string(l, '$.{f}')
 when json_type(l, '$.{f.title()}') = 'VARCHAR' then json_extract_string(l, '$.{f.title()}') end, '') as "{f}\""""  # noqa: E731
    return f"with {R}, x as (select line_id, {_ODD_JSON} as x from (select line_id, cast({_JSON} as varchar) as j from rec)), o as (select line_id, case when json_valid(x) then x end as l from x) select {keep}{', '.join(own(f) for f in FIELDS)} from o"


@_query("src_jsonl_records", _decoded_sql(""))
def src_jsonl_records(spark: SparkSession, sf: str) -> DataFrame:
    return text.read_records(spark, _text(_odd_json(spark, sf), "odd-json"))


@_query("src_split_ranges", f"with {L} select cast(count(*) as bigint) as lines, cast(sum(strlen(line) + 1) as bigint) as bytes, cast(0 as bigint) as overlaps, cast(0 as bigint) as gaps from lines")
def src_split_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges of several files: their lines and bytes, and where a range begins before or after the end of the one before."""
    ranges = text.splits(spark, _text(lines(spark, sf), "splits"))
    before = F.coalesce(F.lag(F.col("start") + F.col("length")).over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    each = ranges.select("lines", "length", "start", before.alias("end"))
    return each.agg(F.sum("lines").alias("lines"), F.sum("length").alias("bytes"), F.count_if(F.col("start") < F.col("end")).alias("overlaps"), F.count_if(F.col("start") > F.col("end")).alias("gaps"))


@_query("src_line_offset", f"with {L}, o as (select line_id, line, strlen(line) + 1 as n from lines) select cast(coalesce(sum(n) over (order by line_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", line from o")
def src_line_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets in one file of the lines by id; the file is written by one task, as an offset is a place in one file."""
    return text.read_with_offsets(spark, _text(lines(spark, sf).orderBy("line_id").coalesce(1), "offsets")).select("offset", "line")


def _index(spark: SparkSession, sf: str, key: str = "email") -> DataFrame:
    return index.index_build(records(spark, sf), key, offset="line_id")


_INDEX = f"select {_digest_sql('email')} as digest, line_id as \"offset\" from rec"


@_query("src_index_entries", f"with {R} {_INDEX}")
def src_index_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries through their twelve-byte form."""
    entries = materialize(files.entry_bytes(_index(spark, sf)), "entries")
    h = F.lower(F.hex("entry"))
    return entries.select(E.le_decode48(F.substring(h, 1, 12)).alias("digest"), E.le_decode48(F.substring(h, 13, 12)).alias("offset"))


#: A user that has records, and the address that comes first among all (as SQL, and fetched from the records).
_USER = "customer.000000007"
_FIRST = "(select min(email) from rec)"


def _first(spark: SparkSession, sf: str) -> str:
    return records(spark, sf).agg(F.min("email")).first()[0] or ""


@_query("src_point_read", f"with {R} select {_FOUR} from rec where line_id = (select min(line_id) from rec)")
def src_point_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    return rows.join(rows.agg(F.min("line_id").alias("line_id")), "line_id").select(*FIELDS)


@_query("src_bigquery", f"with {R} select email, password from rec where domain = 'nation-5.example.com'")
def src_bigquery(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_sql(records(spark, sf), "domain", "nation-5.example.com")


@_query("src_http_query", f"with {R} select email, password from rec where domain = 'nation-1.example.com'")
def src_http_query(spark: SparkSession, sf: str) -> DataFrame:
    key, value = results.route(QuerySet.from_json({"Domain": "nation-1.example.com", "page": 2}), results.PLAIN_ORDER)
    return search.query_all(records(spark, sf), key, value)


@_query("src_py_scanner", _TRIMMED)
def src_py_scanner(spark: SparkSession, sf: str) -> DataFrame:
    return text.read_lines(spark, _two_kinds(spark, sf), recursive=True, skip_suffix=".json", skip_prefix="_none").select("line")


@_query("src_py_lines", f"with {T} select line_id, t as line from t")
def src_py_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("line_id", E.utrim(F.col("line")).alias("line")).where(F.length("line") > 0)


# ---------------------------------------------------------------- 2.B sinks


@_query("sink_jsonl_append", f"with {R} select {_FOUR}, cast(2 * count(*) as bigint) as times from rec group by {_FOUR}")
def sink_jsonl_append(spark: SparkSession, sf: str) -> DataFrame:
    """Written twice, read once."""
    path = _json_path(spark, sf, "append")
    files.write_records(records(spark, sf), path)
    return text.read_records(spark, path).groupBy(*FIELDS).agg(F.count("*").alias("times"))


_SPACED = "concat('{\"email\": \"', email, '\", \"user\": \"', \"user\", '\", \"domain\": \"', domain, '\", \"password\": \"', password, '\"}')"


@_query("sink_jsonl_py", f"with {T}, {_records_sql(':', strict=False)} select {_SPACED} as line from rec")
def sink_jsonl_py(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "spaced")
    for _ in range(2):  # the second write replaces the first
        files.write_records_spaced(records(spark, sf, "colon"), path)
    return text.read_lines(spark, path).select("line")


_DISTINCT = f"with {T} select distinct t as line from t where length(t) > 0"


@_query("sink_dedup_create", _DISTINCT)
def sink_dedup_create(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "created")
    dedup.write_dedup(lines(spark, sf), path)
    return text.read_lines(spark, path).select("line")


@_query("sink_dedup_append", f"with {T}, d as (select distinct t as line from t) select line, cast(2 as bigint) as times from d")
def sink_dedup_append(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "added")
    for _ in range(2):
        dedup.write_dedup(lines(spark, sf), path, append=True)
    return text.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("times"))


@_query("sink_index_partial", f"with {R} {_INDEX}")
def sink_index_partial(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "parts")
    files.write_index_parts(_index(spark, sf), path)
    return spark.read.parquet(path)


@_query("sink_index_merge", f"with {R} {_INDEX}")
def sink_index_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts, path = shared_path(spark, "parts"), shared_path(spark, "merged")
    files.write_index_parts(_index(spark, sf), parts)
    files.merge_index(spark, parts, path)
    return spark.read.parquet(path)


@_query("sink_tape", f"with {R} {_INDEX}")
def sink_tape(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted runs, written and read back."""
    return materialize(index.sort_runs(_index(spark, sf)), "runs")


@_query("sink_sorted_index", f"with {R} {_INDEX}")
def sink_sorted_index(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "sorted")
    files.write_sorted_index(_index(spark, sf), path, 8)
    return spark.read.parquet(path)


_EARLY = f"with {T}, e as (select distinct t as line from t where line_id % 2 = 0)"


@_query("sink_filter_save", _DISTINCT)
def sink_filter_save(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "seen")
    dedup.save_seen(lines(spark, sf), path)
    return spark.read.parquet(path)


@_query("src_filter_load", f"{_EARLY} select distinct t as line from t where t not in (select line from e)")
def src_filter_load(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "seen")
    rows = lines(spark, sf)
    dedup.save_seen(rows.where("line_id % 2 = 0"), path)
    return dedup.dedup_incremental(rows, spark.read.parquet(path))


_D = "nation-3.example.com"
_HITS = f"hits as (select email, password from rec where domain = '{_D}')"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.query_all(records(spark, sf), "domain", _D)


@_query(
    "sink_http_result",
    f"""with {R}, {_HITS} select concat('{{"count":', count(*), ',"page":0,"pages":1,"results":[',
coalesce(string_agg(concat('{{"email":"', email, '","password":"', password, '"}}'), ',' order by email, password), ''), ']}}') as body from hits""",
)
def sink_http_result(spark: SparkSession, sf: str) -> DataFrame:
    return results.result_json(_hits(spark, sf))


@_query("sink_lambda_result", f"with {R}, {_HITS}, n as (select count(*) as c from hits) select cast(200 as int) as status, cast(c as bigint) as count, cast(least(1, ceil(c / 1000.0) - 1) as bigint) as page from n")
def sink_lambda_result(spark: SparkSession, sf: str) -> DataFrame:
    status, body = results.answer(records(spark, sf), f'{{"domain": "{_D}", "page": 1}}', paged_mode=True)
    one = spark.createDataFrame([(status, body)], "status int, body string")
    return one.select("status", F.get_json_object("body", "$.count").cast("long").alias("count"), F.get_json_object("body", "$.page").cast("long").alias("page"))


_SHOWN = f"shown as (select email, password from hits where password not in ('', 'xxx') and not {_HASHED})"


@_query("sink_client_save", f"with {R}, {_HITS}, {_SHOWN} select concat(email, ':', password) as line from shown")
def sink_client_save(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "saved")
    results.save(results.shown(_hits(spark, sf), no_blank=True, no_hashes=True), path)
    return text.read_lines(spark, path).select("line")


@_query("sink_display", f"with {R}, {_HITS}, {_SHOWN} select row_number() over (order by email, password) as row, email, password from shown")
def sink_display(spark: SparkSession, sf: str) -> DataFrame:
    return results.numbered(results.shown(_hits(spark, sf), no_blank=True, no_hashes=True))


@_query("sink_search_print", f"with {R} select {_FOUR} from rec where domain = '{_D}'")
def sink_search_print(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_domain(records(spark, sf), _D).select(*FIELDS)


@_query("sink_conf_template", "select * from (values ('input', ''), ('keys', 'user,email'), ('output', ''), ('partitions', ''), ('recursive', 'False')) as v(name, value)")
def sink_conf_template(spark: SparkSession, sf: str) -> DataFrame:
    made = pipeline.Curation.template()
    shown = {k: ",".join(v) if isinstance(v, tuple) else "" if v is None else str(v) for k, v in made.items()}
    return spark.createDataFrame(sorted(shown.items()), "name string, value string")


# ---------------------------------------------------------------- 2.C formats and projections

for _name, _format, _delimiter, _strict in (
    ("fmt_colon", "colon-newline", ":", True),
    ("fmt_semicolon", "semicolon-newline", ";", True),
    ("fmt_whitespace", "whitespace-newline", "[ \t]+", True),
    ("fmt_colon_py", "colon", ":", False),
    ("fmt_semicolon_py", "semicolon", ";", False),
    ("fmt_whitespace_py", "whitespace", "[ \t]+", False),
):
    _query(_name, f"with {T}, {_records_sql(_delimiter, _strict)} select line_id, {_FOUR} from rec")(lambda spark, sf, f=_format: records(spark, sf, f))


@_query("fmt_interface", f"with {T} select line_id, lower(split_part(t, ';', 1)) as email from t where regexp_matches(t, '{_ADDRESS};')")
def fmt_interface(spark: SparkSession, sf: str) -> DataFrame:
    """A format of one's own, given as an object."""
    own = formats.Format("own", formats.ADDRESS + ";", lambda line: F.split(line, ";", -1), strict=False)
    return formats.normalize(lines(spark, sf), own, keep=("line_id",)).select("line_id", "email")


@_query("fmt_registry", "select unnest(['colon', 'colon-newline', 'semicolon', 'semicolon-newline', 'whitespace', 'whitespace-newline']) as name")
def fmt_registry(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in formats.supported()], "name string")


@_query("proj_user_domain", f'with {R} select email, "user", domain from rec')
def proj_user_domain(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("email", "user", "domain")


@_query("proj_key", f'with {R} select line_id, "user" as key from rec')
def proj_key(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("line_id", F.col("user").alias("key"))


@_query("proj_result", f"with {R} select email, password from rec")
def proj_result(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("email", "password")


@_query("proj_email_only", f"with {R}, {_HITS} select email as value from hits")
def proj_email_only(spark: SparkSession, sf: str) -> DataFrame:
    return results.save_lines(_hits(spark, sf), email_only=True)


@_query("proj_password_only", f"with {R}, {_HITS} select password as value from hits")
def proj_password_only(spark: SparkSession, sf: str) -> DataFrame:
    return results.save_lines(_hits(spark, sf), password_only=True)


@_query("proj_save_line", f"with {R}, {_HITS} select concat(email, ':', password) as value from hits")
def proj_save_line(spark: SparkSession, sf: str) -> DataFrame:
    return results.save_lines(_hits(spark, sf))


# ---------------------------------------------------------------- 2.D filters

_ODD = """odd as (select line_id, case when line_id % 3 = 0 then concat(' ', chr(160), chr(9)) when line_id % 3 = 1 then concat(chr(160), line, chr(13)) else line end as line from lines)"""


def _odd(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of which some are blank and some have white space around them."""
    return lines(spark, sf).withColumn("line", F.expr("case when line_id % 3 = 0 then concat(' ', char(160), char(9)) when line_id % 3 = 1 then concat(char(160), line, char(13)) else line end"))


_ODD_TRIM = f"regexp_replace(line, {_SPACE}, '', 'g')"


@_query("flt_blank_line", f"with {L}, {_ODD} select line_id, {_ODD_TRIM} as line from odd where length({_ODD_TRIM}) > 0")
def flt_blank_line(spark: SparkSession, sf: str) -> DataFrame:
    return _odd(spark, sf).select("line_id", E.utrim(F.col("line")).alias("line")).where(F.length("line") > 0)


@_query("flt_pattern", f"with {T} select line_id from t where regexp_matches(t, '{_ADDRESS}:')")
def flt_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(E.utrim(F.col("line")).rlike(formats.COLON.pattern)).select("line_id")


@_query("flt_field_count", f"with {T} select line_id from t where len(string_split(t, ':')) = 2")
def flt_field_count(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(F.size(formats.COLON.pieces(E.utrim(F.col("line")))) == 2).select("line_id")


for _key, _value in (("user", _USER), ("domain", _D), ("password", "pw3")):
    _query(f"flt_eq_{_key}", f"with {R} select line_id, {_FOUR} from rec where \"{_key}\" = '{_value}'")(lambda spark, sf, k=_key, v=_value: search.search(records(spark, sf), k, v))


@_query("flt_eq_email", f"with {R} select line_id, {_FOUR} from rec where email = {_FIRST}")
def flt_eq_email(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(records(spark, sf), "email", _first(spark, sf))


@_query("flt_not_blank_pw", f"with {R} select line_id, password from rec where password not in ('', 'xxx')")
def flt_not_blank_pw(spark: SparkSession, sf: str) -> DataFrame:
    return results.shown(records(spark, sf), no_blank=True).select("line_id", "password")


@_query("flt_not_hash_pw", f"with {R} select line_id, password from rec where not {_HASHED}")
def flt_not_hash_pw(spark: SparkSession, sf: str) -> DataFrame:
    return results.shown(records(spark, sf), no_hashes=True).select("line_id", "password")


@_query("flt_file_affix", _TRIMMED)
def flt_file_affix(spark: SparkSession, sf: str) -> DataFrame:
    return text.read_lines(spark, _two_kinds(spark, sf), skip_suffix=".json", skip_prefix="#").select("line")


@_query("flt_valid_key", "select * from (values ('domain', true), ('email', true), ('password', false), ('user', true)) as v(key, valid)")
def flt_valid_key(spark: SparkSession, sf: str) -> DataFrame:
    from fathomline.schema import KEYS

    return spark.createDataFrame([(k, k in KEYS) for k in sorted(FIELDS)], "key string, valid boolean")


def _routed(spark: SparkSession, order: tuple[str, ...]) -> DataFrame:
    out = []
    for i in range(1, 8):
        q = QuerySet(**{k: k for b, k in enumerate(("email", "user", "domain")) if i >> b & 1})
        out.append((i, results.route(q, order)[0]))
    return spark.createDataFrame(out, "filled int, key string")


_ROUTE = "select cast(i as int) as filled, case {} end as key from range(1, 8) t(i)"


@_query("flt_route_server", _ROUTE.format("when i % 2 = 1 then 'email' when (i // 2) % 2 = 1 then 'user' else 'domain'"))
def flt_route_server(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, results.PLAIN_ORDER)


@_query("flt_route_lambda", _ROUTE.format("when i // 4 = 1 then 'domain' when i % 2 = 1 then 'email' else 'user'"))
def flt_route_lambda(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, results.PAGED_ORDER)


# ---------------------------------------------------------------- 2.E de-duplication


@_query("dedup_bloom", _DISTINCT)
def dedup_bloom(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_lines(lines(spark, sf))


@_query("dedup_documents", "select distinct trim(text) as line from documents where length(trim(text)) > 0")
def dedup_documents(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_lines(table(spark, sf, "documents").select(F.col("text").alias("line")))


@_query("dedup_records", f"with {R} select distinct {_FOUR} from rec")
def dedup_records(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_records(records(spark, sf))


@_query("dedup_incremental", f"with {T}, e as (select distinct t as line from t where line_id % 3 = 0) select distinct t as line from t where line_id % 3 > 0 and t not in (select line from e)")
def dedup_incremental(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf)
    return dedup.dedup_incremental(rows.where("line_id % 3 > 0"), dedup.dedup_lines(rows.where("line_id % 3 = 0")))


@_query("dedup_progress", f"with {T} select cast(count(*) as bigint) as total, cast(count(distinct t) as bigint) as uniques, cast(count(*) - count(distinct t) as bigint) as duplicates from t where length(t) > 0")
def dedup_progress(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_stats(lines(spark, sf))


@_query("dedup_stream", _DISTINCT)
def dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The lines come in two batches of files; the second run goes on from the first one's state."""
    folder, out, state = (shared_path(spark, x) for x in ("arriving", "stream", "state"))
    for half in (0, 1):
        lines(spark, sf).where(f"line_id % 2 = {half}").select(F.col("line").alias("value")).write.mode("append").text(folder)
        incremental.start(incremental.arriving_lines(spark, folder), out, state).awaitTermination()
    return spark.read.parquet(out)


# ---------------------------------------------------------------- 2.F indexing and sorting

for _key in ("email", "user", "domain"):
    _query(f"index_build_{_key}", f"with {R} " + _INDEX.replace("sha256(email)", f'sha256("{_key}")'))(lambda spark, sf, k=_key: _index(spark, sf, k))


@_query("index_build", f"with {R} select key, count(*) as entries, cast(sum(digest % 1000003) as bigint) as digests from (" + " union all ".join(f"select '{k}' as key, {_digest_sql(chr(34) + k + chr(34))} as digest from rec" for k in ("email", "user", "domain", "password")) + ") group by key")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """All four keys, each summed up."""
    each = [_index(spark, sf, k).select(F.lit(k).alias("key"), "digest") for k in ("email", "user", "domain", "password")]
    whole = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return whole.groupBy("key").agg(F.count("*").alias("entries"), F.sum(F.col("digest") % 1000003).alias("digests"))


@_query("index_count", f"with {R} select cast(count(*) as bigint) as entries from rec")
def index_count(spark: SparkSession, sf: str) -> DataFrame:
    return index.index_count(_index(spark, sf))


_PLACED = f"with {R}, i as ({_INDEX}) select row_number() over (order by digest, \"offset\") as place, digest, \"offset\" from i"


@_query("sort_external", _PLACED)
def sort_external(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted, written in ranges, and numbered by file and place: the order on disk."""
    path = shared_path(spark, "sorted")
    files.write_sorted_index(_index(spark, sf), path, 8)
    return pipeline.placed(spark, path)


@_query("sort_run", f"with {R} {_INDEX}")
def sort_run(spark: SparkSession, sf: str) -> DataFrame:
    return index.sort_runs(_index(spark, sf))


@_query("sort_tape_create", f"with {R} {_INDEX}")
def sort_tape_create(spark: SparkSession, sf: str) -> DataFrame:
    return index.sort_runs(_index(spark, sf).repartition(6))


_BUFFER = 4096


@_query("sort_tape_prefetch", f"""with {R}, i as ({_INDEX}), p as (select row_number() over (order by digest, \"offset\") - 1 as k, digest from i)
select cast(k // {_BUFFER} as bigint) as buffer, count(*) as entries, min(digest) as first, max(digest) as last from p group by 1""")
def sort_tape_prefetch(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted index as a reader takes it, buffer by buffer to its end."""
    return index.buffers(QUERIES["sort_external"](spark, sf), _BUFFER)


@_query("sort_tape_pop", _PLACED)
def sort_tape_pop(spark: SparkSession, sf: str) -> DataFrame:
    """Three stored runs, popped in one order."""
    whole, runs = _index(spark, sf), []
    for k in range(3):
        runs.append(materialize(index.sort_runs(whole.where(F.col("offset") % 3 == k)), "run"))
    path = shared_path(spark, "popped")
    index.merge_runs(runs, 8).write.parquet(path)
    return pipeline.placed(spark, path)


@_query("sort_kway_merge", f"with {R} {_INDEX} union all {_INDEX}")
def sort_kway_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two sorted datasets merged into one order."""
    runs = materialize(index.sort_runs(_index(spark, sf)), "runs")
    return index.sort_index(runs.unionByName(runs), partitions=8)


@_query("sort_check", f"with {R} select cast(count(*) as bigint) as entries, cast(0 as bigint) as inversions from rec")
def sort_check(spark: SparkSession, sf: str) -> DataFrame:
    placed = QUERIES["sort_external"](spark, sf)
    return index.sort_check(placed, "place")


@_query("sort_check_unsorted", f"with {R}, i as ({_INDEX}), b as (select digest, lag(digest) over (order by \"offset\") as before from i) select cast(count(*) as bigint) as entries, cast(count(*) filter (where before > digest) as bigint) as inversions from b")
def sort_check_unsorted(spark: SparkSession, sf: str) -> DataFrame:
    """By the order of the lines, which is none of digests."""
    return index.sort_check(_index(spark, sf), "offset")


@_query("sort_progress", f"with {R} select cast(count(*) as bigint) as entries, cast(count(*) as bigint) as written, 100.0 * count(*) / count(*) as merged from rec")
def sort_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What a sort stage read and wrote, by its own observed counts."""
    parts, path, progress = shared_path(spark, "parts"), shared_path(spark, "sorted"), Progress()
    files.write_index_parts(_index(spark, sf), parts)
    pipeline.sort_stage(spark, parts, path, 4, progress)
    return spark.createDataFrame([(progress.rows("sort: read"), progress.rows("sort: merged"), progress.share("sort: merged", "sort: read"))], "entries long, written long, merged double")


@_query(
    "progress_reporters",
    f"""with {T}, {_records_sql(':')}, c(point, n) as (select 'normalize: lines', count(*) from t where length(t) > 0 union all select 'normalize: records', count(*) from rec
union all select 'dedup: lines', count(*) from rec union all select 'dedup: new', count(*) from (select distinct {_FOUR} from rec)
union all select 'index: records', count(*) from (select distinct {_FOUR} from rec)) select point, cast(n as bigint) as rows from c""",
)
def progress_reporters(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that passed the points of three stages, observed as they ran."""
    json, distinct, lookup = (shared_path(spark, x) for x in ("json", "distinct", "lookup"))
    progress = Progress()
    pipeline.normalize_stage(spark, _text(lines(spark, sf), "raw"), json, "colon-newline", progress=progress)
    pipeline.dedup_stage(spark, json, distinct, progress=progress)
    pipeline.index_stage(spark, distinct, lookup, "email", progress=progress)
    return spark.createDataFrame([(point, counts["rows"]) for point, counts in progress.report().items()], "point string, rows long")


# ---------------------------------------------------------------- 2.G scalar functions

_FN: dict[str, tuple[Callable, str]] = {
    "fn_lower": (lambda: F.lower("line"), "lower(line)"),
    "fn_split": (lambda: F.to_json(F.split("line", ":", -1)), "to_json(string_split(line, ':'))::varchar"),
    "fn_fields": (lambda: F.to_json(E.fields(F.col("line"))), f"to_json(regexp_split_to_array(regexp_replace(line, {_SPACE}, '', 'g'), '\\s+'))::varchar"),
    "fn_regex": (lambda: F.col("line").rlike(formats.SEMICOLON.pattern), f"regexp_matches(line, '{_ADDRESS};')"),
    "fn_starts_ends_with": (lambda: F.col("line").startswith("Customer.00000001") & ~F.col("line").endswith("xxx"), "starts_with(line, 'Customer.00000001') and not ends_with(line, 'xxx')"),
    "fn_concat": (lambda: F.concat_ws("/", "line", F.col("line_id").cast("string")), "concat(line, '/', cast(line_id as varchar))"),
    "fn_join_pieces": (lambda: F.array_join(F.slice(F.split("line", ":", -1), F.lit(2), F.greatest(F.size(F.split("line", ":", -1)) - 1, F.lit(0))), ""), "array_to_string(string_split(line, ':')[2:], '')"),
    "fn_byte_len": (lambda: F.octet_length("line").cast("long"), "cast(strlen(line) as bigint)"),
    "fn_sha256": (lambda: F.sha2("line", 256), "sha256(line)"),
    "fn_digest48": (lambda: E.digest_hex(F.col("line")), "substr(sha256(line), 1, 12)"),
    "fn_le_decode48": (lambda: E.digest48(F.col("line")), _digest_sql("line")),
    "fn_le_encode48": (lambda: E.le_encode48(E.digest48(F.col("line"))), "substr(sha256(line), 1, 12)"),
    "fn_abs_ceil_clamp": (lambda: F.least(F.abs(F.col("line_id") - 5000), F.ceil(F.col("line_id") / 1000) - 1).cast("long"), "cast(least(abs(line_id - 5000), ceil(line_id / 1000.0) - 1) as bigint)"),
    "fn_ceil_div": (lambda: F.ceil(F.col("line_id") / 12).cast("long"), "cast((line_id + 11) // 12 as bigint)"),
    "fn_sprintf_q": (lambda: F.format_string("%s:%s", F.col("line_id"), F.col("line")), "concat(cast(line_id as varchar), ':', line)"),
}
for _name, (_expr, _sql) in _FN.items():
    _query(_name, f"with {L} select line_id, {_sql} as value from lines")(lambda spark, sf, e=_expr: lines(spark, sf).select("line_id", e().alias("value")))


@_query("fn_trim", f"with {L}, {_ODD} select line_id, {_ODD_TRIM} as value from odd")
def fn_trim(spark: SparkSession, sf: str) -> DataFrame:
    return _odd(spark, sf).select("line_id", E.utrim(F.col("line")).alias("value"))


@_query("fn_json_encode", f"with {R} select line_id, cast(to_json({{'email': email, 'user': \"user\", 'domain': domain, 'password': password}}) as varchar) as value from rec")
def fn_json_encode(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("line_id", E.record_json(html_safe=True).alias("value"))


@_query("fn_json_decode", _decoded_sql("line_id, "))
def fn_json_decode(spark: SparkSession, sf: str) -> DataFrame:
    d = E.decoded(F.col("line"))
    return _odd_json(spark, sf).select("line_id", d.alias("r")).select("line_id", *[F.col(f"r.{f}").alias(f) for f in FIELDS])


# ---------------------------------------------------------------- 2.H search


def _lookup(spark: SparkSession, sf: str, key: str) -> DataFrame:
    path = shared_path(spark, f"lookup-{key}")
    index.write_lookup(records(spark, sf), key, path)
    return index.read_lookup(spark, path)


def _stored(spark: SparkSession, sf: str, key: str) -> tuple[str, str]:
    """A sorted index of offsets and the file of JSON lines, ordered by id, that it tells of; both are on disk."""
    held = _text(records(spark, sf).orderBy("line_id").select(E.record_json().alias("line")).coalesce(1), "json")
    parts, path = shared_path(spark, "parts"), shared_path(spark, "sorted")
    pipeline.offsets_stage(spark, held, parts, key)
    pipeline.sort_stage(spark, parts, path, 8)
    return path, held


@_query("search_index", f"with {R} select {_FOUR} from rec where domain = '{_D}'")
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    """Many hits: the stored index's offsets, joined with the lines."""
    path, held = _stored(spark, sf, "domain")
    return search.search_stored(spark, path, held, "domain", _D, most=10).select(*FIELDS)


@_query("search_binary", f"with {R} select {_FOUR} from rec where email = {_FIRST}")
def search_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Through the sorted layout: both conditions reach the scan."""
    return search.search(_lookup(spark, sf, "email"), "email", _first(spark, sf)).select(*FIELDS)


@_query("search_run_expand", f"with {R} select {_FOUR} from rec where domain = '{_D}'")
def search_run_expand(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(_lookup(spark, sf, "domain"), "domain", _D).select(*FIELDS)


@_query("search_fetch", f"""with {R}, j as (select *, strlen(cast({_JSON} as varchar)) + 1 as n from rec),
o as (select *, cast(coalesce(sum(n) over (order by line_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from j) select "offset", {_FOUR} from o where "user" = '{_USER}'""")
def search_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Few hits: each line is read at its offset."""
    path, held = _stored(spark, sf, "user")
    return search.search_stored(spark, path, held, "user", _USER).select("offset", *FIELDS)


for _key, _value, _f in (("user", _USER, search.search_user), ("domain", _D, search.search_domain)):
    _query(f"search_{_key}", f"with {R} select {_FOUR} from rec where \"{_key}\" = '{_value}'")(lambda spark, sf, v=_value, f=_f: f(records(spark, sf), v).select(*FIELDS))


@_query("search_email", f"with {R} select {_FOUR} from rec where email = {_FIRST}")
def search_email(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_email(records(spark, sf), _first(spark, sf)).select(*FIELDS)


@_query("search_sql", f"with {R} select email, password from rec where email = {_FIRST}")
def search_sql(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_sql(records(spark, sf), "email", _first(spark, sf))


_VALUES = "values_ as (select lower(replace(c_name, '#', '.')) as value from customer where c_acctbal < 0)"


@_query("search_batch", f"with {R}, {_VALUES} select {_FOUR} from rec where \"user\" in (select value from values_)")
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "customer").where("c_acctbal < 0").select(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))).alias("value"))
    return search.search_batch(records(spark, sf), wanted, "user").select(*FIELDS)


# ---------------------------------------------------------------- 2.I counts and pages


@_query("agg_result_count", f"with {R}, {_HITS} select cast(count(*) as bigint) as count from hits")
def agg_result_count(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).agg(F.count("*").alias("count"))


@_query("agg_line_counter", f"with {T} select cast(count(*) as bigint) as lines, cast(1 as bigint) as files from t")
def agg_line_counter(spark: SparkSession, sf: str) -> DataFrame:
    counts = text.line_counts_by_file(text.read_lines(spark, _text(lines(spark, sf), "counted", parts=1)))
    return counts.agg(F.sum("lines").alias("lines"), F.count("*").alias("files"))


@_query("agg_unique_dup", "select cast(count(*) as bigint) as total, cast(count(distinct trim(text)) as bigint) as uniques, cast(count(*) - count(distinct trim(text)) as bigint) as duplicates from documents where length(trim(text)) > 0")
def agg_unique_dup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_stats(table(spark, sf, "documents").select(F.col("text").alias("line")))


@_query("agg_sum_workers", f"with {T} select cast(count(*) as bigint) as lines, cast(count(*) filter (where length(t) = 0) as bigint) as blank, cast(count(*) filter (where regexp_matches(t, '{_ADDRESS}:') and len(string_split(t, ':')) = 2) as bigint) as accepted, cast(count(*) filter (where length(t) > 0 and not (regexp_matches(t, '{_ADDRESS}:') and len(string_split(t, ':')) = 2)) as bigint) as rejected from t")
def agg_sum_workers(spark: SparkSession, sf: str) -> DataFrame:
    return formats.line_counts(lines(spark, sf), "colon-newline")


def _page_sql(page: int, size: int) -> str:
    return f"""with {R}, {_HITS}, n as (select greatest(0, least({page}, ceil(count(*) / {size}.0) - 1)) as p from hits)
select email, password from (select *, row_number() over (order by email, password) - 1 as i from hits) x, n where i >= p * {size} and i < (p + 1) * {size}"""


def _page(spark: SparkSession, sf: str, page: int, size: int) -> DataFrame:
    rows = _hits(spark, sf)
    number, _ = results.page_window(rows.count(), page, size)
    return results.paged(rows, number, size)


@_query("page_lambda", _page_sql(0, 1000))
def page_lambda(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, 0, results.PAGE_SIZE)


@_query("page_lambda_second", _page_sql(1, 50))
def page_lambda_second(spark: SparkSession, sf: str) -> DataFrame:
    """A negative page counts as positive."""
    return _page(spark, sf, -1, 50)


@_query("page_lambda_beyond", _page_sql(999999, 50))
def page_lambda_beyond(spark: SparkSession, sf: str) -> DataFrame:
    """A page beyond the last is the last."""
    return _page(spark, sf, 999999, 50)


@_query("page_server", f"with {R}, {_HITS} select email, password from hits")
def page_server(spark: SparkSession, sf: str) -> DataFrame:
    """Everything on one page."""
    return _hits(spark, sf)


@_query("page_footer", f"with {R}, {_HITS}, n as (select count(*) as c from hits) select concat('Displaying page ', least(2, ceil(c / 50.0))::bigint, ' of ', ceil(c / 50.0)::bigint, ' (', c, ' total results)') as line from n")
def page_footer(spark: SparkSession, sf: str) -> DataFrame:
    """The footer of the second page of 50, as the paged handler answers it."""
    found = results.handle_paged(records(spark, sf), QuerySet(domain=_D, page=1), size=50)
    return spark.createDataFrame([(results.footer(found),)], "line string")


@_query("row_number_display", f"with {R}, {_HITS} select row_number() over (order by email, password) as row, email, password from hits where password not in ('', 'xxx')")
def row_number_display(spark: SparkSession, sf: str) -> DataFrame:
    return results.numbered(results.shown(_hits(spark, sf), no_blank=True))


# ---------------------------------------------------------------- 2.K whole runs


def _curated(spark: SparkSession, sf: str) -> pipeline.Curated:
    return pipeline.curate(spark, pipeline.Curation(_json_path(spark, sf, "raw"), shared_path(spark, "curated"), ("email", "user", "domain")))


@_query("cli_auto", f"with {R}, d as (select distinct {_FOUR} from rec) select email, password from d where domain = '{_D}'")
def cli_auto(spark: SparkSession, sf: str) -> DataFrame:
    """Normalize, de-duplicate, index by three keys, and look one up."""
    return search.search_domain(pipeline.lookup(spark, _curated(spark, sf), "domain"), _D).select("email", "password")


@_query("stage_bloom", f"with {R} select distinct {_FOUR} from rec")
def stage_bloom(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_path(spark, "distinct")
    pipeline.dedup_stage(spark, _json_path(spark, sf, "raw"), out)
    return text.read_records(spark, out)


@_query("cli_bloom", f"with {T} select distinct t as line from t where line_id % 2 = 1 and t not in (select t from t where line_id % 2 = 0)")
def cli_bloom(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs; the second one leaves out what the first has saved."""
    one, two, first, second, seen = (shared_path(spark, x) for x in ("even", "odd", "out-even", "out-odd", "seen"))
    rows = lines(spark, sf)
    rows.where("line_id % 2 = 0").select(F.col("line").alias("value")).write.text(one)
    rows.where("line_id % 2 = 1").select(F.col("line").alias("value")).write.text(two)
    pipeline.dedup_stage(spark, one, first, save=seen)
    pipeline.dedup_stage(spark, two, second, seen=seen)
    return text.read_lines(spark, second).select("line")


@_query("stage_index", f"with {R} select {_digest_sql('email')} as digest_email, {_FOUR} from rec")
def stage_index(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_path(spark, "lookup")
    pipeline.index_stage(spark, _json_path(spark, sf, "raw"), out, "email")
    return index.read_lookup(spark, out)


@_query("stage_sort", f"with {R} select cast(count(*) as bigint) as entries, cast(0 as bigint) as inversions from rec")
def stage_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Stored parts, sorted by the stage, and checked in their order on disk."""
    parts, out = shared_path(spark, "parts"), shared_path(spark, "sorted")
    files.write_index_parts(_index(spark, sf), parts)
    pipeline.sort_stage(spark, parts, out, 8)
    return index.sort_check(pipeline.placed(spark, out), "place")


@_query("cli_normalize", f"with {T}, {_records_sql(';')} select {_FOUR} from rec")
def cli_normalize(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_path(spark, "normalized")
    pipeline.normalize_stage(spark, _text(lines(spark, sf), "raw"), out, "semicolon-newline", recursive=True, skip_prefix="#", skip_suffix=".idx")
    return text.read_records(spark, out)


_SQUASHED = {"colon": ":", "semicolon": ";", "whitespace": "[ \t]+"}


@_query("py_cli", f"with {T}, " + ", ".join(_records_sql(d, False).replace("rec as", f"{f} as", 1) for f, d in _SQUASHED.items()) + " " + " union all ".join(f"select {_FOUR} from {f}" for f in _SQUASHED))
def py_cli(spark: SparkSession, sf: str) -> DataFrame:
    """The command in the dialects that join further fields: each adds its records to one output."""
    from fathomline import cli

    raw, out = _text(lines(spark, sf), "raw"), shared_path(spark, "normalized")
    for format in _SQUASHED:
        cli.main(["normalize", raw, "--output", out, "--format", format, "--recursive", "--skip-prefix", "#", "--skip-suffix", ".idx"], spark)
    return text.read_records(spark, out)


@_query("cli_overwrite", f"with {T}, {_records_sql(';')} select {_FOUR} from rec")
def cli_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """The command line's normalize, twice into one output: the second run replaces the first."""
    from fathomline import cli

    out = shared_path(spark, "normalized")
    cli.main(["normalize", _text(lines(spark, sf), "raw"), "--output", out, "--format", "colon-newline"], spark)
    cli.main(["normalize", _text(lines(spark, sf), "raw"), "--output", out, "--format", "semicolon-newline", "--overwrite"], spark)
    return text.read_records(spark, out)


@_query("cli_index", f"with {R} select {_digest_sql('domain')} as digest_domain, {_FOUR} from rec")
def cli_index(spark: SparkSession, sf: str) -> DataFrame:
    from fathomline import cli

    out = shared_path(spark, "lookup")
    cli.main(["index", _json_path(spark, sf, "raw"), "--output", out, "--key", "domain", "--partitions", "6"], spark)
    return index.read_lookup(spark, out)


@_query("cli_sort", _PLACED)
def cli_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The sort command over stored parts; the outcome is the order on disk."""
    from fathomline import cli

    parts, out = shared_path(spark, "parts"), shared_path(spark, "sorted")
    files.write_index_parts(_index(spark, sf), parts)
    cli.main(["sort", parts, "--output", out, "--partitions", "6"], spark)
    return pipeline.placed(spark, out)


@_query("cli_version", "select '0.1.0' as version")
def cli_version(spark: SparkSession, sf: str) -> DataFrame:
    from fathomline import __version__

    return spark.createDataFrame([(__version__,)], "version string")


@_query("cli_search", f"with {R} select email, password from rec where \"user\" = '{_USER}'")
def cli_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.query_all(_lookup(spark, sf, "user"), "user", _USER)


def _served(spark: SparkSession, sf: str, *queries: QuerySet, keys: tuple[str, ...] = ("email", "user", "domain"), paged: bool = False, behind: str | None = None) -> list[dict]:
    """What a client gets from a server with a lookup for each key; an error answer has its text as ``error``.

    With ``behind`` the client asks for that URL and takes the server, which answers any path, as its proxy.
    """
    import threading

    from fathomline import server

    at = server.made({k: _lookup(spark, sf, k) for k in keys}, port=0, paged=paged)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{at.server_address[1]}/"
    client, out = server.Client(behind or url, token="t", timeout=60, verify=not behind, proxy=url if behind else None), []
    try:
        for q in queries:
            try:
                out.append(client.query(q))
            except ValueError as e:
                out.append({"error": str(e)})
    finally:
        at.shutdown()
    return out


@_query("srv_start", f"""with {R}, k as (select 'email' as key, {_FIRST} as value union all select 'user', '{_USER}' union all select 'domain', '{_D}')
select key, cast(count(*) as bigint) as count from k join rec on value = case key when 'email' then email when 'user' then "user" else domain end group by key""")
def srv_start(spark: SparkSession, sf: str) -> DataFrame:
    """One server, three lookups: each key is answered from its own."""
    asked = [QuerySet(email=_first(spark, sf)), QuerySet(user=_USER), QuerySet(domain=_D)]
    got = _served(spark, sf, *asked)
    return spark.createDataFrame([(k, g["count"]) for k, g in zip(("email", "user", "domain"), got, strict=True)], "key string, count long")


@_query("srv_missing_key", "select 'status 400: domain is not indexed; indexed: email, user' as error")
def srv_missing_key(spark: SparkSession, sf: str) -> DataFrame:
    """A key without a lookup is an error, not an empty answer."""
    return spark.createDataFrame([(_served(spark, sf, QuerySet(domain=_D), keys=("email", "user"))[0]["error"],)], "error string")


@_query("client_query", f"with {R} select email, password from rec where \"user\" = '{_USER}'")
def client_query(spark: SparkSession, sf: str) -> DataFrame:
    found = _served(spark, sf, QuerySet(user=_USER), keys=("user",))[0]
    return spark.createDataFrame([(r["email"], r["password"]) for r in found["results"]], "email string, password string")


@_query("client_new", f"with {R} select email, password from rec where \"user\" = '{_USER}'")
def client_new(spark: SparkSession, sf: str) -> DataFrame:
    """A client with a time limit that takes any certificate and asks an unknown host through a proxy."""
    found = _served(spark, sf, QuerySet(user=_USER), keys=("user",), behind="http://records.invalid/")[0]
    return spark.createDataFrame([(r["email"], r["password"]) for r in found["results"]], "email string, password string")


@_query("client_cli", f"with {R} select concat(email, ':', password) as line from rec where \"user\" = '{_USER}'")
def client_cli(spark: SparkSession, sf: str) -> DataFrame:
    """The query command against a paged server; what it prints is read back."""
    import contextlib
    import io
    import json
    import threading

    from fathomline import cli, server

    at = server.made({"user": _lookup(spark, sf, "user")}, port=0, paged=True)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    out = io.StringIO()
    try:
        with contextlib.redirect_stdout(out):
            cli.main(["query", "user", _USER, "--url", f"http://127.0.0.1:{at.server_address[1]}/", "--json"])
    finally:
        at.shutdown()
    found = ResultSet(**json.loads(out.getvalue()))
    return spark.createDataFrame([(line,) for line in results.fetched_lines(found)], "line string")


@_query("lambda_handler", f"with {R}, {_HITS} select email, password from (select *, row_number() over (order by email, password) as i from hits) where i <= 1000")
def lambda_handler(spark: SparkSession, sf: str) -> DataFrame:
    found = results.handle_paged(records(spark, sf), QuerySet(domain=_D))
    return spark.createDataFrame([(r["email"], r["password"]) for r in found.results], "email string, password string")


@_query("client_query_all", f"with {R}, {_HITS} select email, password from hits")
def client_query_all(spark: SparkSession, sf: str) -> DataFrame:
    return search.query_all(records(spark, sf), "domain", _D)
