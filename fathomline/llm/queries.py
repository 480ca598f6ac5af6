"""The training-data operators as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import dartminhash, html_extract, license_scan, media, packing, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, warc
from fathomline.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, window=50, with_text=False)
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", F.col("span_text").alias("spans"), "n_live")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dartminhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "n_texts", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_back(warc.archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"), caption_col="source")


def media_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an interleaved sequence, each page with the document of its number as a figure at its end."""
    docs = table(spark, sf_dir, "documents")
    figure = F.concat(F.lit('<figure><img alt="a document" src="sha256:'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('"><figcaption>'), F.coalesce("lang", F.lit("")), F.lit("</figcaption></figure>"))
    figures = docs.select(F.col("doc_id").alias("page_id"), figure.alias("figure"))
    pages = table(spark, sf_dir, "pages").join(figures, "page_id", "left").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.coalesce("figure", F.lit(""))).alias("html"))
    found = media.interleaved(pages, media.facts(media.store(docs)))
    texts = F.transform(F.filter("sequence", lambda x: x["kind"] == "text"), lambda x: x["text"])
    shown = F.filter("sequence", lambda x: x["kind"] == "media")
    first = lambda c: F.get(shown, F.lit(0))[c]
    return found.select(F.col("id").alias("page_id"), F.size("sequence").alias("n_items"), F.size(shown).alias("n_media"), F.sha2(F.array_join(texts, "\n"), 256).alias("text_sha256"), first("position").alias("position"), first("text").alias("caption"), first("n_bytes").alias("n_bytes"), first("media_sha256").alias("media_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality")
    return judged.select("doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_extract": op4_html_extract,
    "op5_dartminhash": op5_dartminhash,
    "op6_warc": op6_warc,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_media": op8_media,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "media_page_sequences": media_page_sequences,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _secrets_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [(0, secret_scan.ASSIGN, 1), (1, secret_scan.ACCESS, 0), (2, secret_scan.HEX, 0)]
    found = " union all ".join(
        f"select doc_id, source, {k} as kind, regexp_split_to_array(text, {quoted(p)}) as gaps, regexp_extract_all(text, {quoted(p)}, 0) as wholes, regexp_extract_all(text, {quoted(p)}, {g}) as vals from d" for k, p, g in kinds
    )
    return f"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
f as ({found}),
e as (select doc_id, source, kind, vals[i] as v, length(wholes[i]) as n,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda x: length(x))), 0) as s
      from (select *, unnest(range(1, len(wholes) + 1)) as i from f)),
b as (select doc_id, source, kind, v, cast(s as bigint) as s, cast(s + n as bigint) as e from e where kind <> 0 or length(v) >= {secret_scan.LEAST_VALUE}),
o as (select v, count(distinct source) as owners, count(distinct doc_id) as repos from b group by v),
l as (select distinct doc_id, 3 as kind, cast(e - length(v) as bigint) as s, e from b join o using (v)
      where owners <= {secret_scan.OWN} and repos < {secret_scan.WIDE} and length(v) >= 16 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
        and len(list_distinct(string_split(v, ''))) >= 8 and not regexp_matches(v, {quoted(secret_scan.SHOWN)})),
a as (select doc_id, kind, s, e from b union all select * from l),
t as (select doc_id, kind, s, e, concat(['assign', 'access', 'hex', 'live'][kind + 1], ':', s, ':', e) as x from a),
g as (select doc_id, count(*) filter (where kind = 0) as a0, count(*) filter (where kind = 1) as a1, count(*) filter (where kind = 2) as a2, count(*) filter (where kind = 3) as a3,
        coalesce(string_agg(x, ',' order by s, kind) filter (where kind < 3), '') as base, string_agg(x, ',' order by s, kind) as spans from t group by doc_id)
select d.doc_id, cast(coalesce(a0, 0) as bigint) as n_assign, cast(coalesce(a1, 0) as bigint) as n_access, cast(coalesce(a2, 0) as bigint) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, cast(coalesce(a3, 0) as bigint) as n_live
from d left join g using (doc_id)
"""


ORACLE_SQL = {
    "op3_secret_scan": _secrets_sql(),
    "op1_substring_dedup": f"""
with w as (select doc_id, {_WORDS} as words from documents),
win as (select doc_id, i, hash(array_to_string(words[i:i + 49], ' ')) as h1, md5(array_to_string(words[i:i + 49], ' ')) as h2
        from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
least as (select h1, h2, min(doc_id) as first_doc from win group by h1, h2),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join least using (h1, h2) where first_doc < doc_id),
marked as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id),
pos as (select doc_id, words, unnest(range(1, len(words) + 1)) as p from w where len(words) > 0),
kept as (select pos.doc_id, string_agg(pos.words[pos.p], ' ' order by pos.p) as text from pos left join gone using (doc_id, p) where gone.p is null group by pos.doc_id)
select w.doc_id, cast(len(w.words) as bigint) as n_words, cast(coalesce(marked.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join marked using (doc_id) left join kept using (doc_id)
""",
    "op5_dartminhash": f"""
with recursive w as (select doc_id, {_WORDS} as words from documents),
sh as (select doc_id, array_to_string(words[i:i + 4], ' ') as g from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)),
el as (select doc_id, g, row_number() over (partition by doc_id, g) as c from sh),
n as (select doc_id, count(*) as n from el group by doc_id),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as k from el a join el b on a.g = b.g and a.c = b.c and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as (select x, y from pair join n as p on p.doc_id = x join n as q on q.doc_id = y where k >= 0.8 * (p.n + q.n - k)),
sides as (select x, y from link union all select y, x from link),
reach as (select doc_id, doc_id as r from w union select reach.doc_id, sides.y from reach join sides on sides.x = reach.r),
class as (select doc_id, min(r) as class_id from reach group by doc_id),
size as (select class_id, count(distinct array_to_string(words, ' ')) as n_texts from class join w using (doc_id) group by class_id)
select doc_id, class_id, cast(n_texts as bigint) as n_texts, doc_id = class_id as kept from class join size using (class_id)
""",
    "op6_warc": """
with p as (select page_id, sha1(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
f as (select page_id, d, n, min(page_id) over (partition by d) as first_id from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(d, g * 5 + 1, 5) as bigint) // [32768, 1024, 32, 1][k + 1]) % 32) + 1, 1)), '')), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from f
""",
    "op10_quality_rules": f"""
with w as (select doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as g
        from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + 8)) as p from rep) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as l from w),
m as (select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
        cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
        cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
        len(list_filter(words, lambda x: lower(x) in ({", ".join("'" + s + "'" for s in dict.fromkeys(quality_rules.STOP_WORDS))}))) as n_stop,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•‣●]'))) as n_bullet,
        len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) as n_ellipsis
      from w join lines using (doc_id) left join cov using (doc_id)),
b as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and word_chars / n_words between 2.5 and 10 and n_symbols / n_words <= 0.1 and n_stop / n_words >= 0.05
   and n_dup_lines / n_lines <= 0.4 and n_bullet / n_lines <= 0.9 and n_ellipsis / n_lines <= 0.3) as kept
from b
""",
}
