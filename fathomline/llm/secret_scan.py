"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Patterns find candidate credentials with their places. The hash of each candidate value is counted
over the corpus: in how many repositories, of how many owners, does it occur? A live-looking value
that a single owner has in few repositories is likely a credential in use, and its place is added
as a span of kind ``live``. A value that several owners share, or that stands in many repositories
even of one owner, is a copied example: what is pasted so widely is a template or a vendored file.

A row's places come from running sums over its matches (a window per row), so their cost is linear
in the matches. Counts are aggregated before each shuffle by (value, owner, repository), then
(value, owner), then value, so a value in a third of all rows is a few rows per task. Only the rows
that hold a candidate leave the scan stage, and without their texts.

Defined cases: a null text is empty; a null owner or repository is one of its own name; repeated
rows have the same spans each; rows are told apart by a number, not by their id, so repeated or
null ids are fine; empty tables give empty results; very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, text_key

# The kinds in order, and their patterns. The value is group 1 of assign, else the match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "live")
#: Cheap test for rows that may hold any.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""
#: An assigned value has so many characters at least.
LEAST_VALUE = 12
# Marks of values that are there for show.
SHOWN = r"(?i)example|sample|dummy|change_?me|placeholder|xxxx|test|0000000|1234567"
#: Owners of one value: so many at most make it owner-specific, so many at least make it a copied example.
OWN, COPIED = 1, 3
#: Repositories of one value: so many at least make it a copied example, whoever owns them.
WIDE = 20


def _looks_live(v: Column) -> Column:
    letters_and_digits = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return (F.length(v) >= 16) & letters_and_digits & (F.size(F.array_distinct(F.split(v, ""))) >= 8) & ~v.rlike(SHOWN)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(gap before the match, its length, the value's length, hash and look), match by match."""
    whole, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), F.transform(whole, lambda x: F.length(x)).alias("l"), values.alias("v"))
    return F.transform(zipped, lambda x: F.struct(x["g"].alias("g"), x["l"].alias("l"), F.length(x["v"]).alias("n"), F.sha2(x["v"], 256).alias("h"), _looks_live(x["v"]).alias("live")))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """Per row: row (its number), id, key, owner, repo and the matches of each kind, or null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _matches(text, p, g).alias("m")) for k, p, g in ((0, ASSIGN, 1), (1, ACCESS, 0), (2, HEX, 0))])
    name = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        text_key(text_col).alias("key"),
        name(owner_col).alias("owner"),
        name(repo_col or id_col).alias("repo"),
        F.when(text.rlike(ANY), found).alias("found"),
    )


def spans_of(found: DataFrame, own: int = OWN, wide: int = WIDE) -> DataFrame:
    """Per row with any: row and spans, an array of (start, kind, end, owners, repos) by start, then kind."""
    kinds = found.where("found is not null").select("row", "owner", "repo", F.explode("found").alias("k"))
    each = kinds.select("row", "owner", "repo", F.col("k.kind").alias("kind"), F.posexplode("k.m").alias("i", "m"))
    running = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.g") + F.col("m.l")).over(running)).where((F.col("kind") != 0) | (F.col("m.n") >= LEAST_VALUE))
    placed = placed.select("row", "kind", (F.col("end") - F.col("m.l")).alias("start"), "end", F.col("m.n").alias("n"), F.col("m.h").alias("h"), F.col("m.live").alias("live"), "owner", "repo")
    owners = placed.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    # a table of its own, so that the join reads two exchanges and a value in many rows is split among tasks
    owners = materialize(owners, "secret-owners")
    judged = placed.drop("owner", "repo").join(owners, "h")
    base = F.struct(F.col("start"), F.col("kind"), F.col("end"), F.col("owners"), F.col("repos"))
    live = F.struct((F.col("end") - F.col("n")).alias("start"), F.lit(3).alias("kind"), F.col("end"), F.col("owners"), F.col("repos"))
    both = F.when(F.col("live") & (F.col("owners") <= own) & (F.col("repos") < wide), F.array(base, live)).otherwise(F.array(base))
    return judged.select("row", both.alias("s")).groupBy("row").agg(F.array_distinct(F.sort_array(F.flatten(F.collect_list("s")))).alias("spans"))


def _joined(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, own: int = OWN, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: its id (as ``id``), key, spans (array), the counts and digests."""
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col), "secret-candidates")
    spans = spans_of(found, own, wide)
    all_rows = found.select("row", "id", "key").join(spans, "row", "left")
    s = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repos:bigint>>"))
    base = F.filter(s, lambda x: x["kind"] < 3)
    of_kind = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return all_rows.select("id", "key", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(s).alias("span_text"), s.alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, own: int = OWN, wide: int = WIDE) -> DataFrame:
    """``docs`` with each found secret replaced: [SECRET], or [EXAMPLE SECRET] where many owners or repositories have it.

    Overlapping spans are replaced together. Rows without a candidate aren't shuffled.
    """
    columns = docs.columns
    inside = [f"_{i}" for i in range(len(columns))]
    plain = docs.toDF(*inside)
    own_id, own_text = inside[columns.index(id_col)], inside[columns.index(text_col)]
    may = F.coalesce(F.col(own_text).rlike(ANY), F.lit(False))
    found = scan(docs, id_col, text_col, owner_col, repo_col, own, wide).where("size(spans) > 0").select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    found = found.dropDuplicates(["__id", "__key"])
    hit = plain.where(may).withColumn("__k", text_key(own_text)).alias("d").join(found, F.col(f"d.{own_id}").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")), "left")
    text = F.col(own_text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        mark = F.when((x["owners"] >= COPIED) | (x["repos"] >= wide), "[EXAMPLE SECRET]").otherwise("[SECRET]")
        between = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        fresh = (x["start"] >= a["at"]) & (x["kind"] < 3)
        return F.struct(F.when(fresh, F.concat(a["out"], between, mark)).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    done = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))))
    hit = hit.withColumn(own_text, F.when(F.col("__spans").isNotNull(), done).otherwise(text)).select(*inside)
    return hit.unionByName(plain.where(~may)).toDF(*columns)
