"""Column expressions for records: all built in, so they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.schema import FIELDS

# What counts as a blank value, and the shapes of hashed ones.
BLANK_VALUES = ("", "xxx")
HEX = r"\A[0-9a-fA-F]+\z"
BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def utrim(c: Column) -> Column:
    """Trims all Unicode white space; the built-in trim knows spaces only."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def fields(c: Column) -> Column:
    """The runs between Unicode white space."""
    return F.split(utrim(c), r"(?U)\s+")


def digest_hex(c: Column) -> Column:
    """The first six bytes of SHA-256 over the UTF-8 value, as 12 hex digits."""
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 12)


def _reversed(h: Column) -> Column:
    return F.concat(*[F.substring(h, i, 2) for i in range(11, 0, -2)])


def le_decode48(h: Column) -> Column:
    """Twelve hex digits as an unsigned little-endian number; it fits a signed long."""
    return F.conv(_reversed(h), 16, 10).cast("long")


def le_encode48(n: Column) -> Column:
    """The inverse: six little-endian bytes as 12 hex digits."""
    return F.lower(_reversed(F.lpad(F.hex(n), 12, "0")))


def digest48(c: Column) -> Column:
    """The 48-bit digest that indexes are sorted by."""
    return le_decode48(digest_hex(c))


def is_blank(c: Column) -> Column:
    return c.isin(*BLANK_VALUES)


def is_hash(c: Column) -> Column:
    """Looks like a hash: hex of 32 bytes of text or more, or whole base64 groups of 22 or more."""
    n = F.octet_length(c)
    return (n >= 8) & ((c.rlike(HEX) & (n >= 32)) | (c.rlike(BASE64) & (n >= 22)))


def value_is_blank(value: str) -> bool:
    """``is_blank`` for a value that was fetched already."""
    return value in BLANK_VALUES


def value_is_hash(value: str) -> bool:
    """``is_hash`` for a value that was fetched already."""
    n = len(value.encode())
    shaped = lambda pattern: re.fullmatch(pattern.removeprefix(r"\A").removesuffix(r"\z"), value)
    return n >= 8 and bool((n >= 32 and shaped(HEX)) or (n >= 22 and shaped(BASE64)))


def _quoted(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)


def record_json(html_safe: bool = False, spaced: bool = False) -> Column:
    """The record as one JSON line.

    ``html_safe`` writes <, > and & as escapes; ``spaced`` puts a space after each colon and comma.
    """
    if spaced:
        out = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), _quoted(F.col(f))) for f in FIELDS]), F.lit("}"))
    else:
        out = F.to_json(F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in FIELDS]))
    if html_safe:
        for mark, escape in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
            out = F.replace(out, F.lit(mark), F.lit(escape))
    return out


#: What a line is followed by when it is parsed: text after the object then makes the whole malformed.
_END = "fathomline-end"


def decoded(line: Column) -> Column:
    """A record from a JSON line, parsed once. Field names match in any case, an exact one first.

    A field that is missing, null or no string is ''; so are all of a line that isn't one JSON
    object and nothing else, or that has a name twice.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{_END}"]')))
    ended = F.try_variant_get(whole, "$[1]", "string") == F.lit(_END)
    entries = F.map_entries(F.when(ended, F.try_variant_get(whole, "$[0]", "map<string,variant>")))
    texts = F.filter(entries, lambda x: F.lower(x["key"]).isin(*FIELDS) & (F.schema_of_variant(x["value"]) == "STRING"))

    def record(named: Column) -> Column:
        def value(f: str) -> Column:
            own = F.filter(named, lambda x: F.lower(x["key"]) == f)
            exact = F.filter(own, lambda x: x["key"] == f)
            return F.coalesce(F.try_element_at(exact, F.lit(1))["value"], F.try_element_at(own, F.lit(-1))["value"], F.lit(""))

        return F.struct(*[value(f).alias(f) for f in FIELDS])

    # bound once for the row, so that four fields don't parse four times
    named = F.transform(F.coalesce(texts, F.array().cast("array<struct<key:string,value:variant>>")), lambda x: F.struct(x["key"].alias("key"), x["value"].cast("string").alias("value")))
    return F.element_at(F.transform(F.array(named), record), 1)
