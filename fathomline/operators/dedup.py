"""Exact de-duplication: hash aggregation that spills, in place of a filter that may drop true rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.exprs import utrim
from fathomline.schema import FIELDS


def dedup_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Distinct trimmed lines, blanks dropped. Lines are compared as text: two spellings of a record differ."""
    return lines.select(utrim(F.col(column)).alias(column)).where(F.length(column) > 0).distinct()


def dedup_records(records: DataFrame) -> DataFrame:
    """Distinct records by their four fields."""
    return records.select(*FIELDS).distinct()


def dedup_incremental(fresh: DataFrame, seen: DataFrame, column: str = "line") -> DataFrame:
    """Distinct lines of a new batch that no earlier run has emitted: an anti-join on the line itself."""
    return dedup_lines(fresh, column).join(seen.select(column), column, "left_anti")


def dedup_stats(lines: DataFrame, column: str = "line") -> DataFrame:
    """One row: total, unique and duplicate lines. Counts are aggregated by line first, so no key set is gathered."""
    each = lines.select(utrim(F.col(column)).alias("l")).where(F.length("l") > 0).groupBy("l").agg(F.count("*").alias("c"))
    return each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("uniques")).select("total", "uniques", (F.col("total") - F.col("uniques")).alias("duplicates"))


def save_seen(lines: DataFrame, path: str, column: str = "line", append: bool = True) -> None:
    """Keeps emitted lines for later runs."""
    dedup_lines(lines, column).write.mode("append" if append else "errorifexists").parquet(path)


def bloom_filter(lines: DataFrame, column: str, expected: int, rate: float):
    """A JVM Bloom filter of a column, for callers that want a small pre-test. Built by partial filters per task."""
    return lines._jdf.stat().bloomFilter(column, expected, rate)


def write_dedup(lines: DataFrame, path: str, column: str = "line", append: bool = False) -> None:
    """Writes distinct lines as text; an existing output is an error unless appending."""
    dedup_lines(lines, column).write.mode("append" if append else "errorifexists").text(path)
