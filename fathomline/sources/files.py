"""Sinks for records, lines and indexes, and the flat twelve-byte index form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.exprs import le_decode48, record_json
from fathomline.operators.index import encoded


def write_records(records: DataFrame, path: str, append: bool = True, html_safe: bool = True, overwrite: bool = False) -> None:
    """Compact JSON lines; an existing output is added to, replaced if asked for, or else an error."""
    if append and overwrite:
        raise ValueError("append and overwrite exclude each other")
    records.select(record_json(html_safe=html_safe).alias("value")).write.mode("append" if append else "overwrite" if overwrite else "errorifexists").text(path)


def write_records_spaced(records: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with spaced marks; address, user and domain in lower case; overwrites unless appending."""
    low = records.withColumns({c: F.lower(c) for c in ("email", "user", "domain")})
    low.select(record_json(spaced=True).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_index_parts(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One unsorted part per task; the folder of parts is one dataset already."""
    index.write.mode(mode).parquet(path)


def merge_index(spark: SparkSession, parts: str, path: str, files: int = 1) -> None:
    """The parts as ``files`` files, rows unchanged."""
    spark.read.parquet(parts).coalesce(files).write.mode("errorifexists").parquet(path)


def write_sorted_index(index: DataFrame, path: str, partitions: int) -> None:
    """Range-partitioned and sorted: files with disjoint digest ranges, in order of their names."""
    index.repartitionByRange(partitions, "digest", "offset").sortWithinPartitions("digest", "offset").write.mode("errorifexists").parquet(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(digest, offset) of flat files of twelve-byte entries."""
    rows = spark.createDataFrame(spark.sparkContext.binaryRecords(path, 12).map(lambda b: (bytearray(b),)), "entry binary")
    h = F.lower(F.hex("entry"))
    return rows.select(le_decode48(F.substring(h, 1, 12)).alias("digest"), le_decode48(F.substring(h, 13, 12)).alias("offset"))


def entry_bytes(index: DataFrame) -> DataFrame:
    """(entry) of an index as binary twelve-byte values."""
    return encoded(index).select(F.unhex("entry").alias("entry"))


def export_entries(index: DataFrame, path: str) -> int:
    """Writes one flat file on the driver, entry by entry in digest order, for tools that read that form.

    For tools outside Spark alone: no query or stage uses it. Rows stream through the driver a partition
    at a time; for large data keep the Parquet index.
    """
    ordered = index.orderBy("digest", "offset")
    n = 0
    with open(path, "wb") as f:
        for row in entry_bytes(ordered).toLocalIterator(prefetchPartitions=True):
            f.write(bytes(row["entry"]))
            n += 1
    return n
