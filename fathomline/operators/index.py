"""Digest-keyed indexes: (digest, offset) rows sorted by digest, and a layout that looks up without them.

The faithful form is an index of offsets into one file. For data of any size the index keeps the
record itself (``build_lookup``), range-partitioned and sorted by digest, so that a lookup is a
pushed-down filter that row-group statistics prune, and no second fetch is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.exprs import digest48, le_encode48
from fathomline.schema import FIELDS, check_key

#: A lookup's digest column is named by this and its key, so that it can't be taken for another key's.
DIGEST = "digest_"

def index_build(records: DataFrame, key: str, offset: str = "offset") -> DataFrame:
    """(digest, offset) of every record; a missing value is indexed as ''."""
    check_key(key)
    return records.select(digest48(F.col(key)).alias("digest"), F.col(offset).cast("long").alias("offset"))


def sort_index(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ascending by digest (then offset) over the whole dataset: range exchange, then a sort that spills.

    With ``partitions`` the ranges are split by (digest, offset), so a digest that many records
    share is not one partition.
    """
    if partitions:
        return index.repartitionByRange(partitions, "digest", "offset").sortWithinPartitions("digest", "offset")
    return index.orderBy("digest", "offset")


def sort_runs(index: DataFrame) -> DataFrame:
    """Each partition sorted on its own, as runs before a merge."""
    return index.sortWithinPartitions("digest", "offset")


def _inversions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = bad = 0
    part = head = tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        digests = batch.column(0)
        first = digests[0].as_py()
        bad += int(tail is not None and tail > first) + (pc.sum(pc.greater(digests.slice(0, len(digests) - 1), digests.slice(1))).as_py() or 0)
        part, head, tail, n = batch.column(1)[0].as_py(), first if head is None else head, digests[-1].as_py(), n + len(digests)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int32()), (n, pa.int64()), (bad, pa.int64()), (head, pa.int64()), (tail, pa.int64()))], ["part", "n", "bad", "head", "tail"])


def buffers(placed: DataFrame, size: int) -> DataFrame:
    """(buffer, entries, first, last) of an index with ``place`` from 1, as a reader takes it: ``size`` entries at a time, to its end."""
    number = F.floor((F.col("place") - 1) / size).cast("long")
    return placed.groupBy(number.alias("buffer")).agg(F.count("*").alias("entries"), F.min("digest").alias("first"), F.max("digest").alias("last"))


def merge_runs(runs: list[DataFrame], partitions: int) -> DataFrame:
    """Runs as one sorted index: each range takes its share of every run, in order."""
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run)
    return sort_index(whole, partitions)


def sort_check(index: DataFrame, position: str) -> DataFrame:
    """One row: entries, and how many come before a smaller digest, by their ``position``.

    One range exchange on the position and a sort within; a task looks at its entries as they
    stream by, and the borders are compared by each partition's last entry and the next one's first.
    """
    spread = index.select("digest", F.col(position).alias("p")).repartitionByRange(F.col("p")).sortWithinPartitions("p")
    sums = spread.select("digest", F.spark_partition_id().alias("part")).mapInArrow(_inversions, "part int, n long, bad long, head long, tail long")
    # one row a partition is left here
    joined = sums.withColumn("previous", F.lag("tail").over(Window.orderBy("part")))
    border = F.coalesce((F.col("previous") > F.col("head")).cast("long"), F.lit(0))  # the first partition has none before it
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum(F.col("bad") + border), F.lit(0)).alias("inversions"))


def is_sorted(index: DataFrame, position: str) -> bool:
    return sort_check(index, position).first()["inversions"] == 0


def encoded(index: DataFrame) -> DataFrame:
    """Twelve-byte entries (as hex) for tools that read the flat form: six digest bytes, six offset bytes."""
    return index.select(F.concat(le_encode48(F.col("digest")), le_encode48(F.col("offset"))).alias("entry"))


def build_lookup(records: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Records with the digest of their key, by digest and then by address, ready to be written."""
    check_key(key)
    keyed = records.select(digest48(F.col(key)).alias(DIGEST + key), *FIELDS)
    order = [DIGEST + key, "email", "password"]
    # by address too, as many records share a domain
    spread = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order)


def write_lookup(records: DataFrame, key: str, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Builds and writes the lookup of a key."""
    save_lookup(build_lookup(records, key, partitions), key, path, mode)


def save_lookup(lookup: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """Writes a lookup as sorted Parquet with a Bloom filter on the key."""
    lookup.write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("entries"))


