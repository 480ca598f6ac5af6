"""Equality lookups. A digest narrows the scan; the key itself decides, so digests that collide give no wrong row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.exprs import digest48
from fathomline.operators.index import DIGEST
from fathomline.schema import KEYS, check_key
from fathomline.sources import text


def search(records: DataFrame, key: str, value: str) -> DataFrame:
    """Records whose key equals the value, case and all.

    In a lookup (which has the digest of the key that it was built for) both conditions are pushed
    down; a lookup of another key is an error, not an empty answer.
    """
    check_key(key)
    found = F.col(key) == F.lit(value)
    indexed = [c for c in records.columns if c.startswith(DIGEST)]
    if indexed and DIGEST + key not in indexed:
        raise ValueError(f"{key} is not indexed; this is a lookup of {', '.join(c.removeprefix(DIGEST) for c in indexed)}")
    if indexed:
        found = (F.col(DIGEST + key) == digest48(F.lit(value))) & found
    return records.where(found)


def search_email(records: DataFrame, value: str) -> DataFrame:
    return search(records, "email", value)


def search_user(records: DataFrame, value: str) -> DataFrame:
    return search(records, "user", value)


def search_domain(records: DataFrame, value: str) -> DataFrame:
    return search(records, "domain", value)


def search_index(index: DataFrame, records: DataFrame, key: str, value: str) -> DataFrame:
    """Lookup through an index of offsets: all entries of the digest, then their records by offset.

    The join is left to the optimizer, which broadcasts the hits only if they are small: all the
    records of a large domain may match.
    """
    check_key(key)
    hits = index.where(F.col("digest") == digest48(F.lit(value))).select("offset")
    return records.join(hits, "offset").where(F.col(key) == F.lit(value))


#: Hits up to this number are read one by one at their offsets; more are joined with a scan of the lines.
POINT_READS = 1000


def search_stored(spark: SparkSession, index_path: str, lines_path: str, key: str, value: str, most: int = POINT_READS) -> DataFrame:
    """(offset, record) of a lookup in a stored, sorted index of offsets and the file of JSON lines that it tells of.

    The digest is pushed down into the index, whose row groups it prunes. Few hits are then read at
    their places, without a scan; of a value with more than ``most`` the lines are scanned and joined.
    """
    check_key(key)
    hits = spark.read.parquet(index_path).where(F.col("digest") == digest48(F.lit(value))).select("offset")
    few = [r["offset"] for r in hits.limit(most + 1).collect()]
    if len(few) <= most:
        rows = text.records_at(spark, lines_path, few)
    else:
        rows = text.records_with_offsets(spark, lines_path, only=hits)
    return rows.where(F.col(key) == F.lit(value))


def search_batch(records: DataFrame, values: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Records whose key is among many values: one semi-join in place of a loop."""
    check_key(key)
    wanted = values.select(F.col(column).alias("__value"))
    return records.join(wanted, F.col(key) == F.col("__value"), "left_semi")


def search_sql(records: DataFrame, key: str, value: str) -> DataFrame:
    """The parameterised query over a table: address and value of the rows whose key is equal."""
    check_key(key, KEYS)
    return records.sparkSession.sql(f"select email, password from {{t}} where {key} = :v", args={"v": value}, t=records)


def query_all(records: DataFrame, key: str, value: str) -> DataFrame:
    """All results without pages."""
    return search(records, key, value).select("email", "password")
