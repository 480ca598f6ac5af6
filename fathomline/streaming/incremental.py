"""Incremental de-duplication of arriving files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.functions.exprs import utrim
from fathomline.operators.formats import normalize


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Trimmed lines of files as they come into a folder."""
    rows = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(folder)
    return rows.select(utrim(F.col("value")).alias("line")).where(F.length("line") > 0)


def distinct_stream(lines: DataFrame) -> DataFrame:
    """Each line once over the whole life of the stream; the seen lines are keyed state, spread by hash."""
    return lines.dropDuplicates(["line"])


def distinct_within(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark: state stays bounded for streams without end."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def start(lines: DataFrame, output: str, checkpoint: str, format: str | None = None) -> StreamingQuery:
    """Writes distinct lines (or their records) as Parquet, exactly once, until all that is there is done.

    Every line ever seen is state, so it is kept in RocksDB on the executors' disks rather than in their heaps.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = normalize(distinct_stream(lines), format) if format else distinct_stream(lines)
    return out.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
