"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a local folder if all runs on this machine, or else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fathomline-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/fathomline-{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def mark() -> int:
    """A point in time for ``clear``."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Deletes what this process has written under the shared folder after the mark; results not yet computed need it no more."""
    n = 0
    while len(_MADE) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a read of the table, not the work before it.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
