"""Text scans. Lines end at \\n alone; files are found by Spark, so any store that it reads will do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.exprs import decoded, utrim
from fathomline.schema import FIELDS


def read_raw(spark: SparkSession, path: str | list[str], recursive: bool = False, skip_prefix: str | None = None, skip_suffix: str | None = None, whole_path: bool = False) -> DataFrame:
    """(line, file) of every line as it stands.

    Only files directly in a folder are read unless ``recursive``. Files are skipped by a prefix or
    suffix of their name, or of their whole path with ``whole_path``. Spark itself leaves out files
    whose names begin with _ or a dot; ``left_out`` tells which.
    """
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(path)
    rows = rows.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"))
    tested = F.col("file" if whole_path else "name")
    if skip_prefix:
        rows = rows.where(~tested.startswith(skip_prefix))
    if skip_suffix:
        rows = rows.where(~tested.endswith(skip_suffix))
    return rows.drop("name")


def read_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(line, file) of trimmed lines that aren't blank."""
    rows = read_raw(spark, path, **options)
    return rows.withColumn("line", utrim(F.col("line"))).where(F.length("line") > 0)


@dataclass
class Collected:
    """Lines of the paths that could be read, and (path, error) of those that couldn't."""

    lines: DataFrame | None
    errors: list[tuple[str, str]]


def _files(spark: SparkSession, path: str, recursive: bool):
    """(path, file system) of every file that a target has, hidden ones too; names are listed on the driver, as Spark does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    todo = [at]
    while todo:
        for status in fs.listStatus(todo.pop()):
            if status.isFile():
                yield status.getPath(), fs
            elif recursive:
                todo.append(status.getPath())


def left_out(spark: SparkSession, path: str, recursive: bool = False) -> list[str]:
    """The files that a read of the path doesn't see, as their names begin with _ or a dot."""
    return sorted(p.toString() for p, _ in _files(spark, path, recursive) if p.getName()[:1] in ("_", "."))


def _opened(path, fs) -> None:
    """Opens a file and reads its first byte, or raises."""
    stream = fs.open(path)
    try:
        stream.read()
    finally:
        stream.close()


def read_collecting_errors(spark: SparkSession, paths: list[str], recursive: bool = False, **options) -> Collected:
    """Reads what can be read. A path that can't be listed, a file in a folder that can't be opened, and a
    file that Spark leaves out by its name are noted, and the scan goes on with the others.
    """
    good, errors = [], []
    for path in paths:
        try:
            found = list(_files(spark, path, recursive))
        except Exception as e:  # noqa: BLE001  any failure to list is this path's own
            errors.append((path, str(e).strip().splitlines()[0]))
            continue
        for file, fs in found:
            name = path if file.getName() == path.rstrip("/").rsplit("/", 1)[-1] and len(found) == 1 else file.toString()
            if file.getName() in ("_SUCCESS",) or file.getName().endswith(".crc"):
                continue
            if file.getName()[:1] in ("_", "."):
                errors.append((name, "left out, as its name begins with _ or a dot"))
                continue
            try:
                _opened(file, fs)
                good.append(file.toString())
            except Exception as e:  # noqa: BLE001  any failure to open is this file's own
                errors.append((name, str(e).strip().splitlines()[0]))
    return Collected(read_lines(spark, good, **options) if good else None, errors)


def read_records(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Records of JSON lines: a permissive read, with '' for what is missing or malformed."""
    rows = read_lines(spark, path, **options)
    return rows.select(decoded(F.col("line")).alias("r")).select(*[F.col(f"r.{f}").alias(f) for f in FIELDS])


def read_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(offset, line): the byte offset at which each line of a file begins, over input splits.

    Offsets come with the lines from Hadoop's text input, the one place where an RDD is needed.
    """
    conf = {"textinputformat.record.delimiter": "\n", "mapreduce.input.fileinputformat.input.dir.recursive": "false"}
    pairs = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=conf)
    return spark.createDataFrame(pairs, "offset long, line string")


def _decoded_lines(rows: DataFrame) -> DataFrame:
    """(offset, record fields) of (offset, line)."""
    return rows.select("offset", decoded(F.col("line")).alias("r")).select("offset", *[F.col(f"r.{f}").alias(f) for f in FIELDS])


def records_with_offsets(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """(offset, record fields) of a file of JSON lines, or of its lines at the offsets of ``only``; no others are parsed."""
    rows = read_with_offsets(spark, path)
    if only is not None:
        rows = rows.join(only.select("offset"), "offset")
        # a running number keeps conditions on the fields above the join; below it, all lines would be parsed
        rows = rows.select("offset", F.when(F.monotonically_increasing_id() >= 0, F.col("line")).alias("line"))
    return _decoded_lines(rows)


def records_at(spark: SparkSession, path: str, offsets: list[int]) -> DataFrame:
    """(offset, record fields) of the lines that begin at a few given bytes of a file, each read at its place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():  # a folder that one task wrote has one file
        parts = [p for p, _ in _files(spark, path, False) if p.getName()[:1] not in ("_", ".")]
        if len(parts) != 1:
            raise ValueError(f"{path} has {len(parts)} files; an offset is a place in one file")
        at = parts[0]
    stream = fs.open(at)
    rows = []
    try:
        for offset in offsets:
            stream.seek(offset)
            reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"), 1024)
            rows.append((offset, reader.readLine()))
    finally:
        stream.close()
    return _decoded_lines(spark.createDataFrame(rows, "offset long, line string"))


def line_counts_by_file(lines: DataFrame) -> DataFrame:
    """(file, lines)."""
    return lines.groupBy("file").agg(F.count("*").alias("lines"))


def splits(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, start, length, lines): the byte ranges that tasks read a path in; each line is in one. Ranges without a line are left out."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(path)
    m = "_metadata."
    return rows.groupBy(F.col(m + "file_path").alias("file"), F.col(m + "file_block_start").alias("start"), F.col(m + "file_block_length").alias("length")).agg(F.count("*").alias("lines"))
