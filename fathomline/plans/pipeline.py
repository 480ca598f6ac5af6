"""The whole curation: scan, normalize, de-duplicate, index by each key."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.exprs import decoded
from fathomline.operators import dedup, index
from fathomline.operators.formats import normalize
from fathomline.plans.progress import Progress, watched
from fathomline.schema import FIELDS, KEYS, check_key
from fathomline.shared import clear, mark, materialize
from fathomline.sources import files, text


@dataclass(frozen=True)
class Curation:
    """What a curation does; ``template`` shows the defaults."""

    input: str = ""
    output: str = ""
    keys: tuple[str, ...] = ("user", "email")
    recursive: bool = False
    partitions: int | None = None

    @staticmethod
    def template() -> dict:
        return asdict(Curation())


@dataclass(frozen=True)
class Curated:
    records: str
    lookups: dict[str, str] = field(default_factory=dict)


def normalize_stage(
    spark: SparkSession, target: str | list[str], output: str, format: str, recursive: bool = False, skip_prefix: str | None = None, skip_suffix: str | None = None, append: bool = True, overwrite: bool = False, progress: Progress | None = None
) -> None:
    """Raw lines to JSON records; an existing output is added to or, with ``overwrite``, replaced."""
    lines = watched(progress, text.read_lines(spark, target, recursive=recursive, skip_prefix=skip_prefix, skip_suffix=skip_suffix), "normalize: lines")
    records = watched(progress, normalize(lines, format), "normalize: records")
    files.write_records(records, output, append=append and not overwrite, overwrite=overwrite)


def dedup_stage(spark: SparkSession, target: str | list[str], output: str, append: bool = False, seen: str | None = None, save: str | None = None, progress: Progress | None = None) -> None:
    """Distinct lines; those of the ``seen`` table are left out, and what this run emits may be saved for later."""
    lines = watched(progress, text.read_lines(spark, target).select("line"), "dedup: lines")
    fresh = dedup.dedup_incremental(lines, spark.read.parquet(seen)) if seen else dedup.dedup_lines(lines)
    fresh = watched(progress, fresh, "dedup: new")
    if not save:
        fresh.write.mode("append" if append else "errorifexists").text(output)
        return
    before = mark()
    held = materialize(fresh, "fresh")  # written twice, made once; lines of earlier runs aren't saved again
    held.write.mode("append" if append else "errorifexists").text(output)
    held.write.mode("append").parquet(save)
    clear(spark, before)


def index_stage(spark: SparkSession, records: str, output: str, key: str, partitions: int | None = None, progress: Progress | None = None) -> None:
    """The sorted lookup of one key."""
    check_key(key, KEYS)
    built = index.build_lookup(text.read_records(spark, records), key, partitions)
    index.save_lookup(watched(progress, built, "index: records"), key, output)


def offsets_stage(spark: SparkSession, lines: str, output: str, key: str, progress: Progress | None = None) -> None:
    """The unsorted index of offsets of a file of JSON lines, in parts."""
    check_key(key, KEYS)
    made = index.index_build(text.records_with_offsets(spark, lines), key)
    files.write_index_parts(watched(progress, made, "index: entries"), output)


def sort_stage(spark: SparkSession, parts: str, output: str, partitions: int = 200, progress: Progress | None = None) -> None:
    """A stored index sorted over the whole dataset, in files of disjoint ranges whose names follow the order."""
    entries = spark.read.parquet(parts)
    if progress:
        progress.note("sort: read", entries.count())
    ordered = index.sort_index(entries, partitions)
    watched(progress, ordered, "sort: merged").write.mode("errorifexists").parquet(output)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(place, digest, offset) of a sorted index as it lies on disk: by file name, then by row in the file."""
    rows = spark.read.parquet(path).select("digest", "offset", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    # one row a file is left here; the numbers in names have five digits or more
    order = Window.orderBy(F.length("file"), "file")
    starts = sizes.select("file", (F.sum("n").over(order) - F.col("n")).alias("before"))
    return rows.join(starts, "file").select((F.col("row") + F.col("before") + 1).alias("place"), "digest", "offset")


def curate(spark: SparkSession, plan: Curation) -> Curated:
    """JSON records to distinct ones and a lookup for each key.

    The distinct records are written once and read for each key, so the lookups don't repeat the scan.
    """
    for key in plan.keys:
        check_key(key, KEYS)
    lines = text.read_lines(spark, plan.input, recursive=plan.recursive).select("line")
    records = dedup.dedup_lines(lines).select(decoded(F.col("line")).alias("r")).select(*[F.col(f"r.{f}").alias(f) for f in FIELDS])
    at = f"{plan.output.rstrip('/')}/records"
    records.write.mode("errorifexists").parquet(at)
    kept = spark.read.parquet(at)
    lookups = {}
    for key in plan.keys:
        lookups[key] = f"{plan.output.rstrip('/')}/lookup-{key}"
        index.write_lookup(kept, key, lookups[key], plan.partitions)
    return Curated(at, lookups)


def lookup(spark: SparkSession, made: Curated, key: str) -> DataFrame:
    """The lookup of a key; a key that wasn't indexed is an error."""
    if key not in made.lookups:
        raise ValueError(f"{key} was not indexed; indexed: {', '.join(made.lookups)}")
    return index.read_lookup(spark, made.lookups[key])
