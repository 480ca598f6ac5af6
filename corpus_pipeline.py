"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases of all stages: a table without rows gives one without rows; texts are read whole,
however long; further columns pass through unchanged, whatever their names, but those of the last
stage; lang, source and n_chars may be missing, and n_chars follows the text where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline import shared
from fathomline.llm import dartminhash, packing, quality_rules, secret_scan, substring_dedup
from fathomline.llm.common import table, text_key


def _free(name: str, columns: list[str]) -> str:
    """The name, or one after it that no column has in any case of letters."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars after the text's length."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null, empty or blank text goes; repeated rows stay or go together; null ids are fine.
    """
    out = _free("__quality", docs.columns)
    return quality_rules.judge(docs, out=out).where(F.col(out)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least id; of repeated rows, one.

    A text without words (null, empty or blank) is a class of its own and stays; a null id counts as
    the least; of rows with the same id and text but other columns that differ, any one stays.
    """
    kept = dartminhash.classes(docs).where("kept").select(F.col("doc").alias("__doc"), F.col("key").alias("__key")).distinct()
    columns = docs.columns
    inside = [f"_{i}" for i in range(len(columns))]
    plain = docs.toDF(*inside)
    own_id, own_text = inside[columns.index("doc_id")], inside[columns.index("text")]
    keyed = plain.withColumns({"__own": F.col(own_id).cast("long"), "__text": text_key(own_text)})
    joined = keyed.join(kept, F.col("__own").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__key")), "left_semi")
    return joined.dropDuplicates(["__own", "__text"]).select(*inside).toDF(*columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that start in an earlier document too are cut out of the texts.

    A null text stays null; one of under 50 words, or with a null id, stays as it is; a text that is
    repeated whole becomes empty and stays; repeated rows and rows of one id don't cut each other.
    """
    out = _free("__dedup", docs.columns)
    return _with_text(docs, substring_dedup.remove_repeats(docs, out=out).withColumn("text", F.col(out)["kept"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, by whether one owner or many have them.

    A null text stays null; a null source is an owner of its own; repeated rows are masked alike, as
    are rows that share an id.
    """
    return _with_text(docs, secret_scan.redacted(docs, owner_col="source" if "source" in docs.columns else None))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary lengths, one piece each.

    A null or empty text is the end id alone; repeated rows have pieces each; a null id is kept.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: Tokens and near-duplicate classes can't be said in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; what lies between is written to the shared folder.

    When a stage's output is written, the tables that it made on the way are deleted.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared.shared_path(spark, f"stage-{name}")
        before = shared.mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        shared.clear(spark, before)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
