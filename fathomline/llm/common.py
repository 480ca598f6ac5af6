"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.shared import materialize

__all__ = ["SPACES", "WORD", "materialize", "table", "text_key", "tokenizer_path"]

#: Words are runs of anything but these six ASCII characters (space and 09 to 0D).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The file of one of the installed public vocabularies."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def text_key(column: str):
    """With a document's id, tells rows apart that share the id but not the text."""
    return F.xxhash64(F.col(column))
