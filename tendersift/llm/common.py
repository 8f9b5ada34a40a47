"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendersift.joins import BROADCAST_CELLS, attached, free_name, spread_join  # noqa: F401
from tendersift.storage import shared_dir, stored  # noqa: F401

#: Bytes of text that one numpy step works on; bounds the memory of a task.
STEP_BYTES = 1 << 20


def whole_text(name: str = "text") -> Column:
    """The column as a string, null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(name: str = "text") -> Column:
    """16 bytes that equal texts share."""
    return F.unhex(F.md5(whole_text(name).cast("binary")))
