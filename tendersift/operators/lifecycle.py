"""Base awards and their modifications, told by the modification number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.functions.text import clean


def is_zero_modification(number: Column) -> Column:
    """Whether a modification number consists of zeros; false if it is missing."""
    return F.coalesce(clean(number).rlike("^0+$"), F.lit(False))


def lifecycle(number: Column) -> Column:
    """base_award, modification, or unknown for a missing number."""
    return F.when(clean(number).isNull(), "unknown").when(is_zero_modification(number), "base_award").otherwise("modification")


def normalized_number(number: Column) -> Column:
    """Upper case; any run of zeros is 0."""
    return F.when(is_zero_modification(number), "0").otherwise(F.upper(clean(number)))


def with_lifecycle(df: DataFrame) -> DataFrame:
    return df.withColumns({"lifecycle": lifecycle(F.col("modification_number")), "modification": normalized_number(F.col("modification_number"))})
