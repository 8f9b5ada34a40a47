"""Case folding against Unicode's table."""

import sys

from pyspark.sql import functions as F
from tendersift.functions import text
from tendersift.operators import identity


def test_every_code_point_folds(spark):
    """Alone, and between others in one text."""
    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    rows = [("".join(every[i : i + 64]),) for i in range(0, len(every), 64)] + [(x,) for x in every if x.casefold() != x] + [("Straße İstanbul ΟΔΟΣ ﬃ",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").repartition(8)
    wrong = [r.t for r in df.select("t", text.casefold(F.col("t")).alias("f")).collect() if r.f != (None if r.t is None else r.t.casefold())]
    assert not wrong, wrong[:3]


def test_identities_fold(spark):
    df = spark.createDataFrame([("STRASSE  Bau",), ("Straße Bau",), ("straẞe bau ",), ("Strase Bau",)], "recipient_name string")
    keys = [r.vendor_key for r in identity.with_vendor(df).collect()]
    assert keys[:3] == ["entity:normalized_name:strasse bau"] * 3 and keys[3] != keys[0]
