"""Decimal statistics against plain fractions."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tendersift.functions import exact


def quantile(values, p):
    x, place = sorted(values), (len(values) - 1) * p
    low = int(place)
    high = min(low + 1, len(x) - 1)
    return x[low] + (x[high] - x[low]) * (place - low)


def test_equal_plain_fractions(spark):
    rnd = random.Random(1)
    rows = [(g, Decimal(rnd.randrange(-(10**n), 10**n)).scaleb(-6)) for g, n in (("a", 26), ("b", 20), ("c", 2)) for _ in range(57)] + [("one", Decimal("-0.000001")), ("two", Decimal(10**20)), ("two", Decimal(10**20) + Decimal("0.000001"))]
    df = spark.createDataFrame(rows, "group string, value decimal(28,6)")
    got = {r.group: r for r in exact.summaries(df.groupBy("group", "value").agg(F.count("*").alias("n")), 6).collect()}
    for g in ("a", "b", "c", "one", "two"):
        x = [Fraction(v) for k, v in rows if k == g]
        q = [quantile(x, Fraction(k, 4)) for k in range(5)]
        want = {"least": q[0], "q1": q[1], "median": q[2], "q3": q[3], "most": q[4], "iqr": q[3] - q[1], "mad": quantile([abs(v - q[2]) for v in x], Fraction(1, 2))}
        assert {k: Fraction(got[g][k]) for k in want} == want and got[g]["size"] == len(x)
    assert got["two"]["iqr"] == Decimal("0.0000005")  # doubles see no difference


def test_one_text_for_equal_values(spark):
    texts = ["0.000000", "-0.000000", "1.500000", "-100.000000", "12345678901234567890.000001", "0.000010"]
    df = spark.createDataFrame([(Decimal(t),) for t in texts] + [(None,)], "v decimal(28,6)")
    want = ["0", "0", "1.5", "-100", "12345678901234567890.000001", "0.00001", None]
    assert [r.t for r in df.select(exact.canonical_text(F.col("v")).alias("t")).collect()] == want
    wide = df.select(F.col("v").cast("decimal(38,10)").alias("v")).select(exact.canonical_text(F.col("v")).alias("t"))
    assert [r.t for r in wide.collect()] == want
    whole = spark.createDataFrame([(Decimal(1000),), (Decimal(0),)], "v decimal(20,0)")
    assert [r.t for r in whole.select(exact.canonical_text(F.col("v")).alias("t")).collect()] == ["1000", "0"]


def test_positions_tell_values_apart_that_doubles_confuse(spark):
    base = Decimal(10) ** 18
    members = spark.createDataFrame([("g", base + Decimal(i).scaleb(-6), 1 + i) for i in range(3)], "group string, value decimal(28,6), n int")
    asked = spark.createDataFrame([("t", "g", base + Decimal("0.000001")), ("u", "g", base - 1), ("v", "g", base + 1)], "id string, group string, value decimal(28,6)")
    assert {r.id: (r.peers, r.less, r.equal) for r in exact.positions(asked, members, ["id"], 6).collect()} == {"t": (6, 1, 2), "u": (6, 0, 0), "v": (6, 6, 0)}
    with pytest.raises(ValueError):
        exact.units(F.col("value"), 9)
