import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tendersift.llm import mixing as mx

from .oracle import rows_of

SCHEMA = "doc_id bigint, text string, source string"


def plain_targets(sizes, weights=(3, 1, 2), total=Fraction(3, 2), most=2):
    """Shares by weight; what stands above its limit is cut to it and the excess dealt again, until none does."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = total * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: Fraction(most * sizes[s]) if s in full else rest * weight[s] / open_ for s in names}
        more = {s for s in names if share[s] > most * sizes[s]}
        if not more:
            return share
        full |= more


def plain_seats(target, house):
    seats = dict.fromkeys(target, 0)
    for _ in range(house):
        seats[max(target, key=lambda s: (target[s] / (2 * seats[s] + 1), -s))] += 1
    return seats


def rows(seed=3, n=400):
    rnd = random.Random(seed)
    out = [(i, " ".join("w" for _ in range(rnd.randrange(40))), rnd.choice(["b", "b", "b", "a", "é", None, "c€", "tiny"])) for i in range(n)]
    return out + [(900, None, "b"), (None, "one two", "a"), (901, "x " * 50_000, "z"), out[5], out[5], (902, "", "only-empty")]


def test_targets_and_totals(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("Size", F.lit("clash")).repartition(5)
    got = mx.mixed(df).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for _, text, source in rows():
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    again = mx.mixed(spark.createDataFrame(list(reversed(rows())), SCHEMA).repartition(3)).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_quotas_are_those_of_the_plain_method_at_every_shard(spark):
    rnd = random.Random(5)
    for n in (1, 2, 9):
        target = {i: rnd.choice([0.0, 1.0, 7.5, rnd.random() * 3000]) for i in range(n)} | {n: 500.0}
        df = spark.createDataFrame([(i, t) for i, t in target.items()], "number int, target double")
        got = {(r.number, r.shard): r for r in mx.quotas(df, 10, 7).collect()}
        house = sum(int(t / 10 + 0.5) for t in target.values())
        before = dict.fromkeys(target, 0)
        for shard in range(7):
            seats = plain_seats({i: t for i, t in target.items() if t}, house * (shard + 1) // 7)
            for i, s in seats.items():
                assert (got[i, shard].upto, got[i, shard].quota) == (s, s - before[i])
            before |= seats
        assert all(before[i] == int(t / 10 + 0.5) for i, t in target.items())


def test_pieces_fill_the_quotas(spark):
    mix = mx.Mix(block=16, fine=1, shards=5)
    df = spark.createDataFrame(rows(), SCHEMA)
    found = mx.pieces(df, mix).groupBy("source", "shard").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).collect()
    _, share, words = mx.plan(df, mix)
    number = {r.number: r.source for r in mx.plan(df, mix)[0].select("number", "source").distinct().collect()}
    quota = {(number[r.number], r.shard): r.quota for r in share.collect()}
    assert words == 16
    for r in found:
        assert quota[r.source, r.shard] * 16 - 32 <= r.n <= quota[r.source, r.shard] * 16  # short last blocks
    total = {r.source: r.n for r in mx.mixed(df, mix).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    for source, n in total.items():
        assert n == sum(r.n for r in found if r.source == source)


def test_bins_do_not_change_the_order(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken))
    one = sorted(map(key, mx.mixed(df).collect()))
    monkeypatch.setattr(mx, "BIN_ROWS", 7)
    assert one == sorted(map(key, mx.mixed(df).collect()))


def test_sql_and_empty_table(spark):
    left, right = rows_of(spark, mx.query, mx.ORACLE_SQL, "/root/testdata/sf0.001")
    assert left == right
    assert mx.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mx.mixed(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [0]
    with pytest.raises(ValueError):
        mx.Mix(total=(5, 2))
