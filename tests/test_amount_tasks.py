"""Amounts of a group compared in a task or by counts, and families that are counted where they stand."""

import pytest
from tendersift.functions import robust
from tendersift.operators import amount, peers

LEVELS = (peers.Level("one", None, "psc", time=None), peers.Level("all", None, None, time=None))


def rows(df):
    return sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in df.collect())


def keyed(spark, n, first=0):
    data = [(f"t{i}", float((i * i - 7 * i) % 23 - 9), "A" if i % 3 else "B" if i % 2 else None) for i in range(first, n)] + [("odd", 5.0, "C")]
    return amount.keyed(spark.createDataFrame(data, "transaction_id string, amount double, psc_code string"), LEVELS)


@pytest.mark.parametrize("own", [1, 0])
def test_amounts_are_shuffled_once_and_compared_whole(spark, monkeypatch, own):
    held = keyed(spark, 60)
    asked = held if own else keyed(spark, 75, 50)
    want = rows(amount._features(asked, held, own, 10, LEVELS, group_rows=0))
    partly = rows(amount._features(asked, held, own, 10, LEVELS, group_rows=20))
    monkeypatch.setattr(amount, "compare", lambda *x, **y: pytest.fail("counted and stored again"))
    found = amount._features(asked, held, own, 10, LEVELS)
    assert rows(found) == want == partly
    if own:  # a part of those held, by itself
        some = asked.filter("transaction_id < 't3'")
        told = {r.transaction_id for r in some.collect()}
        assert rows(amount._features(some, held, 1, 10, LEVELS)) == rows(found.filter(found.transaction_id.isin(*told)))
    nobody = amount._features(asked, held, own, 1000, LEVELS)
    assert {(r.level, r.peers, r.reason) for r in nobody.collect()} == {(None, None, "no_peer_group_with_required_support")}


def test_values_of_one_group_are_those_of_compare(spark):
    x = [1.0, 1.0, 2.0, 4.0, 4.0, 9.0, -3.0]
    counts = spark.createDataFrame([("g", v, 1) for v in x], "group string, value double, n bigint").groupBy("group", "value").agg({"n": "sum"}).toDF("group", "value", "n")
    for left_out in (True, False):
        asked = spark.createDataFrame([(i, "g", v, v if left_out else None) for i, v in enumerate(x)], "id int, group string, value double, own double")
        want = {r.id: r for r in robust.compare(asked, counts, ["id"]).collect()}
        got = robust.compared_values(robust.np.sort(x), robust.np.array(x), left_out)
        assert all(got[k][i] == want[i][k] for i in want for k in ("peers", "position", "z", "distance"))


def test_many_groups_give_the_same_places(spark):
    held = keyed(spark, 30)
    sizes = peers.group_counts(held, LEVELS).filter("members > 9")
    assert rows(peers.first_place(held, LEVELS, sizes, "transaction_id")) == rows(peers.first_place(held, LEVELS, sizes, "transaction_id", limit=0))
