"""Both ways of attaching a side of one row a key."""

from pyspark.sql import functions as F

from tendersift.llm.common import attached


def test_attached_is_a_left_join_on_both_ways(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i) for i in range(60)] + [(None, None, 0), (1, "hot", 1)], "doc_id long, k string, salt long")
    few = spark.createDataFrame([("hot", [1, 2]), ("k3", [3]), ("other", [])], "k string, more array<int>")
    want = sorted(str(tuple(r)) for r in rows.join(few, "k", "left").select("doc_id", "k", "salt", "more").collect())
    for limit in (0, 2, 3, 100):
        got = attached(rows, few, "k", "doc_id", F.size("more"), limit)
        assert sorted(str(tuple(r)) for r in got.select("doc_id", "k", "salt", "more").collect()) == want
    assert attached(rows, few.limit(0), "k", "doc_id", limit=0).count() == 62
