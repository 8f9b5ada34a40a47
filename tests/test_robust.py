import random
import statistics

from tendersift.functions import robust


def quantile(x, p):
    x = sorted(x)
    h = (len(x) - 1) * p
    lo = int(h)
    return x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (h - lo)


def brute(group, value, own):
    x = list(group)
    if own is not None:
        x.remove(own)
    if not x:
        return (0, 0, 0) + (None,) * 8
    less, equal = sum(v < value for v in x), sum(v == value for v in x)
    q1, med, q3 = (quantile(x, p) for p in (0.25, 0.5, 0.75))
    mad = statistics.median(abs(v - med) for v in x)
    z = robust.NORMAL_MAD * (value - med) / mad if mad else None
    d = (value - med) / (q3 - q1) if q3 != q1 else None
    return (len(x), less, equal, (less + equal / 2) / len(x), q1, med, q3, q3 - q1, mad, z, d)


NAMES = ("peers", "less", "equal", "position", "q1", "median", "q3", "iqr", "mad", "z", "distance")


def same(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_against_brute_force(spark):
    rnd = random.Random(0)
    groups = {f"g{i}": [float(rnd.choice([rnd.randrange(-5, 6), rnd.randrange(-500, 500)])) for _ in range(size)] for i, size in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 20, 33, 60])}
    members = spark.createDataFrame([(g, i, v) for g, x in groups.items() for i, v in enumerate(x)], "group string, id int, value double")
    for r in robust.leave_one_out(members, ["id"]).collect():
        want = brute(groups[r.group], r.value, r.value)
        assert all(same(r[n], w) for n, w in zip(NAMES, want, strict=True)), (r, want)
    counts = members.groupBy("group", "value").count().withColumnRenamed("count", "n")
    asked = [(g, i, float(v), o) for g, x in groups.items() for i, (v, o) in enumerate([(0.5, None), (1e6, None), (x[0] - 1, x[0]), (x[0], None)])]
    targets = spark.createDataFrame(asked, "group string, id int, value double, own double")
    own = {(g, i): o for g, i, _, o in asked}
    for r in robust.compare(targets, counts, ["id"]).collect():
        want = brute(groups[r.group], r.value, own[r.group, r.id])
        assert all(same(r[n], w) for n, w in zip(NAMES, want, strict=True)), (r, want)


def test_large_groups_are_ordered_in_pieces(spark):
    """Scores in [0, 1]: no piece holds much more than its share of the distinct values, and the counts are those of sorting."""
    rnd = random.Random(5)
    values = {"big": sorted({rnd.random() ** 3 for _ in range(4000)}), "small": [0.25, 0.5]}
    rows = [(g, v, rnd.randrange(1, 4)) for g, x in values.items() for v in x]
    counts = spark.createDataFrame(rows, "group string, value double, n bigint")
    got = robust.running_counts(counts, ["group"], large=1000)
    for g in values:
        mine, below = {v: n for h, v, n in rows if h == g}, 0
        for r in sorted(got.filter(got.group == g).collect(), key=lambda r: r.value):
            assert (r.n, r.before, r.size) == (mine[r.value], below, sum(mine.values()))
            below += r.n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bin" in plan and "bin" not in robust.running_counts(counts, ["group"])._jdf.queryExecution().optimizedPlan().toString()


def test_column_quantiles_use_no_whole_column_buffer(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tendersift.operators import preprocessing

    def refused(*_):
        raise AssertionError("percentile merges all distinct values in one task")

    monkeypatch.setattr(F, "percentile", refused)
    rnd = random.Random(3)
    x = [rnd.choice([rnd.random(), rnd.random() * 1e6, -rnd.random(), 0.5]) for _ in range(501)]
    df = spark.createDataFrame([(v, None if i % 3 else v, None) for i, v in enumerate(x)], "a double, b double, c double")
    got = robust.column_quantiles(df, ["a", "b", "c"], (0.25, 0.5, 0.75))
    for c, values in (("a", x), ("b", x[::3])):
        assert all(same(g, quantile(values, p)) for g, p in zip(got[c], (0.25, 0.5, 0.75), strict=True))
    assert got["c"] is None
    fitted = preprocessing.fit(df, preprocessing.robust_rules(["a"]))[0]
    assert same(fitted.fill, quantile(x, 0.5)) and same(fitted.center, fitted.fill)


def test_groups_in_tasks_equal_brute_force(spark):
    """Several values of a group at once, nulls among them, with and without one member left out, in one shuffle."""
    rnd = random.Random(3)
    some = lambda: rnd.choice([None, float(rnd.randrange(-3, 4)), rnd.random()])
    members = [(g, some(), some()) for g, size in enumerate([1, 2, 3, 4, 5, 8, 9, 30, 61]) for _ in range(size)]
    targets = [(f"in{i}", *m, True) for i, m in enumerate(members)] + [(f"out{i}", rnd.randrange(9), some(), some(), False) for i in range(80)] + [("alone", 77, 1.0, None, False)]
    found = robust.compared_in_groups(spark.createDataFrame(targets, "id string, group bigint, a double, b double, left_out boolean"), spark.createDataFrame(members, "group bigint, a double, b double"), "id", ["a", "b"], 4 * robust.TASK_ROWS)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = {r.id: r for r in found.collect()}
    assert len(rows) == len(targets)
    for name, g, a, b, out in targets:
        for k, v in enumerate((a, b)):
            want = (None, None, None)
            if v is not None:
                want = [brute([m[k + 1] for m in members if m[0] == g and m[k + 1] is not None], v, v if out else None)[NAMES.index(x)] for x in ("position", "z", "distance")]
            assert all(same(rows[name][f"{'ab'[k]}_{x}"], w) for x, w in zip(("position", "z", "distance"), want, strict=True)), (name, k)
