"""What is looked up or counted in place gives the same rows as the shuffled form, and does not multiply rows."""

import statistics

import pytest
from pyspark.sql import functions as F
from tendersift import catalog
from tendersift.functions import robust
from tendersift.operators import assemble, award_change, detectors, peers
from tendersift.storage import stored

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(f"t{i}", f"w{i}", float(i % 7), None if i % 5 == 0 else float(i * i % 11)) for i in range(60)] + [("none", "none", None, None)]
    return stored(spark.createDataFrame(rows, "transaction_id string, award_id string, a double, b double"), "matrix")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_tail_scores_keep_one_row_a_transaction(matrix, monkeypatch):
    found = detectors.tail_scores(matrix, matrix, FEATURES)
    assert "Generate" not in plan(found)
    want = rows(found)
    assert len(want) == 60
    monkeypatch.setattr(detectors._surprised, "__defaults__", (0,))
    assert rows(detectors.tail_scores(matrix, matrix, FEATURES)) == want


def test_equal_scores_are_compared_once(spark):
    scores = stored(spark.createDataFrame([(f"t{i}", f"w{i}", float(i % 3)) for i in range(30)], "transaction_id string, award_id string, score double"), "scores")
    found = detectors.calibrated(scores, scores)
    assert plan(found).count("Join") == 1
    assert {(r.score, round(r.lower, 6), round(r.upper, 6)) for r in found.collect()} == {(0.0, 0.0, 0.333333), (1.0, 0.333333, 0.666667), (2.0, 0.666667, 1.0)}


def test_ensembles_join_their_members_once(spark):
    make = lambda x: stored(spark.createDataFrame([("t", "w", x, x, x)], "transaction_id string, award_id string, lower double, mid double, upper double"), "member")
    members = {"x": make(0.25), "y": make(0.75)}
    found = detectors.ensembles(members, {"maximum": None, "weighted_mean": {"x": 0.5, "y": 0.5}})
    assert plan(found).count("Join") == 1
    assert {(r.method, r.mid) for r in found.collect()} == {("maximum", 0.75), ("weighted_mean", 0.5)}


def test_first_match_is_the_same_by_broadcast_and_by_shuffle(spark):
    levels = (peers.Level("one", None, "psc", False, None), peers.Level("all", None, None, False, None))
    df = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), ("4", None)], "id string, psc_code string")
    keyed = stored(peers.keyed(df, levels, ["id"]), "keyed")
    found = [peers.first_match(keyed, levels, peers.group_counts(keyed, levels), "id", lambda at: at("members") >= 2, limit) for limit in (10, 0)]
    assert rows(found[0].select("id", "best.level", "best.peer_key", "best.members")) == rows(found[1].select("id", "best.level", "best.peer_key", "best.members"))
    assert {r.id: r.level for r in found[0].select("id", "best.level").collect()} == {"1": "one", "2": "one", "3": "all", "4": "all"}


def test_completeness_counts_in_place(spark, monkeypatch):
    wide = spark.createDataFrame([("t", 1.0, None), ("u", None, None)], "transaction_id string, p double, q double")
    monkeypatch.setattr(assemble, "wide", lambda df: (wide, {"amount": ["p"], "vendor_frequency": ["q"]}))
    found = assemble.completeness(wide)
    assert "Generate" not in plan(found) and "Aggregate" not in plan(found)
    assert {(r.transaction_id, r.available, r.missing, r.completeness) for r in found.collect()} == {("t", 1, 1, 0.5), ("u", 0, 2, 0.0)}


@pytest.mark.parametrize(("name", "most"), [("f7_decimal_summaries", 3), ("c27_selected_features", 18), ("vendor_features", 13), ("competition_context_features", 18)])
def test_queries_write_the_columns_they_take_alone(spark, monkeypatch, name, most):
    widths = {}

    def keep(df, table):
        widths[table] = len(df.columns)
        return stored(df, table)

    monkeypatch.setattr(catalog, "stored", keep)
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert widths["canonical"] <= most


def test_values_of_the_training_rows_are_not_counted_again(matrix, monkeypatch):
    tables = []

    def keep(df, name):
        tables.append(name)
        return stored(df, name)

    want = rows(detectors.tail_scores_by(stored(detectors.tail_counts(matrix, FEATURES), "counts"), matrix, FEATURES))
    monkeypatch.setattr(detectors, "stored", keep)
    assert rows(detectors.tail_scores(matrix, matrix, FEATURES)) == want
    assert "tail-counts" not in tables


def test_rank_correlation_shuffles_counted_pairs_alone(spark, monkeypatch):
    """Each equal pair is one row, identities are not joined, and rho is that of the two runs."""
    x, y = [3.0, 1.0, 1.0, 2.0, 5.0, 5.0, 4.0] * 6, [1.0, 1.0, 2.0, 2.0, 9.0, 9.0, 3.0] * 6
    df = spark.createDataFrame([(str(i), "w", a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "transaction_id string, award_id string, x double, y double")
    rank = lambda v: [sum(w < k for w in v) + (sum(w == k for w in v) + 1) / 2 for k in v]
    tables = {}

    def keep(df, name):
        tables[name] = df
        return stored(df, name)

    monkeypatch.setattr(detectors, "stored", keep)
    found = detectors.rank_correlation(df, "x", "y").first().rho
    assert found == pytest.approx(statistics.correlation(rank(x), rank(y)), abs=1e-12)
    assert tables["rank-pairs"].count() == 6 and "transaction_id" not in tables["rank-pairs"].columns
    run = lambda c: df.withColumnRenamed(c, "mid")
    assert detectors.spearman(run("x"), run("y")).first().rho == pytest.approx(found, abs=1e-12)
    assert detectors.rank_correlation(df.withColumn("y", F.lit(0.1)), "x", "y").first().rho is None


def test_award_change_markets_are_the_same_in_tasks_and_by_counts(spark, monkeypatch):
    query = catalog.queries()["award_change_features"]
    want = rows(query(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(award_change._compared, "__defaults__", (40,))
    tables = []
    monkeypatch.setattr(award_change, "compare", lambda *x, **y: tables.append(x) or robust.compare(*x, **y))
    assert rows(query(spark, "/root/testdata/sf0.001")) == want
    assert len(tables) == 1
