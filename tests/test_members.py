"""Detectors over the same rows stand side by side, and scores carry what stands in their rows."""

import pytest
from pyspark.sql import functions as F
from tendersift import catalog
from tendersift.operators import detectors
from tendersift.storage import stored

MEMBERS = {"x": ["a", "b"], "y": ["b", "c"], "z": ["c"]}


def rows(df, *columns):
    return sorted(str([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns]) for r in df.collect())


@pytest.fixture(scope="module")
def matrix(spark):
    data = [(f"t{i}", f"w{i}", float(i % 7), None if i % 5 == 0 else float(i * i % 11), float(i % 3)) for i in range(60)]
    return stored(spark.createDataFrame(data, "transaction_id string, award_id string, a double, b double, c double"), "matrix")


def test_members_side_by_side_are_those_calibrated_alone(matrix):
    apart = {}
    for name, features in MEMBERS.items():
        scores = stored(detectors.tail_scores(matrix, matrix, features).withColumn("score", F.round("score", 6)), "scores")
        apart[name] = stored(detectors.calibrated(scores, scores), "member")
    found = detectors.calibrated_members(matrix, MEMBERS, 6)
    methods = {"maximum": None, "median": None, "weighted_mean": {"x": 0.5, "y": 0.25, "z": 0.25}}
    columns = ("transaction_id", "award_id", "method", "lower", "mid", "upper", "disagreement")
    assert rows(detectors.ensembles_of(found, list(MEMBERS), methods), *columns) == rows(detectors.ensembles(apart, methods), *columns)
    columns = ("transaction_id", "award_id", "runs", "least", "most", "median", "mad")
    assert rows(detectors.stability_of(found, list(MEMBERS)), *columns) == rows(detectors.stability(apart), *columns)
    with pytest.raises(ValueError, match="different rows"):
        detectors.calibrated_members(matrix, {"x": ["b"], "y": ["c"]}, 6)


@pytest.mark.parametrize("name", ["j13_ensembles", "j14_stability", "j7_model_of_earlier_years"])
def test_no_rows_are_joined_by_identity(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("transaction_id" in x for x in joins)
    assert not any("Aggregate" in x and "transaction_id" in x for x in plan.splitlines())


def test_scores_keep_the_columns_of_their_rows(matrix):
    scores = stored(detectors.tail_scores(matrix, matrix, ["a", "b"], keep=["c", "a"]), "scores")
    found = detectors.calibrated(scores, scores, ["c", "a"])
    assert rows(found, "transaction_id", "c", "a") == rows(matrix, "transaction_id", "c", "a")
    apart = detectors.tail_scores(matrix, matrix, ["a", "b"])
    assert rows(found, "transaction_id", "score") == rows(apart, "transaction_id", "score")
