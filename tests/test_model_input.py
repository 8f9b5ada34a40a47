"""The feature catalog, preprocessing rules, frozen references and populations that must agree."""

import math

import pytest
from pyspark.sql import functions as F
from tendersift.joins import same_population
from tendersift.operators import amount, detectors, feature_catalog, peers, preprocessing, quality, review
from tendersift.sources import archive

Rule = preprocessing.Rule


def test_selections_are_pinned():
    names = [f.name for f in feature_catalog.of("amount", ["direction", "support"])]
    assert names == ["amount_direction_code", "amount_same_direction_peer_fraction"]
    assert feature_catalog.Selection(tuple(names)).counts() == {"amount": 2}
    assert feature_catalog.differences(["amount_direction_code", "vendor_new_award_count", "x"], names) == (("amount_same_direction_peer_fraction",), ("vendor_new_award_count",))
    for wrong in ((), ("amount_direction_code",) * 2, ("nothing",)):
        with pytest.raises(ValueError):
            feature_catalog.Selection(wrong)
    with pytest.raises(ValueError, match="another catalog"):
        feature_catalog.Selection(tuple(names), "0" * 64)
    with pytest.raises(ValueError):
        feature_catalog.of("amount", ["process"])


def test_selected_rows_may_have_to_be_complete(spark):
    rows = spark.createDataFrame([("a", "w", 1.0), ("b", "w", None)], "transaction_id string, award_id string, amount_direction_code double")
    chosen = feature_catalog.Selection(("amount_direction_code",))
    assert feature_catalog.selected(rows, chosen).count() == 2
    with pytest.raises(Exception, match="missing in a row"):
        feature_catalog.selected(rows, chosen, require_complete=True).collect()
    assert [r.transaction_id for r in feature_catalog.selected(feature_catalog.complete(rows, chosen), chosen, True).collect()] == ["a"]


def test_rules_are_checked_and_scales_are_of_filled_values(spark):
    for wrong in ({"missing": "constant"}, {"fill": 1.0}, {"low": None}, {"low": 0.8}, {"transform": "identity"}, {"missing": "constant", "fill": math.inf}):
        with pytest.raises(ValueError):
            Rule(**({"feature": "x", "low": 0.25, "high": 0.75} | wrong))
    rows = spark.createDataFrame([("a", "w", 1.0, 4.0), ("b", "w", None, 4.0), ("c", "w", 3.0, 4.0), ("d", "w", 8.0, 4.0)], "transaction_id string, award_id string, x double, flat double")
    (standard,) = preprocessing.fit(rows, (Rule("x", "constant", "standard_scale", fill=0.0),))
    assert (standard.center, standard.absent) == (3.0, 1) and math.isclose(standard.scale, math.sqrt(9.5))
    got = {r.transaction_id: (round(r.x, 9), r.x__missing) for r in preprocessing.apply(rows, (standard,)).collect()}
    assert got["b"] == (round(-3 / math.sqrt(9.5), 9), 1) and got["c"] == (0.0, 0)
    with pytest.raises(ValueError, match="lack it"):
        preprocessing.fit(rows, (Rule("x", "require_present", "identity"),))
    with pytest.raises(ValueError, match="no spread"):
        preprocessing.fit(rows, (Rule("flat", transform="standard_scale"),))
    present = preprocessing.fit(rows.dropna(), (Rule("x", "require_present", "identity"),))
    with pytest.raises(Exception, match="missing in a row"):
        preprocessing.apply(rows, present).collect()


def test_populations_must_agree(spark):
    names = "transaction_id string, award_id string, lower double, mid double, upper double"
    a = spark.createDataFrame([("a", "w", 0.0, 0.5, 1.0), ("b", "w", 0.0, 0.25, 1.0)], names)
    other = spark.createDataFrame([("a", "w", 0.0, 0.5, 1.0), ("c", "w", 0.0, 0.25, 1.0)], names)
    same_population({"a": a, "b": a.orderBy("mid")}, ["transaction_id"])
    for wrong in (other, a.limit(1)):
        for run in (lambda b: detectors.ensemble({"a": a, "b": b}, method="median"), lambda b: detectors.stability({"a": a, "b": b}), lambda b: detectors.spearman(a, b)):
            with pytest.raises(ValueError, match="different rows"):
                run(wrong)
    with pytest.raises(ValueError, match="twice"):
        same_population({"a": a.union(a)}, ["transaction_id"])
    with pytest.raises(ValueError, match="different rows"):
        review.evaluation(a.withColumnRenamed("mid", "score"), other.select("transaction_id", F.lit(1).alias("truth")))
    with pytest.raises(ValueError, match="two different"):
        flat = a.select("transaction_id", "award_id", F.lit(1.0).alias("score"))
        detectors.calibrated(flat, flat)
    assert [r.mid for r in detectors.oriented(a, False, "mid").orderBy("transaction_id").collect()] == [-0.5, -0.25]


def test_evidence_counts_the_whole_catalog(spark):
    cells = spark.createDataFrame([("a", 1.0, None), ("a", None, "why"), ("b", None, "why"), ("b", None, "why")], "transaction_id string, value double, reason string")
    scores = spark.createDataFrame([("a", "w", 0.5), ("b", "w", 0.25)], "transaction_id string, award_id string, mid double")
    got = {r.transaction_id: (r.available, r.missing) for r in review.evidence(cells, scores).collect()}
    assert got == {"a": (1, 1), "b": (0, 2)}
    with pytest.raises(ValueError, match="different rows"):
        review.evidence(cells.filter("transaction_id = 'a'"), scores)


def test_a_target_that_differs_from_the_reference_fails(spark):
    held = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "transaction_id string, amount double")
    asked = spark.createDataFrame([("a", 1.0), ("c", 9.0)], "transaction_id string, amount double")
    found = peers.indexed(asked, held, "transaction_id", {"amount": F.col("amount")})
    assert {r.transaction_id: r.indexed for r in found.collect()} == {"a": True, "c": False}
    with pytest.raises(Exception, match="differs from the reference: a"):
        peers.indexed(asked.withColumn("amount", F.lit(5.0)), held, "transaction_id", {"amount": F.col("amount")}).collect()


def test_an_external_amount_leaves_nothing_out(spark):
    level = (peers.Level("all", None, None, time=None),)
    made = lambda data: spark.createDataFrame(data, "transaction_id string, action_obligation double")
    held = made([(f"t{i}", float(i)) for i in range(11)])
    got = {r.transaction_id: r for r in amount.features(held, 10, levels=level, targets=made([("t5", 5.0), ("new", 5.0), ("none", None)])).collect()}
    assert (got["t5"].peers, got["t5"].amount_signed_position) == (10, 0.5) and got["new"].peers == 11
    assert got["new"].amount_signed_position == 0.5 and got["none"].reason == "target_amount_missing"


def test_profile_order_and_named_gates(spark):
    found = spark.createDataFrame([("missing_pattern", "a", 1), ("missing_pattern", "b", 3), ("field", "z", 2), ("population", "all", 4)], "section string, name string, n bigint")
    assert [r.name for r in quality.in_order(found).collect()] == ["z", "b", "a", "all"]
    specs = {"big": (quality.Rule("population", "all", least=9, share=False),), "small": (quality.Rule("population", "all", least=1, share=False),)}
    assert {r.gate: r.status for r in quality.gates(found, specs).collect()} == {"big": "blocked", "small": "ready"}
    with pytest.raises(ValueError):
        quality.gates(found, specs, ["none"])


def test_mapping_and_load_report(spark):
    m = archive.mapping(["contract_award_unique_key", "recipient_name_raw", "odd", "row_seq"])
    assert m.fallbacks == ("recipient_name_raw",) and m.unmapped == ("odd",) and "description" in m.absent and len(archive.ALIASES) == 33
    rows = spark.createDataFrame([("a", "loaded", []), ("a", "dropped_exact_duplicate", []), ("a", "quarantined", []), ("b", "quarantined", ["action_date"]), (None, "quarantined", [])], "transaction_id string, outcome string, problems array<string>")
    report = archive.load_report(rows)
    assert tuple(report.first()) == (5, 1, 1, 1, 1, 1)
    archive.within_budget(report, 3)
    with pytest.raises(archive.ArchiveError):
        archive.within_budget(report, 2)


def test_zero_inflated_features_take_a_deviation_and_all_faults_are_named(spark):
    """Quartiles that coincide are no scale; most shares are 0 in large populations."""
    data = [(f"t{i:03}", "w", float(i % 10 == 0) * i, 0.0 if i % 50 else 1.0, 1.0) for i in range(200)]
    rows = spark.createDataFrame(data, "transaction_id string, award_id string, share double, rare double, flat double")
    with pytest.raises(ValueError) as e:
        preprocessing.fit(rows, preprocessing.robust_rules(["share", "rare", "flat"]))
    assert [n in str(e.value) for n in ("share has no spread", "rare has no spread", "flat has no spread")] == [True] * 3
    fitted = preprocessing.fit(rows, (Rule("share", transform="standard_scale"), Rule("rare", transform="standard_scale"), Rule("flat", transform="identity")))
    assert all(x.scale > 0 for x in fitted) and preprocessing.apply(rows, fitted).filter("share IS NULL OR flat <> 1").count() == 0
