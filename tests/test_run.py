"""Explanations, header profiles, the manifest and the plan of a run."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F
from tendersift.operators import explanation
from tendersift.plans.config import ForestRun, ReviewPlan
from tendersift.sources import documents, manifest, profiles
from tendersift.sources.archive import ArchiveError

CELLS = "transaction_id string, family string, feature string, value double, reason string"


def test_facts_hold_a_value_or_a_reason(spark):
    cells = spark.createDataFrame([("t", "f", "b", 1.0, None), ("t", "f", "a", None, "unknown"), ("t", "f", "c", 2.0, None), ("u", "f", "a", None, "unknown")], CELLS)
    got = {r.transaction_id: [(f.feature, f.narrative) for f in r.facts] for r in explanation.facts(cells, ["a", "b"]).collect()}
    assert got == {"t": [("a", "a unavailable: unknown"), ("b", "b = 1.0")], "u": [("a", "a unavailable: unknown")]}
    assert [r.transaction_id for r in explanation.facts(cells, ["a", "b"], include_missing=False).collect()] == ["t"]
    with pytest.raises(ValueError):
        explanation.facts(cells, ["a", "a"])


def test_summary_tells_ties_and_stability(spark):
    names = "transaction_id string, award_id string, lower double, score double, upper double, best_rank bigint, worst_rank bigint, flagged boolean, reason string, disagreement double"
    queue = spark.createDataFrame([("t", "w", 80.0, 85.0, 90.0, 1, 3, True, "above_top_n_boundary", 2.5), ("u", "w", 1.0, 1.0, 1.0, 4, 4, False, "below_top_n_boundary", 0.0)], names)
    share = spark.createDataFrame([("t", 0.5), ("u", 1.0)], "transaction_id string, completeness double")
    facts = explanation.facts(spark.createDataFrame([("t", "f", "a", 1.0, None)], CELLS), ["a"])
    plain = {r.transaction_id: r for r in explanation.explained(queue, share, facts).collect()}
    assert plain["t"].summary.startswith("in the queue by above_top_n_boundary; tied over ranks 1 to 3; score 85.0 of 100, from 80.0 to 90.0; detectors apart by 2.5; share of features known 0.5; one run only")
    assert plain["u"].summary.startswith("outside the queue by below_top_n_boundary; rank 4; ")
    assert plain["u"].facts is None
    runs = spark.createDataFrame([("t", "w", 0.5, 0.75, 0.125), ("u", "w", 0.0, 0.0, 0.0)], "transaction_id string, award_id string, least double, most double, mad double")
    assert "repeated runs spread over 25.0 with deviation 12.5" in explanation.explained(queue, share, facts, runs).filter("transaction_id = 't'").first().summary


def test_profiles_are_never_guessed():
    a = profiles.Profile("a", {"id": ("Id", "key"), "money": ("amount",)}, ("id", "money"))
    b = profiles.Profile("b", {"id": ("id",)}, ("id",))
    r = profiles.inspect(["ID ", "Key", "other"], a)
    assert r.bindings == {"id": ("ID", "Key")} and r.missing == ("money",) and r.unrecognized == ("other",) and r.redundant == ("id",) and not r.compatible
    assert profiles.resolve(["id"], [a, b]).profile == "b" and profiles.resolve(["id", "amount"], [a, b], "A").profile == "a"
    for headers, how in ((["id", "amount"], {}), (["x"], {}), (["id", "more"], {"allow_unrecognized": False}), (["id", "ID"], {}), (["id", " "], {})):
        with pytest.raises(ArchiveError):
            profiles.resolve(headers, [a, b], **how)


def test_manifest_tells_recipe_from_evidence(spark):
    one = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    same = spark.createDataFrame([(None, 2), ("x", 1), (None, 2)], "b string, a int")
    d = manifest.table_digest(one)
    assert d == manifest.table_digest(same) and d["rows"] == 3
    assert d["sha256"] != manifest.table_digest(one.distinct())["sha256"] and manifest.table_digest(one.limit(0))["rows"] == 0
    other = manifest.table_digest(one.distinct())
    runs = [manifest.Manifest("r", {"in": d}, (manifest.Stage("s", ("in",), "k=1", {"out": x}),), ("out",)) for x in (d, other)]
    assert runs[0].recipe() == runs[1].recipe() and runs[0].evidence() != runs[1].evidence()
    with pytest.raises(ValueError):
        manifest.Manifest("r", {"in": d}, (manifest.Stage("s", ("none",), "", {"out": d}),), ("out",))
    with pytest.raises(ValueError):
        manifest.Manifest("r", {"in": d}, (), ("out",))


def test_plans_are_checked():
    runs = (ForestRun("one", 11, primary=True), ForestRun("two", 29))
    assert ReviewPlan(("amount",), runs).primary.seed == 11
    wrong = [
        {"features": ()},
        {"forests": runs[:1]},
        {"forests": (runs[1], ForestRun("three", 5))},
        {"forests": (runs[0], ForestRun("two", 11))},
        {"forests": (runs[0], ForestRun("two", 29, sample=1.5))},
        {"forests": (runs[0], ForestRun("two", 29, features=0))},
        {"weights": (0.5, 0.6)},
        {"top": None},
        {"least": 1.0},
        {"ties": "some"},
        {"exports": ("json",)},
    ]
    for how in wrong:
        with pytest.raises(ValueError):
            ReviewPlan(**({"features": ("amount",), "forests": runs} | how))


def test_a_run_flags_what_is_extreme_among_peers_only(spark, monkeypatch, tmp_path):
    from tendersift.operators import assemble
    from tendersift.plans import run as review_run

    data = [(f"t{i:03}", "w", 100.0, float(i % 7), float(i % 5) if i % 4 else None, None) for i in range(120)] + [("odd", "w", 100.0, 90.0, 70.0, None)]
    rows = spark.createDataFrame(data, "transaction_id string, award_id string, action_obligation double, amount_z double, vendor_share double, amount__reason string").withColumn("vendor__reason", F.lit(None).cast("string"))
    monkeypatch.setattr(assemble, "wide", lambda df, features=None, targets=None, settings=None: (rows, {"amount": ["amount_z"], "vendor": ["vendor_share"]}))
    plan = ReviewPlan(("amount_z", "vendor_share"), (ForestRun("one", 1, 8, 64, primary=True), ForestRun("two", 2, 8, 64)), top=1)
    done = review_run.run(rows, plan)
    assert [r.transaction_id for r in done.decisions.filter("flagged").collect()] == ["odd"]
    assert done.stability.count() == 121 and done.cells.count() == 242
    names = {"transaction_id", "award_id"}
    told = rows.select(*names).withColumns({c: F.lit(None).cast("string") for c in ("recipient_name", "psc_code")})
    evidence = review_run.write(told, done, plan, str(tmp_path), parts=3)
    table = spark.read.csv(str(tmp_path / "csv"), header=False, escape='"').collect()
    assert len(table) == 122 and len(table[0]) == 46 and [r[0] for r in table if r[0].startswith("transaction_id")] == ["transaction_id"]
    explained = documents.read_json(spark, str(tmp_path / "json"), review_run.reported(told, done, plan)[0].schema)
    odd = {r.transaction_id: r for r in explained.collect()}["odd"]
    assert odd.flagged and odd.summary.startswith("in the queue") and [f.feature for f in odd.facts] == ["amount_z", "vendor_share"] and odd.completeness == 1.0
    assert spark.read.text(str(tmp_path / "evidence")).count() == 123
    assert evidence.final == ("decisions", "evidence", "csv")
    assert {n: f.sample for n, f in done.forests.items()} == {"one": 64, "two": 64}
    assert evidence.stages[0].outputs["forest one"] == {"trees": 8, "sha256": done.forests["one"].fingerprint()}
    with pytest.raises(ValueError, match="no such features: total"):
        review_run.run(rows, ReviewPlan(("total",), plan.forests))


def test_settings_of_the_families_are_checked():
    from tendersift.operators.assemble import Settings

    assert [x.time for x in Settings(period="month").levels("vendor_", False)] == ["month"] * 9 and len(Settings(short_naics=False).levels()) == 5
    for how in ({"amount_peers": 0}, {"amount_basis": "other"}, {"period": "week"}):
        with pytest.raises(ValueError):
            Settings(**how)


def test_documents_are_the_same_bytes_for_any_number_of_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 97:02}", f"w{i}", i, None if i % 5 else 'say "x", é') for i in range(500)], "transaction_id string, award_id string, n int, note string")

    def whole(path):
        return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))

    heads = [documents.write_json(rows.repartition(k), str(tmp_path / f"j{k}"), "some", parts=k) for k in (1, 64)]
    for k in (1, 64):
        documents.write_csv(rows.repartition(k), str(tmp_path / f"c{k}"), parts=k)
    one = whole(tmp_path / "j1")
    assert one == whole(tmp_path / "j64") and heads[0] == heads[1] and len(list((tmp_path / "j64").glob("part-*"))) > 1
    made = json.loads(one)
    assert made["rows"] == 500 and [(r["transaction_id"], r["award_id"]) for r in made["records"]] == sorted((r.transaction_id, r.award_id) for r in rows.collect())
    table = whole(tmp_path / "c1")
    assert table == whole(tmp_path / "c64") and len(list(csv.reader(io.StringIO(table.decode())))) == 501
    assert documents.read_json(spark, str(tmp_path / "j64"), rows.schema).count() == 500
    part = next(p for p in (tmp_path / "j64").glob("part-*") if b'"n":7,' in p.read_bytes())
    part.write_bytes(part.read_bytes().replace(b'"n":7,', b'"n":8,'))
    (tmp_path / "j64" / f".{part.name}.crc").unlink()
    with pytest.raises(documents.DocumentError):
        documents.read_json(spark, str(tmp_path / "j64"), rows.schema)
    documents.write_json(rows.limit(0), str(tmp_path / "none"), "some")
    assert json.loads(whole(tmp_path / "none"))["records"] == []
    with pytest.raises(documents.DocumentError, match="twice"):
        documents.write_json(rows.union(rows), str(tmp_path / "twice"), "some")
