import csv
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from tendersift.operators import assemble, award_change, competition_evidence, identity, lifecycle, review
from tendersift.sources import archive, export, profiles

HEAD = "contract_award_unique_key,contract_transaction_unique_key,modification_number,recipient_name,recipient_uei,action_date,federal_action_obligation,total_dollars_obligated,number_of_offers_received,Extra Column"


def test_archive_rows_and_duplicates(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one.csv", "﻿" + HEAD + '\nW1,T1,P00001,"Acme, Inc.",u1,2026-01-04,-25.50,74.50,1,x\nW1,T1,P00001,"Acme, Inc.",u1,2026-01-04,-25.50,74.50,1,x\nW1,T1,P00001,"Acme, Inc.",u1,2026-01-04,125,74.50,1,x\n')
        z.writestr("two.tsv", HEAD.replace(",", "\t") + "\nW2\tT2\t0\t\t\t2026-02-01T00:00:00Z\tten\t\t3.5\t\n")
        z.writestr("readme.md", "no table")
    rows = archive.outcomes(archive.adapted(archive.read_archive(spark, str(path)))).collect()
    one = sorted((r for r in rows if r.transaction_id == "T1"), key=lambda r: r.row_seq)
    assert [r.outcome for r in one] == ["loaded", "dropped_exact_duplicate", "quarantined"]
    assert str(one[0].action_obligation) == "-25.50" and one[0].number_of_offers_received == 1 and one[0].recipient_name == "Acme, Inc."
    two = next(r for r in rows if r.transaction_id == "T2")
    assert two.outcome == "quarantined" and set(two.problems) == {"action_obligation", "number_of_offers_received"} and str(two.action_date) == "2026-02-01"


def test_archives_of_one_name_and_many_pieces(spark, tmp_path):
    made = []
    for year in ("2023", "2024"):
        (tmp_path / year).mkdir()
        with zipfile.ZipFile(tmp_path / year / "data.zip", "w") as z:
            z.writestr("a.csv", "id,note\r\n" + "".join(f'{year}-{i},"é ""x""\n{i}, y"\r\n{year}-{i}b,5" pipe\r\n' for i in range(200)))
            z.writestr("empty.csv", "id,note\n")
        made.append(archive.read_archive(spark, str(tmp_path / year / "data.zip"), piece=300))
    got = made[0].union(made[1]).collect()
    assert len({r.id for r in got}) == len(got) == 800 and made[0].rdd.getNumPartitions() > 1
    for year, df in zip(("2023", "2024"), made, strict=True):
        rows = sorted(df.collect(), key=lambda r: r.row_seq)
        assert [(r.id, r.note) for r in rows] == [x for i in range(200) for x in ((f"{year}-{i}", f'é "x"\n{i}, y'), (f"{year}-{i}b", '5" pipe'))]
        assert len({r.row_seq for r in rows}) == 400


def test_bad_first_row_leaves_the_next_good_one(spark):
    data = [("t", "x", 1, ["action_date"]), ("t", "y", 2, []), ("t", "y", 3, []), ("t", "z", 4, []), (None, "x", 5, []), (None, "x", 6, ["transaction_id"])]
    df = spark.createDataFrame(data, "transaction_id string, row_sha256 string, row_seq int, problems array<string>")
    got = [r.outcome for r in archive.outcomes(df, order=("row_seq",)).orderBy("row_seq").collect()]
    assert got == ["quarantined", "loaded", "dropped_exact_duplicate", "quarantined", "quarantined", "quarantined"]


def test_flawed_rows_are_quarantined_alone(spark, tmp_path):
    path = str(tmp_path / "c.zip")
    head = "contract_award_unique_key,contract_transaction_unique_key,action_date,federal_action_obligation,transaction_description"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("c.csv", head + f"\nW,T1,2026-01-04,1,good\nW,T2,2026-01-04,1\nW,T3,2026-01-04,1,x,more\n\n,,,,\nW,T4,2026-01-04,1,{'y' * 50}\nW,T2,2026-01-04,1,good\n")
    read = archive.read_archive(spark, path, archive.Budget(cell=40))
    assert read.filter("size(flaws) > 0").count() == 3 and read.count() == 5
    rows = archive.outcomes(archive.adapted(read)).orderBy("row_seq").collect()
    assert [(r.transaction_id, r.outcome, list(r.problems)) for r in rows] == [
        ("T1", "loaded", []),
        ("T2", "quarantined", ["record_shape"]),
        ("T3", "quarantined", ["record_shape"]),
        ("T4", "quarantined", ["long_cell"]),
        ("T2", "loaded", []),
    ]
    assert {(r.source_member, r.member_index, r.artifact_sha256) for r in rows} == {("c.csv", 0, archive.sha256_of(path))} and len({r.row_seq for r in rows}) == 5
    with pytest.raises(archive.ArchiveError, match="planned"):
        archive.read_archive(spark, path, sha256="0" * 64)
    with pytest.raises(archive.ArchiveError):
        archive.header("a,row_seq", ",")
    with pytest.raises(archive.ArchiveError):
        archive.header("", ",")


def test_load_plans(spark, tmp_path):
    path = str(tmp_path / "d.zip")
    first, second = "Award,Id,Day,Money", "award key|id|day|money|note"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one.csv", first + "\nW,T1,2026-01-04,1\n")
        z.writestr("two.txt", second + "\nW|T2|2026-01-05|2|n\nW|T1|2026-01-05|2|n\n")
    fields = {"transaction_id": ("id",), "action_date": ("day",), "action_obligation": ("money",)}
    a = profiles.Profile("a", fields | {"award_id": ("Award",)})
    b = profiles.Profile("b", fields | {"award_id": ("award_key",), "description": ("note",)})
    with pytest.raises(archive.ArchiveError, match="several profiles"):
        profiles.planned(path, [a, b])
    plan = profiles.planned(path, [a, b], allow_mixed=True)
    assert [(m, r.profile) for m, r in plan.members] == [("one.csv", "a"), ("two.txt", "b")] and plan.ignored == ()
    got = {(r.transaction_id, r.source_name): (r.outcome, str(r.action_obligation), r.description) for r in profiles.loaded(spark, path, plan, [a, b]).collect()}
    assert got == {("T1", "a"): ("loaded", "1.00", None), ("T2", "b"): ("loaded", "2.00", "n"), ("T1", "b"): ("quarantined", "2.00", "n")}
    one = profiles.planned(path, [a, b], members=("one.csv",))
    assert one.ignored == ("two.txt",) and one.digest() != plan.digest() == profiles.planned(path, [a, b], allow_mixed=True).digest()
    assert profiles.loaded(spark, path, one, [a, b]).count() == 1
    with pytest.raises(archive.ArchiveError, match="no such members"):
        profiles.planned(path, [a, b], members=("x.csv",))
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("three.csv", first + "\n")
    with pytest.raises(archive.ArchiveError, match="planned"):
        profiles.loaded(spark, path, plan, [a, b])


def test_unsafe_archives_are_refused(tmp_path):
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("../x.csv", "a\n1\n")
    with pytest.raises(archive.ArchiveError):
        archive.inspected(str(path))
    with pytest.raises(archive.ArchiveError):
        archive.header("a,A,b", ",")
    assert archive.header("Award ID!,b", ",") == ["award_id", "b"]


def rows(spark, data, extra=""):
    return spark.createDataFrame(data, "transaction_id string, award_id string, modification_number string, action_obligation decimal(18,2), award_total_obligation decimal(18,2), action_date string").withColumn("action_date", F.to_date("action_date"))


def test_lifecycle_identity_and_change_sums(spark):
    from decimal import Decimal as D

    data = [("a", "W", "0", D(100), D(100), "2026-01-01")] + [(x, "W", f"P{i}", D(v), D(t), "2026-02-01") for i, (x, v, t) in enumerate([("b", 25, 125), ("c", -10, 115), ("d", 0, 115), ("e", 5, 120)])]
    r = award_change.activity(rows(spark, data)).first()
    assert (r.positive, r.deobligation, r.net, r.gross, r.zeros, r.largest, r.modification_numbers) == (30, 10, 20, 40, 1, 25, 4)
    kinds = spark.createDataFrame([("000",), ("p00001",), (None,)], "modification_number string")
    assert [tuple(x)[1:] for x in lifecycle.with_lifecycle(kinds).collect()] == [("base_award", "0"), ("modification", "P00001"), ("unknown", None)]
    ids = spark.createDataFrame([("uei-child-1", "x"), (None, "  Acme   Widgets, Inc.  ")], "recipient_uei string, recipient_name string")
    got = identity.with_vendor(ids).collect()
    assert [x.vendor_key for x in got] == ["entity:uei:UEI-CHILD-1", "entity:normalized_name:acme widgets, inc."] and got[0].parent_key is None


def test_single_offer_is_no_process_classification(spark):
    names = "transaction_id award_id extent_competed_code extent_competed_description number_of_offers_received solicitation_procedure_code solicitation_procedure_description other_than_full_and_open_code other_than_full_and_open_description"
    df = spark.createDataFrame([("t", "w", None, "Full and Open Competition", 1, None, "Only One Source", None, None)], ", ".join(f"{n} {'int' if n.startswith('number') else 'string'}" for n in names.split()))
    r = competition_evidence.with_evidence(df).first()
    assert r.process_competitive is True and r.conflicts == ["competitive_extent_with_only_one_source_procedure"] and r.notes == ["single_offer_is_outcome_not_process_classification"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("t2", "w", "=HYPERLINK(1)", -1000.0), ("t1", "w", "plain", 5.0)], "transaction_id string, award_id string, name string, amount double")
    export.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, ignoreLeadingWhiteSpace=False).filter("transaction_id = 't2'").first().name == "\t=HYPERLINK(1)"
    export.write_json(df, str(tmp_path / "json"))
    assert [x.transaction_id for x in spark.read.json(str(tmp_path / "json")).orderBy("transaction_id").collect()] == ["t1", "t2"]
    with pytest.raises(Exception, match="exist"):
        export.write_json(df, str(tmp_path / "json"))
    with pytest.raises(ValueError, match="different rows"):
        export.records(df, df.limit(1))


def test_csv_contract(spark, tmp_path):
    have = spark.createDataFrame([("t1", "w", "-Acme", -5.0), ("t2", "w", None, 2.5)], "transaction_id string, award_id string, recipient_name string, action_obligation double")
    facts = "array<struct<family:string,feature:string,value:double,reason:string,narrative:string>>"
    told = spark.createDataFrame(
        [("t1", "w", 80.0, 85.0, 90.0, 1, 2, True, "r", 2.5, 0.5, [("f", "x", None, "unknown", "=n")], "s1"), ("t2", "w", 1.0, 1.0, 1.0, 3, 3, False, "r", 0.0, 1.0, None, "s2")],
        f"transaction_id string, award_id string, lower double, score double, upper double, best_rank int, worst_rank int, flagged boolean, reason string, disagreement double, completeness double, facts {facts}, summary string",
    )
    out = export.csv_rows(have, told)
    assert out.columns == export.CSV_COLUMNS and len(set(out.columns)) == 46
    export.write_csv(out, str(tmp_path / "csv"))
    lines = [r for p in sorted((tmp_path / "csv").glob("part-*")) for r in csv.DictReader(p.open(newline=""))]
    a, b = sorted(lines, key=lambda r: r["transaction_id"])
    assert (a["vendor_name"], a["action_obligation"], a["review_rank"], a["flagged_for_review"], a["anomaly_position"]) == ("\t-Acme", "-5.0", "1-2", "Y", "0.85")
    assert (b["vendor_name"], b["piid"], b["review_rank"], b["evidence_facts_json"], b["stability_available"]) == ("", "", "3", "[]", "N")
    assert json.loads(a["evidence_facts_json"]) == [{"family": "f", "feature": "x", "narrative": "=n", "reason": "unknown", "value": None}]
    assert len({x["record_evidence_sha256"] for x in lines}) == 2
    with pytest.raises(ValueError, match="different rows"):
        export.csv_rows(have.limit(1), told)


def test_tie_policies(spark):
    df = spark.createDataFrame([(f"t{i}", "w", s) for i, s in enumerate([9.0, 5.0, 5.0, 5.0, 1.0])], "transaction_id string, award_id string, score double")
    flagged = lambda ties: sorted(r.transaction_id for r in review.top_n(df, 2, ties).filter("flagged").collect())
    assert flagged("include_boundary_ties") == ["t0", "t1", "t2", "t3"]
    assert flagged("exclude_boundary_ties") == ["t0"]
    assert flagged("deterministic_identity") == ["t0", "t1"]
    with pytest.raises(ValueError):
        review.top_n(df, 6)


def test_88_features(spark):
    from tendersift.sources.canonical import canonical
    from tendersift.storage import stored

    cells = stored(assemble.cells(stored(canonical(spark, "/root/testdata/sf0.001"), "canonical")), "cells")
    assert cells.select("feature").distinct().count() == 88
    assert cells.filter("(value IS NULL) = (reason IS NULL)").count() == 0
    assert cells.count() == 88 * 6000
