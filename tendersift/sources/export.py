"""Deterministic exports of a review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.operators.explanation import SEMANTICS as EXPLANATION
from tendersift.operators.review import SEMANTICS as SCORE

#: First characters that a spreadsheet may take for a formula.
# The characters that a spreadsheet may take for a formula.
UNSAFE = ("=", "+", "-", "@", "\t", "\r", "\n", "＝", "＋", "－", "＠")


def spreadsheet_safe(c: Column) -> Column:
    """Text with a tab before it if it starts like a formula; null stays null."""
    return F.when(F.substring(c, 1, 1).isin(*UNSAFE), F.concat(F.lit("\t"), c)).otherwise(c)


def records(transactions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Transactions with their decisions; an error if the two don't hold the same rows."""
    ident = ["transaction_id", "award_id"]
    both = transactions.select(*ident).exceptAll(decisions.select(*ident)).union(decisions.select(*ident).exceptAll(transactions.select(*ident)))
    if both.head(1):
        raise ValueError("transactions and decisions hold different rows")
    return transactions.join(decisions, ident)


# The columns of the CSV export, in order.
CSV_COLUMNS = """
transaction_id award_id piid modification_number action_date vendor_name vendor_uei vendor_legacy_id
awarding_agency_name awarding_subtier_agency_name psc_code naics_code award_type_code
action_obligation award_total_obligation extent_competed_description number_of_offers_received
solicitation_procedure_description other_than_full_and_open_description
review_priority_score_lower review_priority_score review_priority_score_upper risk_score_0_100
anomaly_position score_semantics flagged_for_review review_rank_lower review_rank_upper review_rank
selection_reason detector_disagreement_points feature_completeness_fraction stability_available
stability_position_span_points stability_median_absolute_deviation_points explanation_summary
explanation_semantics evidence_facts_json source_name source_transaction_id source_schema
source_retrieved_at raw_record_sha256 transaction_evidence_sha256 explanation_evidence_sha256
record_evidence_sha256
""".split()


def csv_rows(transactions: DataFrame, explained: DataFrame, retrieved_at: str | None = None) -> DataFrame:
    """CSV_COLUMNS of canonical transactions and explanation.explained(), which hold the same rows.

    Fields that the transactions don't have are null.  The evidence digests are sha256 of
    the JSON of the transaction, of its decision with its explanation, and of both digests.
    """
    c, have = F.col, set(transactions.columns) | set(explained.columns)
    maybe = lambda name: c(name) if name in have else F.lit(None).cast("string")
    yes = lambda x: F.when(x, "Y").otherwise("N")
    hashed = lambda names: F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)
    same, low, high = c("best_rank") == c("worst_rank"), c("best_rank").cast("string"), c("worst_rank").cast("string")
    facts = F.transform("facts", lambda f: F.struct(*[f[x].alias(x) for x in ("family", "feature", "narrative", "reason", "value")]))
    made = {
        "vendor_name": maybe("recipient_name"),
        "vendor_uei": maybe("recipient_uei"),
        "vendor_legacy_id": maybe("recipient_legacy_id"),
        "review_priority_score_lower": c("lower"),
        "review_priority_score": c("score"),
        "review_priority_score_upper": c("upper"),
        "risk_score_0_100": c("score"),
        "anomaly_position": c("score") / 100,
        "score_semantics": F.lit(SCORE),
        "flagged_for_review": yes(c("flagged")),
        "review_rank_lower": c("best_rank"),
        "review_rank_upper": c("worst_rank"),
        "review_rank": F.when(same, low).otherwise(F.concat_ws("-", low, high)),
        "selection_reason": c("reason"),
        "detector_disagreement_points": c("disagreement"),
        "feature_completeness_fraction": c("completeness"),
        "stability_available": yes(maybe("span").isNotNull()),
        "stability_position_span_points": maybe("span"),
        "stability_median_absolute_deviation_points": maybe("mad"),
        "explanation_summary": c("summary"),
        "explanation_semantics": F.lit(EXPLANATION),
        "evidence_facts_json": F.coalesce(F.to_json(facts, {"ignoreNullFields": "false"}), F.lit("[]")),
        "source_transaction_id": c("transaction_id"),
        "source_retrieved_at": F.lit(retrieved_at).cast("string"),
        "raw_record_sha256": maybe("row_sha256"),
        "transaction_evidence_sha256": hashed(transactions.columns),
        "explanation_evidence_sha256": hashed(explained.columns),
    }
    made["record_evidence_sha256"] = F.sha2(F.concat(made["transaction_evidence_sha256"], made["explanation_evidence_sha256"]), 256)
    return records(transactions, explained).select(*[made.get(n, maybe(n)).alias(n) for n in CSV_COLUMNS])


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, keys sorted, rows by transaction_id and award_id; fails if the folder is there."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    rows.orderBy("transaction_id", "award_id").select(line.alias("value")).write.mode("errorifexists").text(path)


def write_csv(rows: DataFrame, path: str, spreadsheet: bool = True) -> None:
    """Quoted columns with quotes in them doubled, rows by transaction_id and award_id; spreadsheet: text columns are made safe, numbers stay."""
    put = [spreadsheet_safe(F.col(c)).alias(c) if spreadsheet and k == "string" else F.col(c) for c, k in rows.dtypes]
    rows.orderBy("transaction_id", "award_id").select(*put).write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
