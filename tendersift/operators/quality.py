"""Quality of a population: coverage, modes and ranges, and gates over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.functions.text import clean
from tendersift.operators.peers import fiscal_year


def _has(df: DataFrame, *names: str) -> Column:
    """Whether any of the columns there are holds a value."""
    out = F.lit(False)
    for n in names:
        if n in df.columns:
            out = out | (clean(F.col(n)).isNotNull() if dict(df.dtypes)[n] == "string" else F.col(n).isNotNull())
    return out


def _pair(a: Column, b: Column, both: str, first: str, second: str) -> Column:
    return F.when(a & b, both).when(a, first).when(b, second).otherwise("missing")


def contexts(df: DataFrame) -> dict[str, Column]:
    has = lambda *n: _has(df, *n)
    extent, offers = has("extent_competed_code", "extent_competed_description"), has("number_of_offers_received")
    other = has("other_than_full_and_open_code", "other_than_full_and_open_description")
    procedure = has("solicitation_procedure_code", "solicitation_procedure_description")
    return {
        "vendor_identity": has("recipient_uei", "recipient_legacy_id", "recipient_name"),
        "procurement_category": has("psc_code", "naics_code"),
        "awarding_agency": has("awarding_agency_code", "awarding_agency_name"),
        "competition_extent": extent,
        "competition_offers": offers,
        "competition_other_than_full_and_open": other,
        "competition_solicitation_procedure": procedure,
        "competition_any": extent | offers | other | procedure,
        "competition_core_pair": extent & offers,
    }


def modes(df: DataFrame) -> dict[str, Column]:
    has = lambda *n: _has(df, *n)
    sign = F.signum("action_obligation")
    needed = {"vendor_identity": contexts(df)["vendor_identity"], "category": has("psc_code", "naics_code"), "awarding_agency": has("awarding_agency_code", "awarding_agency_name"), "extent_competed_code": has("extent_competed_code"), "number_of_offers_received": has("number_of_offers_received")}
    return {
        "vendor": F.when(has("recipient_uei"), "uei").when(has("recipient_legacy_id"), "legacy_identifier").when(has("recipient_name"), "name_only").otherwise("missing"),
        "category": _pair(has("psc_code"), has("naics_code"), "psc_and_naics", "psc_only", "naics_only"),
        "agency": _pair(has("awarding_agency_code"), has("awarding_agency_name"), "code_and_name", "code_only", "name_only"),
        "competition_core": _pair(contexts(df)["competition_extent"], contexts(df)["competition_offers"], "extent_and_offers", "extent_only", "offers_only"),
        "obligation_sign": F.when(sign > 0, "positive").when(sign < 0, "negative").when(sign == 0, "zero").otherwise("missing"),
        "missing_pattern": F.concat_ws(",", *[F.when(~c, F.lit(n)) for n, c in needed.items()]),
        "source": F.coalesce(F.col("source_name"), F.lit("missing")),
        "source_schema": F.coalesce(F.col("source_schema"), F.lit("missing")),
        "action_fiscal_year": F.coalesce(fiscal_year(F.col("action_date")).cast("string"), F.lit("missing")),
    }


#: Columns whose variety a profile tells.
VARIED = ("award_id", "recipient_uei", "recipient_legacy_id", "awarding_agency_code", "awarding_subtier_agency_code", "psc_code", "naics_code", "source_name", "source_schema", "action_date")


def cardinalities(df: DataFrame, columns: Iterable[str] = VARIED) -> DataFrame:
    """name and n, the exact number of different values of each column; 0 where all are null.

    Each task keeps its different (column, value) pairs once, pairs are shuffled by their value,
    so a hot value is one row a task, and counts of pairs merge in any order.
    """
    names = list(columns)
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])
    pairs = df.select(F.inline(each)).distinct()  # a null value stands for the column
    return pairs.groupBy("name").agg(F.count("value").alias("n"))


def ranges(df: DataFrame) -> DataFrame:
    """name, present, least and most (as text, amounts with two places) of the action dates and obligations; one pass."""
    kinds = {"action_date": F.col("action_date"), "action_obligation": F.col("action_obligation").cast("decimal(18,2)"), "award_total_obligation": F.col("award_total_obligation").cast("decimal(18,2)")}
    one = df.agg(*[x.alias(f"{name}_{k}") for name, c in kinds.items() for k, x in (("n", F.count(c)), ("a", F.min(c)), ("z", F.max(c)))])
    rows = [F.struct(F.lit(name).alias("name"), F.col(f"{name}_n").alias("present"), F.col(f"{name}_a").cast("string").alias("least"), F.col(f"{name}_z").cast("string").alias("most")) for name in kinds]
    return one.select(F.inline(F.array(*rows)))


def profile(df: DataFrame) -> DataFrame:
    """section, name, n: the population, present values of each field, rows of each context, the histogram of each mode, and the cardinality of VARIED columns.

    Counts of one row for the first three; one grouped count for all histograms together, and one for all cardinalities.
    """
    fields = {c: _has(df, c) for c in df.columns if c not in ("source_name", "source_schema")}
    flat = [("population", "all", F.count("*"))] + [("field", n, F.count_if(c)) for n, c in fields.items()] + [("context", n, F.count_if(c)) for n, c in contexts(df).items()]
    one = df.agg(*[x.alias(f"v{i}") for i, (_, _, x) in enumerate(flat)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"v{i}").alias("n")) for i, (s, n, _) in enumerate(flat)])))
    each = F.array(*[F.struct(F.lit(s).alias("section"), c.alias("name")) for s, c in modes(df).items()])
    variety = cardinalities(df, [c for c in VARIED if c in df.columns]).select(F.lit("cardinality").alias("section"), "name", "n")
    return long.unionByName(df.select(F.inline(each)).groupBy("section", "name").agg(F.count("*").alias("n"))).unionByName(variety)


@dataclass(frozen=True)
class Rule:
    """section and name of a profile row; least and most bound its count, or its share of the population if share is set."""

    section: str
    name: str
    least: float | None = None
    most: float | None = None
    share: bool = True
    block: bool = True


RULES = (
    Rule("population", "all", least=20, share=False),
    Rule("context", "vendor_identity", least=0.5),
    Rule("context", "competition_core_pair", least=0.3),
    Rule("context", "procurement_category", least=0.9),
    Rule("vendor", "missing", most=0.05, block=False),
    Rule("obligation_sign", "zero", most=0.02, block=False),
    Rule("cardinality", "awarding_agency_code", least=2, share=False),
    Rule("cardinality", "source_schema", most=1, share=False, block=False),
)


def gate(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each rule: observed, passed, severity and the status of all: ready, degraded or blocked."""
    wanted = found.sparkSession.createDataFrame([(i, r.section, r.name, float("-inf") if r.least is None else float(r.least), float("inf") if r.most is None else float(r.most), r.share, r.block) for i, r in enumerate(rules)], "rule int, section string, name string, least double, most double, share boolean, block boolean")
    all_ = found.filter("section = 'population'").select(F.col("n").alias("population"))
    rows = F.broadcast(wanted).join(found, ["section", "name"], "left").join(F.broadcast(all_))
    observed = F.when(F.col("share"), F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("population"))).otherwise(F.coalesce("n", F.lit(0)).cast("double"))
    passed = F.coalesce((observed >= F.col("least")) & (observed <= F.col("most")), F.lit(False))
    rows = rows.select("rule", "section", "name", observed.alias("observed"), passed.alias("passed"), F.when(F.col("block"), "block").otherwise("warning").alias("severity"))
    failed = rows.agg(F.coalesce(F.max(F.when(F.col("passed"), 0).when(F.col("severity") == "block", 2).otherwise(1)), F.lit(0)).alias("worst"))
    status = F.element_at(F.array(F.lit("ready"), F.lit("degraded"), F.lit("blocked")), F.col("worst") + 1)
    return rows.join(F.broadcast(failed)).select("rule", "section", "name", "observed", "passed", "severity", status.alias("status"))


def in_order(found: DataFrame) -> DataFrame:
    """A profile by section and name; missing patterns by falling count."""
    return found.orderBy("section", F.when(F.col("section") == "missing_pattern", -F.col("n")), "name")


def gates(found: DataFrame, specs: dict[str, tuple[Rule, ...]], names: list[str] | None = None) -> DataFrame:
    """gate() of the named specs, or of all, with the spec's name as gate; ValueError for a name that isn't there."""
    wanted = sorted(specs) if names is None else names
    unknown = sorted(set(wanted) - set(specs))
    if unknown or not wanted:
        raise ValueError(f"no such gates: {', '.join(unknown)}")
    each = [gate(found, specs[n]).select(F.lit(n).alias("gate"), "*") for n in wanted]
    return reduce(lambda a, b: a.unionByName(b), each)
