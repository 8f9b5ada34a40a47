"""The queries' results as SQL over the order tables.

Written apart from the operators: groups are compared by self-joins, and levels are
found by trying them one after the other.
"""

from __future__ import annotations

import re

from tendersift.operators import competition_evidence as evidence
from tendersift.operators.feature_catalog import CATALOG
from tendersift.sources.canonical import canonical_sql

R = 6  # decimals of doubles


#: What a reference held that was frozen before the last month of each fiscal year.
FROZEN = "month(action_date) <> 9"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def canon(raw: bool = False) -> str:
    return f"canon AS ({canonical_sql(raw)})"


LIFE = """life AS (SELECT *, CASE WHEN modification_number IS NULL OR trim(modification_number) = '' THEN 'unknown'
  WHEN regexp_matches(trim(modification_number), '^0+$') THEN 'base_award' ELSE 'modification' END AS lifecycle,
  CASE WHEN regexp_matches(trim(modification_number), '^0+$') THEN '0' ELSE upper(trim(modification_number)) END AS modification FROM canon)"""

VENDOR = """vend AS (SELECT *, coalesce('entity:uei:' || upper(recipient_uei), 'entity:legacy_id:' || upper(recipient_legacy_id), 'entity:normalized_name:' || lower(recipient_name)) AS vendor_key,
  'ultimate_parent:uei:' || upper(parent_recipient_uei) AS parent_key FROM life)"""


def keyed(source: str, columns: str, prefix: str, award_type: bool) -> str:
    """keyed: columns, ordinal, level, peer_key for each row and level."""
    top, sub = "'agency-code:' || upper(awarding_agency_code) || '|'", "'agency-code:' || upper(awarding_subtier_agency_code) || '|'"
    psc = "'psc:' || upper(psc_code) || '|'"
    naics = {n: f"CASE WHEN regexp_matches(naics_code, '^[0-9]{{2,6}}$') AND length(naics_code) >= {n} THEN 'naics{n}:' || substr(naics_code, 1, {n}) || '|' END" for n in (6, 4, 2)}
    year = "'fiscal_year:' || CAST(year(action_date) + CASE WHEN month(action_date) >= 10 THEN 1 ELSE 0 END AS VARCHAR)"
    steps = [("subtier_psc_exact", f"{sub} || {psc}", "|| '|type:' || upper(award_type_code)" if award_type else ""), ("agency_psc_exact", f"{top} || {psc}", "")]
    steps += [(f"agency_naics_{n}", f"{top} || {naics[n]}", "") for n in (6, 4, 2)] + [("psc_exact", psc, "")] + [(f"naics_{n}", naics[n], "") for n in (6, 4, 2)]
    each = [f"SELECT {columns}, {i} AS ordinal, '{prefix}{n}' AS level, '{prefix}{n}|' || {x} || {year} {kind} AS peer_key FROM {source}" for i, (n, x, kind) in enumerate(steps)]
    return f"keyed AS ({' UNION ALL '.join(each)})"


def distribution(name: str, targets: str, members: str) -> str:
    """name: id, m, less, eq, q1, med, q3, mad from targets(id, g, v, n) and members(id, g, v), each target without the member of its id."""
    return f"""{name}_p AS (SELECT t.id, t.g, t.v AS tv, p.v FROM {targets} t JOIN {members} p ON t.g = p.g AND t.id <> p.id),
{name}_s AS (SELECT id, g, tv, count(*) AS m, count(*) FILTER (v < tv) AS less, count(*) FILTER (v = tv) AS eq,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM {name}_p GROUP BY id, g, tv),
{name}_d AS (SELECT p.id, p.g, quantile_cont(abs(p.v - s.med), 0.5) AS mad FROM {name}_p p JOIN {name}_s s ON p.id = s.id AND p.g = s.g GROUP BY p.id, p.g),
{name} AS (SELECT s.*, d.mad, (s.less + s.eq / 2.0) / s.m AS pos, 0.6744897501960817 * (s.tv - s.med) / nullif(d.mad, 0) AS z, (s.tv - s.med) / nullif(s.q3 - s.q1, 0) AS dist
  FROM {name}_s s JOIN {name}_d d ON s.id = d.id AND s.g = d.g)"""


CANONICAL = with_(canon()) + "SELECT transaction_id, award_id, modification_number, award_type_code, recipient_name, recipient_uei, recipient_legacy_id, parent_recipient_uei, CAST(action_date AS VARCHAR) AS action_date, CAST(action_obligation AS DOUBLE) AS action_obligation, CAST(award_total_obligation AS DOUBLE) AS award_total_obligation, awarding_agency_code, awarding_subtier_agency_code, psc_code, naics_code, extent_competed_description, number_of_offers_received, solicitation_procedure_description, other_than_full_and_open_description FROM canon"

LIFECYCLE = with_(canon(True), LIFE) + "SELECT lifecycle, modification, count(*) AS n FROM life GROUP BY lifecycle, modification"

IDENTITY = with_(canon(), LIFE, VENDOR) + "SELECT transaction_id, vendor_key, parent_key, CASE WHEN vendor_key IS NULL THEN 'recipient_identity_missing' END AS vendor_reason, CASE WHEN parent_key IS NULL THEN 'ultimate_parent_identity_missing' END AS parent_reason, substr(vendor_key, 8) = substr(parent_key, 17) AS parent_matches_entity FROM vend"

PEER_KEYS = with_(canon(), keyed("canon", "transaction_id", "", True)) + "SELECT transaction_id, ordinal, level, peer_key FROM keyed"

GROUP_COUNTS = with_(canon(), keyed("canon", "transaction_id", "", True)) + "SELECT level, peer_key, count(*) AS members FROM keyed WHERE peer_key IS NOT NULL GROUP BY level, peer_key"


def chosen(minimum: int, held: str = "true") -> str:
    """chosen: each row's first level with at least minimum other rows that the reference holds."""
    return f"""sizes AS (SELECT peer_key, count(*) AS members FROM keyed WHERE peer_key IS NOT NULL AND {held} GROUP BY peer_key),
chosen AS (SELECT transaction_id, level, peer_key, members FROM (SELECT k.transaction_id, k.level, k.peer_key, s.members, row_number() OVER (PARTITION BY k.transaction_id ORDER BY k.ordinal) AS rn
  FROM keyed k JOIN sizes s ON k.peer_key = s.peer_key AND s.members - CASE WHEN {held} THEN 1 ELSE 0 END >= {minimum}) WHERE rn = 1)"""


FIRST_LEVEL = with_(canon(), keyed("canon", "transaction_id", "", True), chosen(10)) + "SELECT transaction_id, level, peer_key, members FROM chosen"

SIGNS = with_(canon(), keyed("canon", "transaction_id, action_obligation", "", True), chosen(10)) + f"""SELECT c.transaction_id, c.level, count(*) AS peers, round(count(*) FILTER (k.action_obligation > 0) / CAST(count(*) AS DOUBLE), {R}) AS positive_share,
  round(count(*) FILTER (k.action_obligation < 0) / CAST(count(*) AS DOUBLE), {R}) AS negative_share, round(count(*) FILTER (k.action_obligation = 0) / CAST(count(*) AS DOUBLE), {R}) AS zero_share
FROM chosen c JOIN keyed k ON c.peer_key = k.peer_key AND c.transaction_id <> k.transaction_id GROUP BY c.transaction_id, c.level"""

_FORMS = """forms AS (SELECT transaction_id AS id, peer_key, held, 's|' || peer_key AS g, CAST(action_obligation AS DOUBLE) AS v FROM keyed WHERE peer_key IN (SELECT peer_key FROM chosen)
  UNION ALL SELECT transaction_id, peer_key, held, 'm|' || peer_key, abs(CAST(action_obligation AS DOUBLE)) FROM keyed WHERE peer_key IN (SELECT peer_key FROM chosen)
  UNION ALL SELECT transaction_id, peer_key, held, 'd' || CAST(sign(action_obligation) AS INT) || '|' || peer_key, abs(CAST(action_obligation AS DOUBLE)) FROM keyed WHERE peer_key IN (SELECT peer_key FROM chosen)),
mem AS (SELECT id, g, v FROM forms WHERE held),
tgt AS (SELECT id, g, v FROM forms f JOIN chosen c ON f.id = c.transaction_id AND f.peer_key = c.peer_key)"""

_AMOUNT_COLUMNS = ", ".join(f"round(max(CASE WHEN left(g, 1) = '{f}' THEN {e} END), {R}) AS amount_{n}_{k}" for k, e in (("position", "pos"), ("modified_z", "z"), ("iqr_distance", "dist")) for f, n in (("s", "signed"), ("m", "magnitude"), ("d", "same_direction_magnitude")))


#: The period of a peer key as SQL, and others that a plan may ask for.
_YEAR = "'fiscal_year:' || CAST(year(action_date) + CASE WHEN month(action_date) >= 10 THEN 1 ELSE 0 END AS VARCHAR)"
PERIODS = {"fiscal_year": _YEAR, "year": "'year:' || CAST(year(action_date) AS VARCHAR)", "quarter": "'quarter:' || CAST(year(action_date) AS VARCHAR) || '-Q' || CAST(quarter(action_date) AS VARCHAR)", "month": "'month:' || strftime(action_date, '%Y-%m')"}


def amount(held: str = "true", basis: str = "action_obligation", period: str = "fiscal_year", minimum: int = 10) -> str:
    of = lambda text: text.replace("action_obligation", basis)
    keys = keyed("val", f"transaction_id, {basis}, {held} AS held", "", True)
    assert _YEAR in keys
    return with_(canon(), f"val AS (SELECT * FROM canon WHERE {basis} IS NOT NULL)", keys.replace(_YEAR, PERIODS[period]), chosen(minimum, "held"), of(_FORMS), distribution("dd", "tgt", "mem")) + f""", wide AS (SELECT id, max(CASE WHEN left(g, 1) = 's' THEN m END) AS peers, max(CASE WHEN left(g, 1) = 'd' THEN m END) AS same, {_AMOUNT_COLUMNS} FROM dd GROUP BY id)
SELECT c.transaction_id, level, peers, {", ".join(f"amount_{n}_{k}" for k in ("position", "modified_z", "iqr_distance") for n in ("signed", "magnitude", "same_direction_magnitude"))},
  CASE WHEN level IS NOT NULL THEN CAST(sign(c.{basis}) AS DOUBLE) END AS amount_direction_code,
  CASE WHEN level IS NOT NULL THEN round(coalesce(same, 0) / CAST(peers AS DOUBLE), {R}) END AS amount_same_direction_peer_fraction,
  CASE WHEN c.{basis} IS NULL THEN 'target_amount_missing' WHEN level IS NULL THEN 'no_peer_group_with_required_support' END AS reason
FROM canon c LEFT JOIN chosen USING (transaction_id) LEFT JOIN wide w ON c.transaction_id = w.id"""


AMOUNT = amount()
AMOUNT_FROZEN = amount(FROZEN)
#: Amounts of awards among those of a month, quarter and calendar year, with another number of peers.
AMOUNT_PERIODS = " UNION ALL ".join(f"SELECT '{p}' AS period, * FROM ({amount(basis='award_total_obligation', period=p, minimum=6)})" for p in ("month", "quarter", "year"))

_BASE_VENDOR = f"b AS (SELECT * FROM vend WHERE lifecycle = 'base_award'),\n{keyed('b', 'transaction_id, award_id, vendor_key', 'vendor_', False)}"
_WON = """won AS (SELECT peer_key, vendor_key, count(*) AS c FROM keyed WHERE peer_key IS NOT NULL AND vendor_key IS NOT NULL GROUP BY peer_key, vendor_key),
mk AS (SELECT peer_key, count(*) AS awards, count(vendor_key) AS identified, count(DISTINCT vendor_key) AS winners FROM keyed WHERE peer_key IS NOT NULL GROUP BY peer_key),
sq AS (SELECT peer_key, sum(c * c) AS squares, max(c) AS top FROM won GROUP BY peer_key)"""

VENDOR_MARKETS = (
    with_(canon(), LIFE, VENDOR, _BASE_VENDOR, _WON)
    + f"""SELECT peer_key, awards, identified, awards - identified AS unidentified, winners, round(identified / CAST(awards AS DOUBLE), {R}) AS coverage,
  round(squares / (CAST(identified AS DOUBLE) * identified), {R}) AS hhi, round(top / CAST(identified AS DOUBLE), {R}) AS largest_share
FROM mk LEFT JOIN sq USING (peer_key)"""
)

_V = ("new_award_count", "share_identified_new_awards", "share_all_observed_new_awards", "equal_observed_winner_share_lift", "win_count_position", "win_count_modified_z", "win_count_iqr_distance", "share_of_largest_observed_winner", "award_count_hhi_contribution", "fraction_of_award_count_hhi")


def vendor_features(held: str = "true") -> str:
    own = f"transaction_id, vendor_key, CASE WHEN lifecycle = 'base_award' AND {held} THEN 1 ELSE 0 END AS o"
    return with_(canon(), LIFE, VENDOR, f"b AS (SELECT * FROM vend WHERE lifecycle = 'base_award' AND {held})", keyed("b", "vendor_key", "vendor_", False).replace("keyed AS", "market AS"), keyed("vend", own, "vendor_", False)) + f""", won AS (SELECT peer_key, vendor_key, count(*) AS c FROM market WHERE peer_key IS NOT NULL GROUP BY peer_key, vendor_key),
ask AS (SELECT DISTINCT peer_key, vendor_key, o FROM keyed WHERE peer_key IS NOT NULL AND vendor_key IS NOT NULL),
aft AS (SELECT a.peer_key, a.vendor_key AS v, a.o, w.vendor_key, w.c - CASE WHEN w.vendor_key = a.vendor_key THEN a.o ELSE 0 END AS c FROM ask a JOIN won w USING (peer_key)),
m AS (SELECT peer_key, v, o, sum(c) AS t, sum(c) FILTER (vendor_key IS NOT NULL) AS i, count(*) FILTER (vendor_key IS NOT NULL AND c > 0) AS w,
  coalesce(max(c) FILTER (vendor_key = v), 0) AS n, max(c) FILTER (vendor_key IS NOT NULL) AS top, sum(c * c) FILTER (vendor_key IS NOT NULL) AS sq FROM aft GROUP BY peer_key, v, o),
ok AS (SELECT * FROM m WHERE t >= 10 AND i >= 10 AND w >= 3 AND i >= 0.5 * t),
pick AS (SELECT * FROM (SELECT k.transaction_id, k.level, ok.*, row_number() OVER (PARTITION BY k.transaction_id ORDER BY k.ordinal) AS rn
  FROM keyed k JOIN ok ON k.peer_key = ok.peer_key AND k.vendor_key = ok.v AND ok.o = k.o) WHERE rn = 1),
u AS (SELECT DISTINCT peer_key, v, o, n FROM pick),
x AS (SELECT u.*, CAST(a.c AS DOUBLE) AS c FROM u JOIN aft a ON u.peer_key = a.peer_key AND u.v = a.v AND u.o = a.o AND a.vendor_key <> a.v),
s AS (SELECT peer_key, v, o, n, count(*) AS k, count(*) FILTER (c < n) AS less, count(*) FILTER (c = n) AS eq, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.5) AS med, quantile_cont(c, 0.75) AS q3 FROM x GROUP BY peer_key, v, o, n),
d AS (SELECT x.peer_key, x.v, x.o, quantile_cont(abs(x.c - s.med), 0.5) AS mad FROM x JOIN s ON x.peer_key = s.peer_key AND x.v = s.v AND x.o = s.o GROUP BY x.peer_key, x.v, x.o),
f AS (SELECT transaction_id, level, CAST(p.n AS DOUBLE) AS vendor_{_V[0]}, p.n / CAST(i AS DOUBLE) AS vendor_{_V[1]}, p.n / CAST(t AS DOUBLE) AS vendor_{_V[2]}, p.n / CAST(i AS DOUBLE) * w AS vendor_{_V[3]},
  (less + eq / 2.0) / k AS vendor_{_V[4]}, 0.6744897501960817 * (p.n - med) / nullif(mad, 0) AS vendor_{_V[5]}, (p.n - med) / nullif(q3 - q1, 0) AS vendor_{_V[6]},
  p.n / CAST(top AS DOUBLE) AS vendor_{_V[7]}, (p.n / CAST(i AS DOUBLE)) * (p.n / CAST(i AS DOUBLE)) AS vendor_{_V[8]}, p.n * p.n / CAST(sq AS DOUBLE) AS vendor_{_V[9]}
  FROM pick p LEFT JOIN s ON p.peer_key = s.peer_key AND p.v = s.v AND p.o = s.o LEFT JOIN d ON p.peer_key = d.peer_key AND p.v = d.v AND p.o = d.o)
SELECT v.transaction_id, level, {", ".join(f"round(vendor_{x}, {R}) AS vendor_{x}" for x in _V)},
  CASE WHEN vendor_key IS NULL THEN 'target_vendor_identity_missing' WHEN level IS NULL THEN 'no_market_satisfies_support_requirements' END AS reason
FROM vend v LEFT JOIN f USING (transaction_id)"""


VENDOR_FEATURES = vendor_features()
VENDOR_FROZEN = vendor_features(FROZEN)

VENDOR_ACTIVITY = (
    with_(canon(), LIFE, VENDOR)
    + f""", a AS (SELECT vendor_key, award_id, count(*) AS n FROM vend GROUP BY vendor_key, award_id),
g AS (SELECT vendor_key, count(*) AS awards, count(*) FILTER (n = 1) AS single_transaction_awards, count(*) FILTER (n > 1) AS multi_transaction_awards, max(n) AS max_transactions_per_award FROM a GROUP BY vendor_key)
SELECT vendor_key, count(*) AS transactions, max(awards) AS awards, max(single_transaction_awards) AS single_transaction_awards, max(multi_transaction_awards) AS multi_transaction_awards,
  max(max_transactions_per_award) AS max_transactions_per_award, round(CAST(sum(action_obligation) AS DOUBLE), 2) AS net, round(CAST(sum(abs(action_obligation)) AS DOUBLE), 2) AS gross,
  round(CAST(sum(greatest(action_obligation, 0)) AS DOUBLE), 2) AS positive, round(CAST(sum(greatest(-action_obligation, 0)) AS DOUBLE), 2) AS deobligation,
  count(*) FILTER (action_obligation = 0) AS zero_transactions, CAST(min(action_date) AS VARCHAR) AS first_date, CAST(max(action_date) AS VARCHAR) AS last_date,
  count(DISTINCT awarding_agency_code) AS agencies, count(DISTINCT awarding_subtier_agency_code) AS subtier_agencies, count(DISTINCT psc_code) AS psc_codes, count(DISTINCT naics_code) AS naics_codes,
  round(count(*) / CAST(max(awards) AS DOUBLE), {R}) AS transactions_per_award
FROM vend JOIN g USING (vendor_key) GROUP BY vendor_key"""
)


def _case(column: str, table: dict[str, str], otherwise: str) -> str:
    form = f"trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE {form} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{otherwise}' END"


_OPEN = ", ".join(repr(x) for x in sorted(set(evidence.PROCEDURE.values()) - {"only_one_source_solicited", "simplified_acquisition"}))
EVIDENCE = f"""ev0 AS (SELECT *, {_case("extent_competed_description", evidence.EXTENT, "unknown")} AS extent_kind, {_case("solicitation_procedure_description", evidence.PROCEDURE, "unknown")} AS procedure_kind,
  CASE WHEN other_than_full_and_open_description IS NULL THEN 'none_reported' ELSE {_case("other_than_full_and_open_description", evidence.AUTHORITY, "unknown_reported")} END AS authority_kind,
  CASE WHEN number_of_offers_received IS NULL THEN 'unknown' WHEN number_of_offers_received = 0 THEN 'zero_reported' WHEN number_of_offers_received = 1 THEN 'single_offer' ELSE 'multiple_offers' END AS offer_kind FROM life),
ev1 AS (SELECT *, CASE WHEN extent_kind IN ('competed_under_sap', 'full_and_open', 'full_and_open_after_exclusion') THEN true WHEN extent_kind <> 'unknown' THEN false END AS process_competitive,
  CASE WHEN extent_kind IN ('competed_under_sap', 'full_and_open') THEN false WHEN extent_kind <> 'unknown' THEN true END AS sources_restricted,
  CASE WHEN procedure_kind = 'only_one_source_solicited' THEN false WHEN procedure_kind IN ({_OPEN}) THEN true END AS procedure_competitive FROM ev0),
ev AS (SELECT *, concat_ws(',', CASE WHEN process_competitive AND NOT procedure_competitive THEN 'competitive_extent_with_only_one_source_procedure' END,
    CASE WHEN NOT process_competitive AND procedure_competitive THEN 'noncompetitive_extent_with_competitive_procedure' END,
    CASE WHEN extent_kind = 'full_and_open' AND authority_kind NOT IN ('none_reported', 'unknown_reported') THEN 'full_and_open_extent_with_noncompetition_authority' END) AS conflicts,
  concat_ws(',', CASE WHEN number_of_offers_received = 1 THEN 'single_offer_is_outcome_not_process_classification' WHEN number_of_offers_received = 0 THEN 'zero_offers_reported' END,
    CASE WHEN extent_kind = 'full_and_open_after_exclusion' THEN 'competition_reported_after_exclusion_of_sources' END,
    CASE WHEN procedure_kind = 'simplified_acquisition' THEN 'simplified_acquisition_can_be_competitive_or_noncompetitive' END,
    CASE WHEN extent_kind = 'unknown' AND extent_competed_description IS NOT NULL THEN 'unrecognized_extent_description' END,
    CASE WHEN procedure_kind = 'unknown' AND solicitation_procedure_description IS NOT NULL THEN 'unrecognized_solicitation_procedure_description' END,
    CASE WHEN authority_kind = 'unknown_reported' THEN 'unrecognized_other_than_full_open_authority' END,
    CASE WHEN NOT process_competitive AND authority_kind = 'none_reported' THEN 'noncompetitive_extent_without_reported_authority' END) AS notes,
  concat_ws(',', CASE WHEN extent_competed_description IS NULL THEN 'extent_competed' END, CASE WHEN number_of_offers_received IS NULL THEN 'number_of_offers_received' END,
    CASE WHEN solicitation_procedure_description IS NULL THEN 'solicitation_procedure' END,
    CASE WHEN NOT process_competitive AND other_than_full_and_open_description IS NULL THEN 'other_than_full_and_open_authority' END) AS missing_core FROM ev1)"""

COMPETITION_EVIDENCE = with_(canon(), LIFE, EVIDENCE) + "SELECT transaction_id, extent_kind, procedure_kind, authority_kind, offer_kind, process_competitive, sources_restricted, procedure_competitive, conflicts, notes, missing_core FROM ev"

_P = "competition_"
_NO_OFFERS, _NO_PROCESS = "WHEN number_of_offers_received IS NULL THEN 'number_of_offers_received_missing'", "WHEN process_competitive IS NULL THEN 'competition_process_unknown'"
_REASONS = ",\n  ".join(
    f"CASE {when} END AS {_P}{name}__reason"
    for name, when in {
        "offers_received": _NO_OFFERS,
        "reported_process_competitive": _NO_PROCESS,
        "reported_sources_restricted_or_unavailable": "WHEN sources_restricted IS NULL THEN 'source_restriction_status_unknown'",
        "single_offer_reported": _NO_OFFERS,
        "multiple_offers_reported": _NO_OFFERS,
        "zero_offers_reported": _NO_OFFERS,
        "only_one_source_solicited": "WHEN procedure_kind = 'unknown' THEN 'solicitation_procedure_unknown'",
        "full_open_after_exclusion": "WHEN extent_kind = 'unknown' THEN 'competition_extent_unknown'",
        "single_offer_under_reported_competitive_process": f"{_NO_OFFERS} {_NO_PROCESS}",
        "single_offer_under_reported_noncompetitive_process": f"{_NO_OFFERS} {_NO_PROCESS}",
    }.items()
)
COMPETITION_FEATURES = with_(canon(), LIFE, EVIDENCE) + f"""SELECT transaction_id, award_id, CAST(number_of_offers_received AS DOUBLE) AS {_P}offers_received, CAST(process_competitive AS DOUBLE) AS {_P}reported_process_competitive,
  CAST(sources_restricted AS DOUBLE) AS {_P}reported_sources_restricted_or_unavailable, CAST(number_of_offers_received = 1 AS DOUBLE) AS {_P}single_offer_reported,
  CAST(number_of_offers_received >= 2 AS DOUBLE) AS {_P}multiple_offers_reported, CAST(number_of_offers_received = 0 AS DOUBLE) AS {_P}zero_offers_reported,
  CASE WHEN procedure_kind <> 'unknown' THEN CAST(procedure_kind = 'only_one_source_solicited' AS DOUBLE) END AS {_P}only_one_source_solicited,
  CAST(authority_kind <> 'none_reported' AS DOUBLE) AS {_P}other_than_full_open_authority_reported,
  CASE WHEN extent_kind <> 'unknown' THEN CAST(extent_kind = 'full_and_open_after_exclusion' AS DOUBLE) END AS {_P}full_open_after_exclusion,
  CASE WHEN number_of_offers_received IS NOT NULL AND process_competitive IS NOT NULL THEN CAST(number_of_offers_received = 1 AND process_competitive AS DOUBLE) END AS {_P}single_offer_under_reported_competitive_process,
  CASE WHEN number_of_offers_received IS NOT NULL AND process_competitive IS NOT NULL THEN CAST(number_of_offers_received = 1 AND NOT process_competitive AS DOUBLE) END AS {_P}single_offer_under_reported_noncompetitive_process,
  CAST(len(list_filter(string_split(conflicts, ','), lambda x: x <> '')) AS DOUBLE) AS {_P}evidence_conflict_count, CAST(len(list_filter(string_split(missing_core, ','), lambda x: x <> '')) AS DOUBLE) AS {_P}missing_core_field_count,
  CAST(extent_kind = 'unknown' AND extent_competed_description IS NOT NULL AS DOUBLE) + CAST(procedure_kind = 'unknown' AND solicitation_procedure_description IS NOT NULL AS DOUBLE) + CAST(authority_kind = 'unknown_reported' AS DOUBLE) AS {_P}unrecognized_reported_value_count,
  {_REASONS}
FROM ev"""

_FLAGS = {"process_known": "process_competitive IS NOT NULL", "competitive": "process_competitive", "noncompetitive": "NOT process_competitive", "offers_known": "number_of_offers_received IS NOT NULL", "single_offer": "number_of_offers_received = 1", "multiple_offers": "number_of_offers_received >= 2", "zero_offers": "number_of_offers_received = 0", "procedure_known": "procedure_kind <> 'unknown'", "only_one_source": "procedure_kind = 'only_one_source_solicited'", "authority": "authority_kind <> 'none_reported'", "after_exclusion": "extent_kind = 'full_and_open_after_exclusion'", "conflict": "conflicts <> ''", "missing_core": "missing_core <> ''"}
_OVER = {"process_known": "awards", "offers_known": "awards", "procedure_known": "awards", "competitive": "process_known", "noncompetitive": "process_known", "single_offer": "offers_known", "multiple_offers": "offers_known", "zero_offers": "offers_known", "only_one_source": "procedure_known", "authority": "awards", "after_exclusion": "awards", "conflict": "awards", "missing_core": "awards"}
_BASE_EVIDENCE = "b AS (SELECT * EXCLUDE (missing_core), extent_kind <> 'unknown' AS extent_known, " + ", ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END AS {n}" for n, x in _FLAGS.items()) + " FROM ev WHERE lifecycle = 'base_award')"
_COMP_KEYED = keyed("b", "award_id, extent_known, " + ", ".join(_FLAGS), "competition_", True)

COMPETITION_MARKETS = with_(canon(), LIFE, EVIDENCE, _BASE_EVIDENCE, _COMP_KEYED) + f""", g AS (SELECT peer_key, count(*) AS awards, {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in _FLAGS)} FROM keyed WHERE peer_key IS NOT NULL GROUP BY peer_key)
SELECT *, {", ".join(f"round({a} / CAST(nullif({b}, 0) AS DOUBLE), {R}) AS {a}_rate" for a, b in _OVER.items())} FROM g"""

_RATES = {"peer_noncompetitive_process_rate": "noncompetitive/process_known", "peer_single_offer_rate": "single_offer/offers_known", "peer_zero_offer_rate": "zero_offers/offers_known", "peer_only_one_source_solicited_rate": "only_one_source/procedure_known", "peer_noncompetition_authority_reported_rate": "authority/n", "peer_full_open_after_exclusion_rate": "after_exclusion/n", "peer_conflict_rate": "conflict/n", "peer_missing_core_field_rate": "missing_core/n"}
_DEVIATIONS = {"noncompetitive_process_deviation": ("noncompetitive/process_known", "process_known = 1"), "single_offer_deviation": ("single_offer/offers_known", "offers_known = 1"), "zero_offer_deviation": ("zero_offers/offers_known", "offers_known = 1"), "only_one_source_solicited_deviation": ("only_one_source/procedure_known", "procedure_known = 1"), "noncompetition_authority_reported_deviation": ("authority/n", "true"), "full_open_after_exclusion_deviation": ("after_exclusion/n", "extent_known"), "conflict_deviation": ("conflict/n", "true"), "missing_core_field_deviation": ("missing_core/n", "true")}


def _rate(x: str) -> str:
    a, b = x.split("/")
    return f"p_{a} / CAST(nullif(p_{b}, 0) AS DOUBLE)"


def competition_context(held: str = "true") -> str:
    own = keyed("b", f"award_id, {held} AS held, extent_known, " + ", ".join(_FLAGS), "competition_", True)
    return with_(canon(), LIFE, EVIDENCE, _BASE_EVIDENCE, own) + f""", l AS (SELECT *, count(*) FILTER (held) OVER w AS p_n, {", ".join(f"sum({n}) FILTER (held) OVER w AS p_{n}" for n in _FLAGS)} FROM keyed WHERE peer_key IS NOT NULL
  WINDOW w AS (PARTITION BY peer_key ORDER BY award_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)),
q AS (SELECT *, row_number() OVER (PARTITION BY award_id ORDER BY ordinal) AS rn FROM l WHERE p_n >= 10 AND p_process_known >= 5 AND p_offers_known >= 5 AND p_procedure_known >= 5
  AND p_process_known >= 0.25 * p_n AND p_offers_known >= 0.25 * p_n AND p_procedure_known >= 0.25 * p_n)
SELECT life.transaction_id, q.level, CAST(p_n AS DOUBLE) AS competition_context_reference_base_award_count, {", ".join(f"round({_rate(x)}, {R}) AS competition_context_{n}" for n, x in {"process_coverage": "process_known/n", "offer_coverage": "offers_known/n", "procedure_coverage": "procedure_known/n", **_RATES}.items())},
  {", ".join(f"CASE WHEN q.{c} THEN round(q.{x.split('/')[0]} - {_rate(x)}, {R}) END AS competition_context_{n}" if c != "true" else f"round(q.{x.split('/')[0]} - {_rate(x)}, {R}) AS competition_context_{n}" for n, (x, c) in _DEVIATIONS.items())},
  CASE WHEN life.lifecycle <> 'base_award' AND h.award_id IS NULL THEN 'base_award_reference_missing_for_modification' WHEN q.level IS NULL THEN 'no_supported_competition_market' END AS reason
FROM life LEFT JOIN (SELECT award_id FROM b WHERE {held}) h ON life.award_id = h.award_id LEFT JOIN q ON life.award_id = q.award_id AND q.rn = 1 AND (q.held OR life.lifecycle = 'base_award')"""


COMPETITION_CONTEXT = competition_context()
COMPETITION_CONTEXT_FROZEN = competition_context(FROZEN)


def _activity(name: str = "act") -> str:
    m = "lifecycle = 'modification'"
    money = lambda x: f"CAST(coalesce(sum({x}) FILTER ({m}), 0) AS DOUBLE)"
    return f"""nums AS (SELECT award_id, modification, count(*) AS n FROM life WHERE {m} GROUP BY award_id, modification),
nm AS (SELECT award_id, max(n) AS mx FROM nums GROUP BY award_id),
{name} AS (SELECT award_id, count(*) AS transactions, count(*) FILTER (lifecycle = 'base_award') AS base_actions, count(*) FILTER ({m}) AS modifications, count(*) FILTER (lifecycle = 'unknown') AS unknown_actions,
  count(DISTINCT modification) FILTER ({m}) AS modification_numbers, coalesce(max(mx), 0) AS max_per_number, {money("action_obligation")} AS net, {money("abs(action_obligation)")} AS gross,
  {money("greatest(action_obligation, 0)")} AS positive, {money("greatest(-action_obligation, 0)")} AS deobligation, count(*) FILTER ({m} AND action_obligation > 0) AS positives,
  count(*) FILTER ({m} AND action_obligation < 0) AS deobligations, count(*) FILTER ({m} AND action_obligation = 0) AS zeros, CAST(coalesce(max(abs(action_obligation)) FILTER ({m}), 0) AS DOUBLE) AS largest,
  min(action_date) AS first_date, max(action_date) AS last_date FROM life LEFT JOIN nm USING (award_id) GROUP BY award_id)"""


CHANGE_ACTIVITY = with_(canon(True), LIFE, _activity()) + "SELECT * REPLACE (round(net, 2) AS net, round(gross, 2) AS gross, round(positive, 2) AS positive, round(deobligation, 2) AS deobligation, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date) FROM act"

_METRICS = {"modification_count": "CAST(modifications AS DOUBLE)", "modification_rate": "modifications / CAST(days AS DOUBLE)", "gross_ratio": "gross / size", "net_ratio": "net / size", "deobligation_ratio": "deobligation / size"}
_OWN = {"sized": "size IS NOT NULL", "modified": "modifications > 0", "deobligated": "deobligations > 0", "raised": "positives > 0"}
_SHARE = lambda x: f"(m_{x} - o.{x} * o.own) / CAST(members - o.own AS DOUBLE)"
_PLAIN = {
    "peer_award_count": "CAST(members - o.own AS DOUBLE)",
    "peer_base_obligation_coverage": _SHARE("sized"),
    "target_observable_followup_days": "CAST(o.days AS DOUBLE)",
    "lifecycle_unknown_action_count": "CAST(o.unknown_actions AS DOUBLE)",
    "max_transactions_on_one_modification_number": "CAST(o.max_per_number AS DOUBLE)",
    "modification_action_count": "o.modification_count",
    "distinct_modification_number_count": "CAST(o.modification_numbers AS DOUBLE)",
    "modification_actions_per_observed_day": "o.modification_rate",
    "gross_modification_activity_per_observed_day": "o.gross / o.days",
    "gross_modification_to_base_obligation": "o.gross_ratio",
    "net_modification_to_base_obligation": "o.net_ratio",
    "deobligation_to_base_obligation": "o.deobligation_ratio",
    "peer_modification_prevalence": _SHARE("modified"),
    "peer_deobligation_prevalence": _SHARE("deobligated"),
    "peer_positive_modification_prevalence": _SHARE("raised"),
    "modification_presence_deviation": f"o.modified - {_SHARE('modified')}",
    "deobligation_presence_deviation": f"o.deobligated - {_SHARE('deobligated')}",
    "positive_modification_presence_deviation": f"o.raised - {_SHARE('raised')}",
}
def change_features(held: str = "true", at: str | None = None) -> str:
    """held: whether the reference holds an award, from its rows; at: the day of the histories."""
    life = LIFE if at is None else LIFE + f",\nlife0 AS (SELECT * FROM life WHERE action_date <= DATE '{at}')"
    activity = _activity() if at is None else _activity().replace("FROM life ", "FROM life0 ")
    end = "(SELECT max(action_date) FROM life)" if at is None else f"DATE '{at}'"
    return with_(canon(True), life, activity) + f""", o0 AS (SELECT a.*, l.action_date, l.awarding_agency_code, l.awarding_subtier_agency_code, l.psc_code, l.naics_code, l.award_type_code, date_diff('day', l.action_date, {end}) + 1 AS days, CASE WHEN {held} THEN 1 ELSE 0 END AS own,
  nullif(abs(CAST(l.award_total_obligation AS DOUBLE)), 0) AS size FROM act a JOIN {'life' if at is None else 'life0'} l ON a.award_id = l.award_id AND l.lifecycle = 'base_award' WHERE base_actions = 1),
o AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in _METRICS.items())}, {", ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END AS {n}" for n, x in _OWN.items())} FROM o0),
{keyed("o", "award_id, own, " + ", ".join([*_METRICS, *_OWN]), "award_change_", True)},
g AS (SELECT peer_key, count(*) AS members, {", ".join(f"sum({n}) AS m_{n}" for n in _OWN)} FROM keyed WHERE peer_key IS NOT NULL AND own = 1 GROUP BY peer_key),
pick AS (SELECT * FROM (SELECT k.award_id, k.level, g.*, row_number() OVER (PARTITION BY k.award_id ORDER BY k.ordinal) AS rn FROM keyed k JOIN g ON k.peer_key = g.peer_key AND members - k.own >= 10) WHERE rn = 1),
every AS ({" UNION ALL ".join(f"SELECT award_id AS id, own, '{m}|' || peer_key AS g, {m} AS v FROM keyed WHERE {m} IS NOT NULL AND peer_key IN (SELECT peer_key FROM pick)" for m in _METRICS)}),
mem AS (SELECT id, g, v FROM every WHERE own = 1),
tgt AS (SELECT every.id, every.g, every.v FROM every JOIN pick ON id = award_id AND g[strpos(g, '|') + 1:] = peer_key),
{distribution("dd", "tgt", "mem")},
wide AS (SELECT id, {", ".join(f"round(max(CASE WHEN g LIKE '{m}|%' THEN {e} END), {R}) AS award_change_{m}_{k}" for m in _METRICS for k, e in (("position", "pos"), ("modified_z", "z"), ("iqr_distance", "dist")))} FROM dd GROUP BY id)
SELECT a.award_id, level, {", ".join(f"round({x}, {R}) AS award_change_{n}" for n, x in _PLAIN.items())}, {", ".join(f"award_change_{m}_{k}" for m in _METRICS for k in ("position", "modified_z", "iqr_distance"))},
  CASE WHEN a.base_actions > 1 THEN 'award_change_reference_ambiguous_multiple_base_actions' WHEN a.base_actions = 0 THEN 'award_change_reference_missing_or_no_observed_base_action' WHEN level IS NULL THEN 'no_supported_award_change_market' END AS reason
FROM act a LEFT JOIN pick p ON a.award_id = p.award_id LEFT JOIN o ON a.award_id = o.award_id AND p.award_id IS NOT NULL LEFT JOIN wide ON a.award_id = wide.id"""


CHANGE_FEATURES = change_features()
#: Awards of one source are told of against those of the others, as all were known at a day.
CHANGE_HELD, CHANGE_AT = "source_name <> 'orders-0'", "1996-12-31"
CHANGE_FROZEN = change_features("l." + CHANGE_HELD, CHANGE_AT)
FIRST_BASE = with_(canon(True), LIFE) + """SELECT award_id, count(*) AS base_actions, count(*) - 1 AS conflicts, arg_min(transaction_id, (action_date, transaction_id)) AS transaction_id, CAST(min(action_date) AS VARCHAR) AS action_date,
  arg_min(CAST(action_obligation AS DOUBLE), (action_date, transaction_id)) AS action_obligation FROM life WHERE lifecycle = 'base_award' GROUP BY award_id"""

_FIELDS = ("award_id", "transaction_id", "modification_number", "award_type_code", "recipient_name", "recipient_uei", "recipient_legacy_id", "parent_recipient_uei", "action_date", "action_obligation", "award_total_obligation", "awarding_agency_code", "awarding_agency_name", "awarding_subtier_agency_code", "awarding_subtier_agency_name", "psc_code", "naics_code", "extent_competed_code", "extent_competed_description", "number_of_offers_received", "solicitation_procedure_code", "solicitation_procedure_description", "other_than_full_and_open_code", "other_than_full_and_open_description")
_EXTENT, _OFFERS, _OTHER, _PROC = "extent_competed_description IS NOT NULL", "number_of_offers_received IS NOT NULL", "other_than_full_and_open_description IS NOT NULL", "solicitation_procedure_description IS NOT NULL"
_CONTEXTS = {"vendor_identity": "coalesce(recipient_uei, recipient_legacy_id, recipient_name) IS NOT NULL", "procurement_category": "coalesce(psc_code, naics_code) IS NOT NULL", "awarding_agency": "coalesce(awarding_agency_code, awarding_agency_name) IS NOT NULL", "competition_extent": _EXTENT, "competition_offers": _OFFERS, "competition_other_than_full_and_open": _OTHER, "competition_solicitation_procedure": _PROC, "competition_any": f"({_EXTENT}) OR ({_OFFERS}) OR ({_OTHER}) OR ({_PROC})", "competition_core_pair": f"({_EXTENT}) AND ({_OFFERS})"}
_MODES = {
    "vendor": "CASE WHEN recipient_uei IS NOT NULL THEN 'uei' WHEN recipient_legacy_id IS NOT NULL THEN 'legacy_identifier' WHEN recipient_name IS NOT NULL THEN 'name_only' ELSE 'missing' END",
    "category": "CASE WHEN psc_code IS NOT NULL AND naics_code IS NOT NULL THEN 'psc_and_naics' WHEN psc_code IS NOT NULL THEN 'psc_only' WHEN naics_code IS NOT NULL THEN 'naics_only' ELSE 'missing' END",
    "agency": "CASE WHEN awarding_agency_code IS NOT NULL AND awarding_agency_name IS NOT NULL THEN 'code_and_name' WHEN awarding_agency_code IS NOT NULL THEN 'code_only' WHEN awarding_agency_name IS NOT NULL THEN 'name_only' ELSE 'missing' END",
    "competition_core": f"CASE WHEN {_EXTENT} AND {_OFFERS} THEN 'extent_and_offers' WHEN {_EXTENT} THEN 'extent_only' WHEN {_OFFERS} THEN 'offers_only' ELSE 'missing' END",
    "obligation_sign": "CASE WHEN action_obligation > 0 THEN 'positive' WHEN action_obligation < 0 THEN 'negative' ELSE 'zero' END",
    "missing_pattern": f"concat_ws(',', CASE WHEN NOT ({_CONTEXTS['vendor_identity']}) THEN 'vendor_identity' END, CASE WHEN NOT ({_CONTEXTS['procurement_category']}) THEN 'category' END, CASE WHEN NOT ({_CONTEXTS['awarding_agency']}) THEN 'awarding_agency' END, CASE WHEN extent_competed_code IS NULL THEN 'extent_competed_code' END, CASE WHEN number_of_offers_received IS NULL THEN 'number_of_offers_received' END)",
    "source": "source_name",
    "source_schema": "source_schema",
    "action_fiscal_year": "CAST(year(action_date) + CASE WHEN month(action_date) >= 10 THEN 1 ELSE 0 END AS VARCHAR)",
}
_VARIED = ("award_id", "recipient_uei", "recipient_legacy_id", "awarding_agency_code", "awarding_subtier_agency_code", "psc_code", "naics_code", "source_name", "source_schema", "action_date")
_PROFILE = "prof AS (" + " UNION ALL ".join(
    ["SELECT 'population' AS section, 'all' AS name, count(*) AS n FROM canon"]
    + [f"SELECT 'field', '{f}', count({f}) FROM canon" for f in _FIELDS]
    + [f"SELECT 'context', '{k}', count(*) FILTER ({x}) FROM canon" for k, x in _CONTEXTS.items()]
    + [f"SELECT '{k}', name, count(*) FROM (SELECT {x} AS name FROM canon) GROUP BY name" for k, x in _MODES.items()]
    + [f"SELECT 'cardinality', '{f}', count(DISTINCT {f}) FROM canon" for f in _VARIED]
) + ")"
QUALITY_PROFILE = with_(canon(), _PROFILE) + "SELECT section, name, n FROM prof"
QUALITY_GATE = with_(canon(), _PROFILE) + f"""SELECT rule, section, name, round(observed, {R}) AS observed, passed, severity, CASE max(CASE WHEN passed THEN 0 WHEN severity = 'block' THEN 2 ELSE 1 END) OVER () WHEN 0 THEN 'ready' WHEN 1 THEN 'degraded' ELSE 'blocked' END AS status
FROM (SELECT rule, section, name, observed, observed >= least AND observed <= most AS passed, severity FROM (SELECT r.*, coalesce(n, 0) / CASE WHEN share THEN (SELECT CAST(n AS DOUBLE) FROM prof WHERE section = 'population') ELSE 1.0 END AS observed
  FROM (VALUES (0, 'population', 'all', 20, 1e18, false, 'block'), (1, 'context', 'vendor_identity', 0.5, 1e18, true, 'block'), (2, 'context', 'competition_core_pair', 0.3, 1e18, true, 'block'),
    (3, 'context', 'procurement_category', 0.9, 1e18, true, 'block'), (4, 'vendor', 'missing', -1, 0.05, true, 'warning'), (5, 'obligation_sign', 'zero', -1, 0.02, true, 'warning'), (6, 'cardinality', 'awarding_agency_code', 2, 1e18, false, 'block'), (7, 'cardinality', 'source_schema', -1e18, 1, false, 'warning')) r(rule, section, name, least, most, share, severity)
  LEFT JOIN prof USING (section, name)))"""

# Three features of every transaction; missing values become the median.
_MATRIX = """mat0 AS (SELECT transaction_id, award_id, CAST(action_obligation AS DOUBLE) AS amount, CAST(number_of_offers_received AS DOUBLE) AS offers, CAST(award_total_obligation AS DOUBLE) AS total FROM canon),
mat AS (SELECT transaction_id, award_id, amount, coalesce(offers, (SELECT quantile_cont(offers, 0.5) FROM mat0)) AS offers, coalesce(total, (SELECT quantile_cont(total, 0.5) FROM mat0)) AS total FROM mat0)"""
_TAIL = """ml AS (SELECT transaction_id, award_id, 'amount' AS f, amount AS v FROM mat UNION ALL SELECT transaction_id, award_id, 'offers', offers FROM mat UNION ALL SELECT transaction_id, award_id, 'total', total FROM mat),
mc AS (SELECT f, v, count(*) AS n FROM ml GROUP BY f, v),
mr AS (SELECT f, v, sum(n) OVER (PARTITION BY f ORDER BY v) AS le, sum(n) OVER (PARTITION BY f ORDER BY v DESC) AS ge, sum(n) OVER (PARTITION BY f) AS m FROM mc),
sk AS (SELECT ml.f, sum(power(v - a, 3)) < 0 AS lf FROM ml JOIN (SELECT f, avg(v) AS a FROM ml GROUP BY f) x ON ml.f = x.f GROUP BY ml.f),
tail AS (SELECT transaction_id, award_id, sum(l) AS lt, sum(r) AS rt, sum(CASE WHEN lf THEN l ELSE r END) AS st FROM (SELECT ml.*, -ln(le / CAST(m AS DOUBLE)) AS l, -ln(ge / CAST(m AS DOUBLE)) AS r, lf FROM ml JOIN mr ON ml.f = mr.f AND ml.v = mr.v JOIN sk ON ml.f = sk.f) GROUP BY transaction_id, award_id),
sc AS (SELECT *, round(greatest(lt, rt, st), 6) AS score FROM tail)"""
TAIL = with_(canon(), _MATRIX, _TAIL) + f'SELECT transaction_id, award_id, round(lt, {R}) AS "left", round(rt, {R}) AS "right", round(st, {R}) AS skewed, score FROM sc'
CALIBRATED = with_(canon(), _MATRIX, _TAIL) + f"""SELECT transaction_id, award_id, score, round(less / m, {R}) AS lower, round((less + eq / 2) / m, {R}) AS mid, round((less + eq) / m, {R}) AS upper,
  round(0.6744897501960817 * (score - med) / nullif(mad, 0), {R}) AS z, round((score - med) / nullif(iqr, 0), {R}) AS distance
FROM (SELECT transaction_id, award_id, score, CAST(rank() OVER (ORDER BY score) - 1 AS DOUBLE) AS less, CAST(count(*) OVER (PARTITION BY score) AS DOUBLE) AS eq, CAST(count(*) OVER () AS DOUBLE) AS m FROM sc),
  (SELECT quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM sc), (SELECT quantile_cont(abs(score - (SELECT quantile_cont(score, 0.5) FROM sc)), 0.5) AS mad FROM sc)"""


def top_n(n: int, ties: str) -> str:
    kind = {"include_boundary_ties": ("true", "'boundary_tie_included'"), "exclude_boundary_ties": ("false", "'boundary_tie_excluded'"), "deterministic_identity": (f"place <= {n}", f"CASE WHEN place <= {n} THEN 'boundary_tie_selected_by_identity' ELSE 'boundary_tie_not_selected_by_identity' END")}[ties]
    return with_(canon(), _MATRIX, _TAIL) + f"""SELECT transaction_id, award_id, score, best_rank, worst_rank, CASE WHEN worst_rank <= {n} THEN true WHEN best_rank > {n} THEN false ELSE {kind[0]} END AS flagged,
  CASE WHEN worst_rank < {n} THEN 'above_top_n_boundary' WHEN best_rank > {n} THEN 'below_top_n_boundary' WHEN worst_rank = {n} THEN 'boundary_selected_no_crossing_tie' ELSE {kind[1]} END AS reason
FROM (SELECT transaction_id, award_id, score, rank() OVER (ORDER BY score DESC) AS best_rank, rank() OVER (ORDER BY score DESC) + count(*) OVER (PARTITION BY score) - 1 AS worst_rank,
  row_number() OVER (ORDER BY score DESC, transaction_id, award_id) AS place FROM sc)"""


_TRUTH = "tr AS (SELECT transaction_id, CASE WHEN award_total_obligation IS NULL THEN NULL WHEN action_obligation < 0 THEN 1 ELSE 0 END AS truth FROM canon)"
EVALUATION = with_(canon(), _MATRIX, _TAIL, _TRUTH) + f"""SELECT count(*) AS known, sum(truth) AS positives,
  round((sum(CASE WHEN truth = 1 THEN lo + (hi - lo) / 2.0 END) - sum(truth) * sum(truth) / 2.0) / (sum(truth) * CAST(sum(1 - truth) AS DOUBLE)), {R}) AS auroc, round(sum(CASE WHEN truth = 1 THEN p / CAST(a AS DOUBLE) END) / sum(truth), {R}) AS average_precision
FROM (SELECT truth, rank() OVER (ORDER BY score) - 1 AS lo, rank() OVER (ORDER BY score) - 1 + count(*) OVER (PARTITION BY score) AS hi, sum(truth) OVER (ORDER BY score DESC) AS p, count(*) OVER (ORDER BY score DESC) AS a FROM sc JOIN tr USING (transaction_id) WHERE truth IS NOT NULL)"""
SPEARMAN = with_(canon(), _MATRIX) + f"""SELECT round(corr(x, y), {R}) AS rho FROM (SELECT rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0 AS x, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS y FROM mat)"""

_RANKED = "rk AS (SELECT transaction_id, award_id, score, rank() OVER (ORDER BY score DESC) AS best_rank, rank() OVER (ORDER BY score DESC) + count(*) OVER (PARTITION BY score) - 1 AS worst_rank FROM sc)"


def minimum_score(least: float) -> str:
    return with_(canon(), _MATRIX, _TAIL, _RANKED) + f"SELECT *, score >= {least} AS flagged, CASE WHEN score >= {least} THEN 'score_at_or_above_minimum' ELSE 'score_below_minimum' END AS reason FROM rk"


def queue_report(n: int) -> str:
    """With boundary ties included, so flagged rows are those of a best rank up to n."""
    return with_(canon(), _MATRIX, _TAIL, _RANKED, _TRUTH) + f"""SELECT *, round(hits / CAST(nullif(flagged_known, 0) AS DOUBLE), {R}) AS precision, round(hits / CAST(nullif(positives, 0) AS DOUBLE), {R}) AS recall,
  round(hits / CAST(nullif(flagged_known, 0) AS DOUBLE) / nullif(positives / CAST(nullif(known, 0) AS DOUBLE), 0), {R}) AS lift
FROM (SELECT count(*) FILTER (best_rank <= {n}) AS flagged, count(truth) FILTER (best_rank <= {n}) AS flagged_known, count(*) FILTER (best_rank <= {n} AND truth = 1) AS hits, count(*) FILTER (truth = 1) AS positives, count(truth) AS known
  FROM rk JOIN tr USING (transaction_id))"""


def summaries(kind: str) -> str:
    """kind: cont or disc, the quantile function."""
    q = lambda p, v="v": f"quantile_{kind}({v}, {p})"
    return with_(canon(), 'x AS (SELECT awarding_agency_code AS "group", CAST(action_obligation AS DOUBLE) AS v FROM canon)') + f""", s AS (SELECT "group", count(*) AS size, min(v) AS least, {q(0.25)} AS q1, {q(0.5)} AS median, {q(0.75)} AS q3, max(v) AS most FROM x GROUP BY "group")
SELECT s."group", size, least, round(q1, {R}) AS q1, round(median, {R}) AS median, round(q3, {R}) AS q3, most, round(q3 - q1, {R}) AS iqr, round({q(0.5, "abs(v - median)")}, {R}) AS mad
FROM s JOIN x ON s."group" = x."group" GROUP BY s."group", size, least, q1, median, q3, most"""


FLOATS = with_(canon(), _MATRIX) + f"""SELECT feature, count(v) AS present, count(*) FILTER (v <> w) AS inexact, round(max(abs(v - w)), {R}) AS largest_error
FROM (SELECT feature, v, CAST(CAST(v AS FLOAT) AS DOUBLE) AS w FROM (SELECT 'amount' AS feature, amount AS v FROM mat UNION ALL SELECT 'offers', offers FROM mat UNION ALL SELECT 'total', total FROM mat)) GROUP BY feature"""

#: Features with the reason for their absence.
EXPLAINED = {"competition_single_offer_reported": "number_of_offers_received_missing", "competition_reported_process_competitive": "competition_process_unknown", "competition_evidence_conflict_count": ""}
_TOLD = " || '; ' || ".join(f"CASE WHEN {f} IS NULL THEN '{f} unavailable: {why}' ELSE '{f} = ' || CAST({f} AS VARCHAR) END" for f, why in EXPLAINED.items())
FACTS = f"SELECT transaction_id, {_TOLD} AS facts FROM ({COMPETITION_FEATURES})"

DOCUMENT_LINES = with_(canon()) + """SELECT '{"award_id":"' || award_id || '","offers":' || coalesce(CAST(number_of_offers_received AS VARCHAR), 'null') || ',"transaction_id":"' || transaction_id || '"}'
  || CASE WHEN row_number() OVER (ORDER BY transaction_id DESC, award_id DESC) = 1 THEN '' ELSE ',' END AS line FROM canon UNION ALL SELECT ']}'"""
SAFE_TEXT = "SELECT transaction_id, CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN chr(9) || t ELSE t END AS safe FROM (SELECT transaction_id, CAST(CAST(action_obligation AS DECIMAL(18, 2)) AS VARCHAR) AS t FROM canon)"
SAFE_TEXT = with_(canon()) + SAFE_TEXT
DUPLICATES = """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'loaded' WHEN h = first_value(h) OVER w THEN 'dropped_exact_duplicate' ELSE 'quarantined' END AS outcome
  FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, CAST(l_suppkey % 3 AS VARCHAR) AS h, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  WINDOW w AS (PARTITION BY id ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) GROUP BY outcome"""
EVENT_WINDOWS = "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

# The 88 features of the clean rows: how many each transaction holds.
_CLEAN_CHANGE = CHANGE_FEATURES.replace(canon(True), canon())
_HELD = " + ".join(f"CASE WHEN {f.name} IS NULL THEN 0 ELSE 1 END" for f in CATALOG)
_ALL_FAMILIES = f"""({COMPETITION_FEATURES}) t JOIN ({AMOUNT}) USING (transaction_id) JOIN ({VENDOR_FEATURES}) USING (transaction_id) JOIN ({COMPETITION_CONTEXT}) USING (transaction_id) LEFT JOIN ({_CLEAN_CHANGE}) g ON t.award_id = g.award_id"""
COMPLETENESS = f"""SELECT transaction_id, available, {len(CATALOG)} - available AS missing, round(available / {len(CATALOG)}.0, {R}) AS completeness FROM (SELECT transaction_id, CAST({_HELD} AS BIGINT) AS available FROM {_ALL_FAMILIES})"""

SELECTED = ("competition_offers_received", "competition_single_offer_reported", "competition_multiple_offers_reported", "competition_zero_offers_reported", "competition_reported_process_competitive", "competition_reported_sources_restricted_or_unavailable", "competition_full_open_after_exclusion")
SELECTION = f"SELECT transaction_id, award_id, {', '.join(SELECTED)} FROM ({COMPETITION_FEATURES}) WHERE {' AND '.join(f'{n} IS NOT NULL' for n in SELECTED)}"
_BY_FAMILY = {(f.source, f.family): [x.name for x in CATALOG if (x.source, x.family) == (f.source, f.family)] for f in CATALOG}
CATALOG_COUNTS = f"WITH t AS (SELECT {', '.join(f'count({f.name}) AS {f.name}' for f in CATALOG)} FROM {_ALL_FAMILIES}) " + " UNION ALL ".join(f"SELECT '{s}' AS source, '{f}' AS family, {len(names)} AS features, {' + '.join(names)} AS available FROM t" for (s, f), names in _BY_FAMILY.items())

#: The features of the registered review, those of them that are scaled by their deviation, and the decimals of its matrix.
PLAN_FEATURES = (
    "amount_signed_position",
    "amount_magnitude_modified_z",
    "amount_same_direction_magnitude_position",
    "vendor_share_identified_new_awards",
    "vendor_share_of_largest_observed_winner",
    "vendor_win_count_position",
    "competition_offers_received",
    "competition_context_missing_core_field_deviation",
    "competition_context_noncompetitive_process_deviation",
    "competition_context_single_offer_deviation",
    "award_change_gross_ratio_position",
    "award_change_modification_count_position",
    "award_change_modification_rate_modified_z",
    "award_change_net_ratio_modified_z",
)
PLAN_STANDARD, PLAN_DIGITS = PLAN_FEATURES[3:6], 4


def _scaled(f: str) -> str:
    return f"({f} - m_{f}) / s_{f}"


def _plan_spans() -> str:
    out = []
    for f in PLAN_FEATURES:
        out += [f"avg({f}) AS m_{f}", f"stddev_pop({f}) AS s_{f}"] if f in PLAN_STANDARD else [f"quantile_cont({f}, 0.5) AS m_{f}", f"quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS s_{f}"]
    return ", ".join(out)


_PLAN = f"""WITH pf AS (SELECT t.transaction_id, t.award_id, {", ".join(PLAN_FEATURES)} FROM {_ALL_FAMILIES}),
pm AS (SELECT {", ".join(f"quantile_cont({f}, 0.5) AS d_{f}" for f in PLAN_FEATURES)} FROM pf),
pw AS (SELECT transaction_id, award_id, {", ".join(f"coalesce({f}, d_{f}) AS {f}, CAST({f} IS NULL AS INT) AS {f}__missing" for f in PLAN_FEATURES)} FROM pf, pm),
ps AS (SELECT {_plan_spans()} FROM pw),
mat AS (SELECT transaction_id, award_id, {", ".join(f"round({_scaled(f)}, {PLAN_DIGITS}) AS {f}, {f}__missing" for f in PLAN_FEATURES)} FROM pw, ps)"""
_PLAN_TAIL = "ml AS (" + " UNION ALL ".join(f"SELECT transaction_id, award_id, '{f}' AS f, {f} AS v FROM mat" for f in PLAN_FEATURES) + ")" + _TAIL[_TAIL.index(",\nmc AS") :]
PLAN_CALIBRATED = _PLAN + ",\n" + _PLAN_TAIL + ",\ncal AS (" + CALIBRATED[CALIBRATED.index("SELECT transaction_id, award_id, score, round(less") :] + ")\nSELECT * FROM cal JOIN mat USING (transaction_id, award_id)"

PREPROCESSED = with_(canon()) + f"""SELECT transaction_id, award_id, amount, round((fo - avg(fo) OVER ()) / stddev_pop(fo) OVER (), {R}) AS offers, CAST(offers IS NULL AS INT) AS offers__missing,
  round((ft - quantile_cont(ft, 0.5) OVER ()) / (quantile_cont(ft, 0.9) OVER () - quantile_cont(ft, 0.1) OVER ()), {R}) AS total, CAST(total IS NULL AS INT) AS total__missing
FROM (SELECT transaction_id, award_id, CAST(action_obligation AS DOUBLE) AS amount, number_of_offers_received AS offers, award_total_obligation AS total,
  coalesce(CAST(number_of_offers_received AS DOUBLE), (SELECT quantile_cont(CAST(number_of_offers_received AS DOUBLE), 0.5) FROM canon)) AS fo, coalesce(CAST(award_total_obligation AS DOUBLE), 1000.0) AS ft FROM canon)"""

#: Tail detectors over two features each, with their weights in an ensemble.
MEMBERS = {"first": ("amount", "offers", 0.5), "second": ("offers", "total", 0.25), "third": ("amount", "total", 0.25)}


def _member(name: str, a: str, b: str) -> str:
    tail = _TAIL.replace("'offers', offers FROM", f"'{b}', {b} FROM").replace(" UNION ALL SELECT transaction_id, award_id, 'total', total FROM mat", "", 1) if b != "total" else _TAIL.replace(" UNION ALL SELECT transaction_id, award_id, 'offers', offers FROM mat", "", 1)
    tail = tail.replace("'amount' AS f, amount AS v", f"'{a}' AS f, {a} AS v")
    for cte in ("ml", "mc", "mr", "sk", "tail", "sc"):
        tail = re.sub(rf"\b{cte}\b", f"{cte}_{name}", tail)
    return tail + f""",
{name} AS (SELECT transaction_id, award_id, less / m AS lower, (less + eq / 2) / m AS mid, (less + eq) / m AS upper
  FROM (SELECT transaction_id, award_id, CAST(rank() OVER (ORDER BY score) - 1 AS DOUBLE) AS less, CAST(count(*) OVER (PARTITION BY score) AS DOUBLE) AS eq, CAST(count(*) OVER () AS DOUBLE) AS m FROM sc_{name}))"""


_MEMBERS = with_(canon(), _MATRIX, *[_member(n, a, b) for n, (a, b, _) in MEMBERS.items()])
_JOINED = "FROM first JOIN second USING (transaction_id, award_id) JOIN third USING (transaction_id, award_id)"
_COMBINED = {
    "maximum": lambda x: f"greatest({', '.join(f'{n}.{x}' for n in MEMBERS)})",
    "median": lambda x: f"list_sort([{', '.join(f'{n}.{x}' for n in MEMBERS)}])[2]",
    "weighted_mean": lambda x: " + ".join(f"{w} * {n}.{x}" for n, (_, _, w) in MEMBERS.items()),
}
_MIDS = ", ".join(f"{n}.mid" for n in MEMBERS)
ENSEMBLES = _MEMBERS + " UNION ALL ".join(f"SELECT '{m}' AS method, transaction_id, award_id, {', '.join(f'round({combine(x)}, 9) AS {x}' for x in ('lower', 'mid', 'upper'))}, round(greatest({_MIDS}) - least({_MIDS}), 9) AS disagreement {_JOINED}" for m, combine in _COMBINED.items())
STABILITY = _MEMBERS + f"""SELECT transaction_id, award_id, 3 AS runs, round(x[1], 9) AS least, round(x[3], 9) AS most, round(x[2], 9) AS median, round(list_sort([x[2] - x[1], 0.0, x[3] - x[2]])[2], 9) AS mad FROM (SELECT transaction_id, award_id, list_sort([{_MIDS}]) AS x {_JOINED})"""
RANGES = with_(canon()) + " UNION ALL ".join(f"SELECT '{f}' AS name, count({f}) AS present, CAST(min({f}) AS VARCHAR) AS least, CAST(max({f}) AS VARCHAR) AS most FROM canon" for f in ("action_date", "action_obligation", "award_total_obligation"))
_IDENTITY_GATE = """SELECT 'identity' AS gate, CASE WHEN known < 0.99 THEN 'blocked' WHEN named > 0.2 THEN 'degraded' ELSE 'ready' END AS status, 2 AS rules, CAST(known < 0.99 AS INT) + CAST(named > 0.2 AS INT) AS failed
FROM (SELECT avg(CASE WHEN coalesce(recipient_uei, recipient_legacy_id, recipient_name) IS NULL THEN 0.0 ELSE 1.0 END) AS known, avg(CASE WHEN coalesce(recipient_uei, recipient_legacy_id) IS NULL AND recipient_name IS NOT NULL THEN 1.0 ELSE 0.0 END) AS named FROM canon)"""
NAMED_GATES = with_(canon()) + f"{_IDENTITY_GATE} UNION ALL SELECT 'review', status, count(*), count(*) FILTER (NOT passed) FROM ({QUALITY_GATE}) GROUP BY status"


def _decimal(number: str, places: int) -> str:
    """The shortest text of a whole number of units of 10^-places."""
    unit = "1" + "0" * places
    whole, rest = f"abs({number}) // {unit}::HUGEINT", f"lpad(CAST(abs({number}) % {unit}::HUGEINT AS VARCHAR), {places}, '0')"
    return f"CASE WHEN {number} = 0 THEN '0' ELSE CASE WHEN {number} < 0 THEN '-' ELSE '' END || CAST({whole} AS VARCHAR) || rtrim(rtrim('.' || {rest}, '0'), '.') END"


def _quarter(k: int, of: int = 4) -> str:
    """Type-7 quantile k / of as a whole number, `of` times the value, from the sorted list x."""
    place = f"((len(x) - 1) * {k})"
    return f"x[{place} // {of} + 1] * {of} + (x[least({place} // {of} + 2, len(x))] - x[{place} // {of} + 1]) * ({place} % {of})"


# All in whole numbers: millionths, their quarters and eighths.
EXACT_SUMMARIES = with_(canon()) + f""", u AS (SELECT awarding_agency_code AS "group", CAST(action_obligation * 100 AS HUGEINT) * 100000000000000::HUGEINT + date_diff('day', DATE '1990-01-01', action_date) AS v FROM canon),
l AS (SELECT "group", list(v ORDER BY v) AS x FROM u GROUP BY "group"),
q AS (SELECT "group", len(x) AS size, x[1] AS least, x[len(x)] AS most, {_quarter(1)} AS q1, {_quarter(2)} AS median, {_quarter(3)} AS q3 FROM l),
a AS (SELECT "group", list(abs(4 * v - median) ORDER BY abs(4 * v - median)) AS x FROM u JOIN q USING ("group") GROUP BY "group"),
m AS (SELECT "group", {_quarter(1, 2)} AS mad FROM a)
SELECT "group", size, {_decimal("least", 6)} AS least, {_decimal("(q1 * 25)", 8)} AS q1, {_decimal("(median * 25)", 8)} AS median, {_decimal("(q3 * 25)", 8)} AS q3, {_decimal("most", 6)} AS most,
  {_decimal("((q3 - q1) * 25)", 8)} AS iqr, {_decimal("(mad * 125)", 9)} AS mad FROM q JOIN m USING ("group")"""

#: Models are learned from what came before this day.
SPLIT = "1996-01-01"
TRAINED_APART = with_(canon()) + f""", r AS (SELECT transaction_id, award_id, action_date >= DATE '{SPLIT}' AS later, CAST(action_obligation AS DOUBLE) AS amount, CAST(number_of_offers_received AS DOUBLE) AS offers, CAST(award_total_obligation AS DOUBLE) AS total FROM canon),
md AS (SELECT quantile_cont(amount, 0.5) AS a, quantile_cont(offers, 0.5) AS o, quantile_cont(total, 0.5) AS t FROM r WHERE NOT later),
w AS (SELECT transaction_id, award_id, later, coalesce(amount, a) AS amount, coalesce(offers, o) AS offers, coalesce(total, t) AS total FROM r, md),
sp AS (SELECT quantile_cont(amount, 0.5) AS ma, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS sa, avg(offers) AS mo, stddev_pop(offers) AS so, quantile_cont(total, 0.5) AS mt, quantile_cont(total, 0.75) - quantile_cont(total, 0.25) AS st FROM w WHERE NOT later),
mat AS (SELECT transaction_id, award_id, later, (amount - ma) / sa AS amount, (offers - mo) / so AS offers, (total - mt) / st AS total FROM w, sp),
ml AS (SELECT transaction_id, award_id, later, 'amount' AS f, amount AS v FROM mat UNION ALL SELECT transaction_id, award_id, later, 'offers', offers FROM mat UNION ALL SELECT transaction_id, award_id, later, 'total', total FROM mat),
mc AS (SELECT f, v, count(*) FILTER (NOT later) AS n FROM ml GROUP BY f, v),
mr AS (SELECT f, v, greatest(sum(n) OVER (PARTITION BY f ORDER BY v), 1) AS le, greatest(sum(n) OVER (PARTITION BY f ORDER BY v DESC), 1) AS ge, sum(n) OVER (PARTITION BY f) AS m FROM mc),
sk AS (SELECT ml.f, sum(power(v - a, 3)) < 0 AS lf FROM ml JOIN (SELECT f, avg(v) AS a FROM ml WHERE NOT later GROUP BY f) x ON ml.f = x.f WHERE NOT later GROUP BY ml.f),
tail AS (SELECT transaction_id, award_id, later, sum(l) AS lt, sum(r) AS rt, sum(CASE WHEN lf THEN l ELSE r END) AS st FROM (SELECT ml.*, -ln(le / CAST(m AS DOUBLE)) AS l, -ln(ge / CAST(m AS DOUBLE)) AS r, lf FROM ml JOIN mr ON ml.f = mr.f AND ml.v = mr.v JOIN sk ON ml.f = sk.f) GROUP BY transaction_id, award_id, later),
sc AS (SELECT *, round(greatest(lt, rt, st), {R}) AS score FROM tail),
ac AS (SELECT score, count(*) FILTER (NOT later) AS n FROM sc GROUP BY score),
ar AS (SELECT score, CAST(sum(n) OVER (ORDER BY score) - n AS DOUBLE) AS less, CAST(n AS DOUBLE) AS eq, CAST(sum(n) OVER () AS DOUBLE) AS m FROM ac),
md2 AS (SELECT quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM sc WHERE NOT later),
md3 AS (SELECT quantile_cont(abs(score - med), 0.5) AS mad FROM sc, md2 WHERE NOT later)
SELECT transaction_id, award_id, score, round(less / m, {R}) AS lower, round((less + eq / 2) / m, {R}) AS mid, round((less + eq) / m, {R}) AS upper, round(0.6744897501960817 * (score - med) / nullif(mad, 0), {R}) AS z, round((score - med) / nullif(iqr, 0), {R}) AS distance, round(amount, {R}) AS amount, round(offers, {R}) AS offers, round(total, {R}) AS total
FROM sc JOIN ar USING (score) JOIN mat USING (transaction_id, award_id, later), md2, md3 WHERE later"""
