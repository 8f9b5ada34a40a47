"""Contract transactions in the canonical columns, derived from the order tables.

The same SQL runs in Spark and in any engine that holds the tables, so results can be
compared.  With raw line numbers awards may have no base action or several; in the
clean form every award has exactly one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")

_SQL = """
SELECT 'A' || CAST(l_orderkey AS STRING) AS award_id,
       'A' || CAST(l_orderkey AS STRING) || '-' || CAST(seq AS STRING) AS transaction_id,
       CASE {modification} END AS modification_number,
       o_orderstatus AS award_type_code,
       CASE WHEN identity_mode = 'none' THEN NULL ELSE s_name END AS recipient_name,
       CASE WHEN identity_mode = 'uei' THEN 'uei' || CAST(l_suppkey AS STRING) END AS recipient_uei,
       CASE WHEN identity_mode = 'legacy' THEN 'L' || CAST(l_suppkey AS STRING) END AS recipient_legacy_id,
       CASE WHEN s_nationkey % 5 <> 0 THEN 'PARENT' || CAST(s_nationkey AS STRING) END AS parent_recipient_uei,
       CAST(l_shipdate AS DATE) AS action_date,
       CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice
                 WHEN l_returnflag = 'N' AND CAST(l_quantity AS BIGINT) % 10 = 0 THEN 0
                 ELSE l_extendedprice END AS DECIMAL(18, 2)) AS action_obligation,
       CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(18, 2)) AS award_total_obligation,
       'R' || CAST(n_regionkey AS STRING) AS awarding_agency_code,
       r_name AS awarding_agency_name,
       CASE WHEN o_custkey % 11 <> 0 THEN 'N' || CAST(c_nationkey AS STRING) END AS awarding_subtier_agency_code,
       CASE WHEN o_custkey % 11 <> 0 THEN n_name END AS awarding_subtier_agency_name,
       CASE WHEN l_partkey % 9 <> 0 THEN p_type END AS psc_code,
       CASE WHEN l_partkey % 31 = 0 THEN 'X1'
            ELSE '54' || lpad(CAST(l_partkey % 25 AS STRING), 2, '0') || lpad(CAST(p_size % 4 AS STRING), 2, '0') END AS naics_code,
       CAST(NULL AS STRING) AS extent_competed_code,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Not Competed' WHEN '2' THEN 'Full and Open Competition after exclusion of sources'
            WHEN '3' THEN 'Full and Open Competition' WHEN '5' THEN 'Competed under SAP' END AS extent_competed_description,
       CASE WHEN CAST(l_quantity AS BIGINT) % 6 < 5 THEN CAST(CAST(l_quantity AS BIGINT) % 6 AS INT) END AS number_of_offers_received,
       CAST(NULL AS STRING) AS solicitation_procedure_code,
       CASE l_suppkey % 4 WHEN 0 THEN 'Negotiated Proposal/Quote' WHEN 1 THEN 'Only One Source'
            WHEN 2 THEN 'Simplified Acquisition' ELSE 'Mystery Method' END AS solicitation_procedure_description,
       CAST(NULL AS STRING) AS other_than_full_and_open_code,
       CASE l_partkey % 6 WHEN 0 THEN 'Urgency' WHEN 1 THEN 'Odd Reason' END AS other_than_full_and_open_description,
       'orders-' || CAST(c_nationkey % 3 AS STRING) AS source_name,
       'canonical-1' AS source_schema
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
             CASE WHEN l_suppkey % 25 = 7 THEN 'none' WHEN l_suppkey % 10 = 0 THEN 'name' WHEN l_suppkey % 10 = 5 THEN 'legacy' ELSE 'uei' END AS identity_mode
      FROM {lineitem}) l
JOIN {orders} o ON l_orderkey = o_orderkey
JOIN {customer} c ON o_custkey = c_custkey
JOIN {nation} n ON c_nationkey = n_nationkey
JOIN {region} r ON n_regionkey = r_regionkey
JOIN {part} p ON l_partkey = p_partkey
JOIN {supplier} s ON l_suppkey = s_suppkey
"""

_CLEAN = "WHEN seq = 1 THEN '0' ELSE 'P' || lpad(CAST(seq - 1 AS STRING), 5, '0')"
_RAW = "WHEN l_linenumber = 1 THEN '0' WHEN l_linenumber = 7 THEN NULL ELSE 'P' || lpad(CAST(l_linenumber AS STRING), 5, '0')"

#: The customer's tables joined to the lines, and the same joined to the fewer orders first, which saves a shuffle of all lines.
_BY_LINE = """JOIN {orders} o ON l_orderkey = o_orderkey
JOIN {customer} c ON o_custkey = c_custkey
JOIN {nation} n ON c_nationkey = n_nationkey
JOIN {region} r ON n_regionkey = r_regionkey
"""
_BY_ORDER = """JOIN (SELECT /*+ BROADCAST(n, r) */ * FROM {orders} o
JOIN {customer} c ON o_custkey = c_custkey
JOIN {nation} n ON c_nationkey = n_nationkey
JOIN {region} r ON n_regionkey = r_regionkey) o ON l_orderkey = o_orderkey
"""


def canonical_sql(raw: bool = False) -> str:
    """The view's SQL over tables of the usual names."""
    return _SQL.format(modification=_RAW if raw else _CLEAN, **{t: t for t in TABLES})


def canonical(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """One row for each transaction; raw: with the modification numbers as they are."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(_SQL.replace(_BY_LINE, _BY_ORDER).replace("{modification}", _RAW if raw else _CLEAN), **tables)
