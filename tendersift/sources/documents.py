"""One ordered document in many part files.

A document is a header line, one line for each record in the order of its identity, and a
trailer line.  Its parts are cut by ranges of that order, so the part files, read one after
the other by name, are the same bytes for any number of parts; no task and no driver
holds more than a part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tendersift.sources.export import spreadsheet_safe
from tendersift.sources.manifest import table_digest

IDENT = ["transaction_id", "award_id"]


class DocumentError(ValueError):
    """A document that is incomplete or differs from its header."""


def _checked(rows: DataFrame, ident: list[str]) -> None:
    if rows.groupBy(*ident).count().filter("count > 1").head(1):
        raise DocumentError(f"an identity ({', '.join(ident)}) stands twice")


def _written(header: str, lines: DataFrame, trailer: str | None, path: str, ident: list[str], parts: int) -> None:
    """lines: ident and value."""
    spark, kinds = lines.sparkSession, dict(lines.dtypes)
    ends = [(0, header)] + ([] if trailer is None else [(2, trailer)])
    edge = spark.createDataFrame(ends, "section int, value string").select("section", *[F.lit(None).cast(kinds[i]).alias(i) for i in ident], "value")
    body = lines.select(F.lit(1).alias("section"), *ident, "value")
    order = ["section", *ident]
    edge.unionByName(body).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value").write.mode("errorifexists").text(path)


def record_lines(rows: DataFrame, ident: list[str]) -> DataFrame:
    """ident and value: each row as JSON with sorted keys, a comma after all but the last."""
    line: Column = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    last = rows.agg(F.max(F.struct(*ident)).alias("last"))  # one row
    comma = F.when(F.struct(*ident) == F.col("last"), "").otherwise(",")
    return rows.crossJoin(F.broadcast(last)).select(*ident, F.concat(line, comma).alias("value"))


def write_json(rows: DataFrame, path: str, kind: str, ident: list[str] = IDENT, parts: int = 16) -> dict:
    """The rows as one JSON object: kind, number and sha256 of the rows, and the records; the header is returned.  Fails if the folder is there, or an identity stands twice."""
    _checked(rows, ident)
    header = {"document": kind, "columns": sorted(rows.columns), **table_digest(rows)}
    _written(json.dumps(header, sort_keys=True)[:-1] + ', "records": [', record_lines(rows, ident), "]}", path, ident, parts)
    return header


def write_csv(rows: DataFrame, path: str, ident: list[str] = IDENT, parts: int = 16, spreadsheet: bool = True) -> None:
    """The rows as one CSV table with a single header line, all cells quoted, null an empty cell; spreadsheet: text is made safe, numbers stay."""
    _checked(rows, ident)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [quoted(spreadsheet_safe(F.col(f"`{c}`")) if spreadsheet and k == "string" else F.col(f"`{c}`").cast("string")) for c, k in rows.dtypes]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    _written(header, rows.select(*ident, F.concat_ws(",", *cells).alias("value")), None, path, ident, parts)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of a document that write_json() wrote; DocumentError if their number or sha256 is not that of the header."""
    lines = spark.read.text(path)
    heads = [r.value for r in lines.filter(F.startswith("value", F.lit('{"columns": '))).limit(2).collect()]
    if len(heads) != 1 or lines.filter("value = ']}'").count() != 1:
        raise DocumentError("a document has one header and one trailer")
    header = json.loads(heads[0] + "]}")
    body = lines.filter(~F.startswith("value", F.lit('{"columns": ')) & (F.col("value") != "]}"))
    rows = body.select(F.from_json(F.regexp_replace("value", ",$", ""), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if table_digest(rows) != {"rows": header["rows"], "sha256": header["sha256"]}:
        raise DocumentError("the records are not those of the header")
    return rows
