"""Contract transactions from archives of delimited text.

The driver inspects an archive; executors, which must see it, unpack a member each into
the shared folder, cut at record ends.  Spark reads the pieces as text columns, binds them
to canonical fields by literal header aliases and parses them.  Nothing is inferred.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import os
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tendersift.functions.text import clean
from tendersift.storage import shared_dir

#: Delimiters by the end of a member's name.
DELIMITERS = {".csv": ",", ".tsv": "\t", ".txt": "|"}


#: Bytes after which a piece of a member ends with its record.
PIECE_BYTES = 64 << 20


@dataclass(frozen=True)
class Budget:
    members: int = 512
    total_bytes: int = 8 << 30
    ratio: float = 1000.0
    columns: int = 2048
    cell: int = 131_072


#: Columns that reading adds; a header may not be one of them.
ADDED = ("source_member", "member_index", "header_sha256", "artifact_sha256", "row_seq", "flaws")


class ArchiveError(ValueError):
    pass


def normalized_header(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.strip().casefold()).strip("_")


def inspected(path: str, budget: Budget = Budget()) -> list[zipfile.ZipInfo]:
    """The members with rows; an error for unsafe names, encryption, links or sizes over the budget."""
    with zipfile.ZipFile(path) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        if len(members) > budget.members or sum(m.file_size for m in members) > budget.total_bytes:
            raise ArchiveError("the archive has too many members or bytes")
        for m in members:
            parts = PurePosixPath(m.filename.replace("\\", "/"))
            if parts.is_absolute() or ".." in parts.parts or m.flag_bits & 1 or (m.external_attr >> 16) & 0o170000 == 0o120000:
                raise ArchiveError(f"unsafe member {m.filename}")
            if m.file_size > budget.ratio * max(1, m.compress_size):
                raise ArchiveError(f"{m.filename} unpacks to too much")
        return [m for m in members if PurePosixPath(m.filename).suffix.lower() in DELIMITERS]


def header(line: str, delimiter: str, budget: Budget = Budget()) -> list[str]:
    """The normalized names of a header line: not blank, unique, none of ADDED, and within the budget."""
    names = [normalized_header(x) for x in next(csv.reader(io.StringIO(line), delimiter=delimiter), [])]
    if not names or not all(names) or len(set(names)) < len(names) or len(names) > budget.columns or not set(names).isdisjoint(ADDED):
        raise ArchiveError("no headers, or blank, repeated, reserved or too many ones")
    return names


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def raw_headers(path: str, budget: Budget = Budget()) -> dict[str, list[str]]:
    """The headers of each member with rows, as they are written."""
    out = {}
    for m in inspected(path, budget):
        with zipfile.ZipFile(path) as z, io.TextIOWrapper(z.open(m), "utf-8-sig", newline="") as src:
            out[m.filename] = next(csv.reader(src, delimiter=DELIMITERS[PurePosixPath(m.filename).suffix.lower()]), [])
    return out


def _records(lines: Iterator[str], delimiter: str) -> Iterator[str]:
    """The lines of each record; a quoted line end ends none."""
    csv.field_size_limit(sys.maxsize)
    mine: list[str] = []

    def kept() -> Iterator[str]:
        for line in lines:
            mine.append(line)
            yield line

    for _ in csv.reader(kept(), delimiter=delimiter):
        yield "".join(mine)
        mine.clear()


def _unpacked(path: str, name: str, delimiter: str, out: str, piece: int) -> str:
    """Writes a member's records to numbered files of about piece bytes in out, each below the header; returns the header.

    Bytes are kept as they are (latin-1 maps each to a letter); reading to the end checks the CRC.
    """
    os.makedirs(out)
    with zipfile.ZipFile(path) as z, io.TextIOWrapper(z.open(name), "latin-1", newline="") as src:
        rows = _records(iter(src), delimiter)
        head = next(rows, "").encode("latin-1").decode("utf-8-sig")
        row = next(rows, None)
        for number in itertools.count():
            with open(f"{out}/{number:08}", "wb") as dst:
                dst.write(head.encode())
                left = piece
                while row is not None and left > 0:
                    dst.write(row.encode("latin-1"))
                    left -= len(row)
                    row = next(rows, None)
            if row is None:
                break
    return head


def read_archive(spark: SparkSession, path: str, budget: Budget = Budget(), piece: int = PIECE_BYTES, members: tuple[str, ...] | None = None, sha256: str | None = None) -> DataFrame:
    """All rows of all members, or of the named ones, as text with where they come from.

    source_member, member_index, header_sha256 (of the normalized headers), artifact_sha256
    (of the archive) and row_seq (ascending within a member) tell the place of a row; flaws
    holds record_shape if the row has more or fewer cells than its header and long_cell if
    one is over the budget.  Members without a column have nulls in it; rows without any
    value are skipped.  sha256: what the archive's must be.
    """
    path, target = os.path.abspath(path), f"{shared_dir(spark).removeprefix('file:')}/archive-{uuid.uuid4().hex}"
    tables = [(m.filename, DELIMITERS[PurePosixPath(m.filename).suffix.lower()]) for m in inspected(path, budget)]
    if unknown := set(members or ()) - {name for name, _ in tables}:
        raise ArchiveError(f"no such members: {', '.join(sorted(unknown))}")
    chosen = [(i, t) for i, t in enumerate(tables) if members is None or t[0] in members]
    if not chosen:
        raise ArchiveError("the archive holds no table")
    artifact = sha256_of(path)
    if sha256 not in (None, artifact):
        raise ArchiveError("the archive is not the one that was planned")

    def unpack(member: tuple[int, tuple[str, str]]) -> tuple[int, str, str]:
        i, (name, delimiter) = member
        out = f"{target}/{i}-{uuid.uuid4().hex}"  # each attempt has its own
        return i, out, _unpacked(path, name, delimiter, out, piece)

    whole = None
    for i, out, head in sorted(spark.sparkContext.parallelize(chosen, len(chosen)).map(unpack).collect()):
        name, delimiter = tables[i]
        names = header(head, delimiter, budget)
        bad = "_malformed"  # normalized headers start with no underscore
        schema = ", ".join(f"`{n}` string" for n in (*names, bad))
        reader = spark.read.options(sep=delimiter, header=True, enforceSchema=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", maxCharsPerColumn=-1)
        rows = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=bad, columnPruning=False).schema(schema).csv(out)
        place = F.shiftleft(F.regexp_extract("_metadata.file_path", r"(\d+)$", 1).cast("bigint"), 33)  # a piece is read by one task, in order
        long = F.exists(F.array(*[F.length(n) for n in names]), lambda n: F.coalesce(n > budget.cell, F.lit(False)))
        flaws = F.array_compact(F.array(F.when(F.col(bad).isNotNull(), "record_shape"), F.when(long, "long_cell")))
        source = {"source_member": F.lit(name), "member_index": F.lit(i), "header_sha256": F.lit(hashlib.sha256("\n".join(names).encode()).hexdigest()), "artifact_sha256": F.lit(artifact)}
        rows = rows.withColumns(source | {"row_seq": place + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), "flaws": flaws})
        rows = rows.filter(F.coalesce(*names, bad).isNotNull()).drop(bad)
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    return whole


# Canonical fields and the headers that may hold them, the first with a value wins.
ALIASES = {
    "award_id": ("contract_award_unique_key",),
    "transaction_id": ("contract_transaction_unique_key",),
    "piid": ("award_id_piid",),
    "modification_number": ("modification_number",),
    "parent_award_id": ("parent_award_id_piid",),
    "award_type_code": ("award_type_code",),
    "recipient_name": ("recipient_name", "recipient_name_raw"),
    "recipient_uei": ("recipient_uei",),
    "recipient_legacy_id": ("recipient_duns",),
    "parent_recipient_name": ("recipient_parent_name", "recipient_parent_name_raw"),
    "parent_recipient_uei": ("recipient_parent_uei",),
    "parent_recipient_legacy_id": ("recipient_parent_duns",),
    "action_date": ("action_date",),
    "action_obligation": ("federal_action_obligation",),
    "award_total_obligation": ("total_dollars_obligated",),
    "awarding_agency_code": ("awarding_agency_code",),
    "awarding_agency_name": ("awarding_agency_name",),
    "awarding_subtier_agency_code": ("awarding_sub_agency_code",),
    "awarding_subtier_agency_name": ("awarding_sub_agency_name",),
    "awarding_office_code": ("awarding_office_code",),
    "awarding_office_name": ("awarding_office_name",),
    "funding_agency_code": ("funding_agency_code",),
    "funding_agency_name": ("funding_agency_name",),
    "naics_code": ("naics_code",),
    "psc_code": ("product_or_service_code",),
    "description": ("transaction_description",),
    "extent_competed_code": ("extent_competed_code",),
    "extent_competed_description": ("extent_competed",),
    "number_of_offers_received": ("number_of_offers_received",),
    "solicitation_procedure_code": ("solicitation_procedures_code",),
    "solicitation_procedure_description": ("solicitation_procedures",),
    "other_than_full_and_open_code": ("other_than_full_and_open_competition_code",),
    "other_than_full_and_open_description": ("other_than_full_and_open_competition",),
}
REQUIRED = ("award_id", "transaction_id", "action_date", "action_obligation")
_TYPED = {"action_date": "date", "action_obligation": "decimal(20,2)", "award_total_obligation": "decimal(20,2)", "number_of_offers_received": "int"}


def _parsed(c: Column, kind: str) -> Column:
    if kind == "date":
        return F.coalesce(c.try_cast("date"), F.to_date(c.try_cast("timestamp")))
    if kind == "int":
        number = c.try_cast("decimal(38,10)")
        return F.when((number == F.floor(number)) & (number >= 0), number).cast("int")
    return c.try_cast(kind)


def adapted(rows: DataFrame, source_name: str = "archive", aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Canonical columns of text rows, and problems: the fields that are missing though required or hold what can't be read, and the row's flaws."""
    there = set(rows.columns)
    absent = [f for f in REQUIRED if not there & set(aliases[f])]
    if absent:
        raise ArchiveError(f"no header for {', '.join(absent)}")
    text = {f: F.coalesce(*[clean(F.col(a)) for a in names if a in there]) if there & set(names) else F.lit(None).cast("string") for f, names in aliases.items()}
    value = {f: _parsed(c, _TYPED[f]) if f in _TYPED else c for f, c in text.items()}
    bad = [F.when(value[f].isNull() if f in REQUIRED else text[f].isNotNull() & value[f].isNull(), F.lit(f)) for f in (*REQUIRED, *(t for t in _TYPED if t not in REQUIRED))]
    problems = F.array_compact(F.array(*bad))
    if "flaws" in there:
        problems = F.concat("flaws", problems)
    hashed = F.sha2(F.to_json(F.struct(*[c.alias(f) for f, c in text.items()])), 256)
    return rows.select(*[c.alias(f) for f, c in value.items()], F.lit(source_name).alias("source_name"), F.lit("1").alias("source_schema"), *[c for c in ADDED if c in there and c != "flaws"], hashed.alias("row_sha256"), problems.alias("problems"))


def outcomes(rows: DataFrame, ident: str = "transaction_id", digest: str = "row_sha256", order: tuple[str, ...] = ("source_member", "row_seq")) -> DataFrame:
    """Adds outcome: loaded for the first row of an id, dropped_exact_duplicate for later equal ones, else quarantined.

    Rows with problems or without an id are quarantined and no first row; they are dealt over all tasks.
    """
    problem = F.col(ident).isNull()
    if "problems" in rows.columns:
        problem = problem | F.coalesce(F.size("problems") > 0, F.lit(False))
    w = W.partitionBy(ident, problem, F.when(problem, F.xxhash64(*order))).orderBy(*order)
    number, first = F.row_number().over(w), F.first(digest).over(w)
    return rows.withColumn("outcome", F.when(problem, "quarantined").when(number == 1, "loaded").when(F.col(digest) == first, "dropped_exact_duplicate").otherwise("quarantined"))


@dataclass(frozen=True)
class Mapping:
    """Which headers feed canonical fields: consumed, of these second choices as fallbacks, unmapped, and fields without a header."""

    consumed: tuple[str, ...]
    fallbacks: tuple[str, ...]
    unmapped: tuple[str, ...]
    absent: tuple[str, ...]


def mapping(headers: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> Mapping:
    there = set(headers) - set(ADDED)
    known = {a for names in aliases.values() for a in names}
    second = {a for names in aliases.values() for a in names[1:] if a in there and not there & set(names[: names.index(a)])}
    return Mapping(tuple(sorted(there & known)), tuple(sorted(second)), tuple(sorted(there - known)), tuple(sorted(f for f, names in aliases.items() if not there & set(names))))


def load_report(rows: DataFrame) -> DataFrame:
    """One row for outcomes(): seen, loaded, exact duplicates, conflicting ids, rows with problems and without an id; they add up to seen."""
    c = F.col
    named, bad = c("transaction_id").isNotNull(), F.coalesce(F.size("problems") > 0, F.lit(False))
    return rows.agg(
        F.count("*").alias("seen"),
        F.count_if(c("outcome") == "loaded").alias("loaded"),
        F.count_if(c("outcome") == "dropped_exact_duplicate").alias("exact_duplicates"),
        F.count_if((c("outcome") == "quarantined") & named & ~bad).alias("conflicting"),
        F.count_if((c("outcome") == "quarantined") & named & bad).alias("with_problems"),
        F.count_if(~named).alias("without_id"),
    )


def within_budget(report: DataFrame, most: int) -> None:
    """ArchiveError if more than most rows of a load_report() were quarantined."""
    row = report.first()
    bad = row.conflicting + row.with_problems + row.without_id
    if bad > most:
        raise ArchiveError(f"{bad} of {row.seen} rows are quarantined, at most {most} may be")
