"""Peer groups: keys at several levels, counts, and the first level with enough support."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.functions.text import clean, spaced_lower
from tendersift.storage import stored


@dataclass(frozen=True)
class Level:
    """agency: subtier, top or None; category: psc, naics_6 .. naics_2 or None; time: month, quarter, fiscal_year, year or None."""

    name: str
    agency: str | None
    category: str | None
    award_type: bool = False
    time: str | None = "fiscal_year"


def ladder(prefix: str = "", award_type: bool = True, time: str | None = "fiscal_year", short_naics: bool = True) -> tuple[Level, ...]:
    """The levels from the narrowest to the widest."""
    steps = [("subtier_psc_exact", "subtier", "psc", award_type), ("agency_psc_exact", "top", "psc", False)]
    steps += [(f"agency_naics_{n}", "top", f"naics_{n}", False) for n in (6, 4, 2)]
    steps += [("psc_exact", None, "psc", False)] + [(f"naics_{n}", None, f"naics_{n}", False) for n in (6, 4, 2)]
    return tuple(Level(prefix + name, agency, category, kind, time) for name, agency, category, kind in steps if short_naics or not name.endswith(("naics_4", "naics_2")))


AMOUNT, VENDOR, COMPETITION, CHANGE = ladder(), ladder("vendor_", False), ladder("competition_"), ladder("award_change_")


def agency(scope: str) -> Column:
    name = "awarding_subtier_agency" if scope == "subtier" else "awarding_agency"
    return F.coalesce(F.concat(F.lit("agency-code:"), F.upper(clean(F.col(f"{name}_code")))), F.concat(F.lit("agency-name:"), spaced_lower(F.col(f"{name}_name"))))


def category(kind: str) -> Column:
    if kind == "psc":
        return F.concat(F.lit("psc:"), F.upper(clean(F.col("psc_code"))))
    width, code = int(kind.split("_")[1]), clean(F.col("naics_code"))
    return F.when(code.rlike("^[0-9]{2,6}$") & (F.length(code) >= width), F.concat(F.lit(f"naics{width}:"), F.substring(code, 1, width)))


def fiscal_year(date: Column) -> Column:
    """The year that begins in October of the year before."""
    return F.year(date) + (F.month(date) >= 10).cast("int")


def period(kind: str) -> Column:
    date = F.col("action_date")
    shown = {
        "month": F.date_format(date, "yyyy-MM"),
        "quarter": F.concat(F.year(date), F.lit("-Q"), F.quarter(date)),
        "year": F.year(date).cast("string"),
        "fiscal_year": fiscal_year(date).cast("string"),
    }[kind]
    return F.concat(F.lit(f"{kind}:"), shown)


def parts(level: Level) -> dict[str, Column]:
    """The components of a level's key by the name of their reason."""
    out = {}
    if level.agency:
        out["agency"] = agency(level.agency)
    if level.category:
        out["category"] = category(level.category)
    if level.time:
        out["time"] = period(level.time)
    if level.award_type:
        out["award_type"] = F.concat(F.lit("type:"), F.upper(clean(F.col("award_type_code"))))
    return out or {"scope": F.lit("scope=all")}


def key(level: Level) -> Column:
    """The level's key; null if a component is missing."""
    return F.concat(F.lit(f"{level.name}|"), *[x for c in parts(level).values() for x in (c, F.lit("|"))][:-1])


def missing(level: Level) -> Column:
    """The names of the missing components, comma-joined."""
    return F.concat_ws(",", *[F.when(c.isNull(), F.lit(n)) for n, c in parts(level).items()])


def keyed(df: DataFrame, levels: tuple[Level, ...], keep: list[str]) -> DataFrame:
    """keep and the key of each level as key_0, key_1 ...: each component is made once a row, whatever the number of levels that have it."""
    kind = lambda x, n: (n, None if n == "scope" else getattr(x, n))
    need = {kind(x, n): c for x in levels for n, c in parts(x).items()}
    names = {k: f"part_{i}" for i, k in enumerate(need)}
    of = lambda x: [F.col(names[kind(x, n)]) for n in parts(x)]
    rows = df.select(*keep, *[c.alias(names[k]) for k, c in need.items()])
    return rows.select(*keep, *[F.concat(F.lit(f"{x.name}|"), *[y for c in of(x) for y in (c, F.lit("|"))][:-1]).alias(f"key_{i}") for i, x in enumerate(levels)])


def key_columns(levels: tuple[Level, ...]) -> list[str]:
    """The columns that keyed() adds."""
    return [f"key_{i}" for i in range(len(levels))]


def with_keys(df: DataFrame, levels: tuple[Level, ...], keep: list[str]) -> DataFrame:
    """keep, ordinal and peer_key: one row for each row of df and level; df may have the keys already, as of keyed()."""
    rows = df if set(key_columns(levels)) <= set(df.columns) else keyed(df, levels, keep)
    return rows.select(*keep, F.posexplode(F.array(*key_columns(levels))).alias("ordinal", "peer_key"))


def level_of(peer_key: str = "peer_key") -> Column:
    """The name of a key's level."""
    return F.substring_index(peer_key, "|", 1)


def group_counts(df: DataFrame, levels: tuple[Level, ...]) -> DataFrame:
    """Rows of df in each peer group of every level."""
    found = with_keys(df, levels, []).filter("peer_key IS NOT NULL").groupBy("peer_key").agg(F.count("*").alias("members"))
    return found.select(level_of().alias("level"), "peer_key", "members")


def group_number(peer_key: Column, seed: int) -> Column:
    return F.xxhash64(peer_key, F.lit(seed))


def tagged(number: Column, tag: str) -> Column:
    """The number of a group's table of one kind."""
    return F.xxhash64(number, F.lit(tag))


def number_groups(keys: DataFrame, tags: list[str]) -> int:
    """A seed with which all groups of keys(peer_key), each with all tags, have different numbers; numbers are shorter to shuffle than keys."""
    for seed in range(100):
        each = keys.select(F.explode(F.array(*[tagged(group_number(F.col("peer_key"), seed), t) for t in tags])).alias("number"))
        if not each.groupBy("number").count().filter("count > 1").head(1):
            return seed
    raise ValueError("keys repeat")


#: Up to so many supported groups are broadcast.
BROADCAST_GROUPS = 200_000


def first_match(rows: DataFrame, levels: tuple[Level, ...], table: DataFrame, ident: str, condition: Callable[[Callable[[str], Column]], Column] | None = None, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """The stored rows of keyed() with best: level, peer_key and table's other columns at the first level whose group is in table(peer_key, ...) and meets the condition, else null.

    condition takes a look-up of table's columns by name, and may name the columns of rows.  Groups
    are counted: up to limit of them are broadcast and looked up in place, so rows are not
    shuffled; beyond that the rows are shuffled once by key and twice by ident, which must not repeat.
    """
    table = stored(table, "groups")
    rest = [c for c in table.columns if c not in ("level", "peer_key")]
    kept = [c for c in rows.columns if c not in key_columns(levels)]
    if table.count() <= limit:
        found, met = rows, []
        for i, (x, k) in enumerate(zip(levels, key_columns(levels), strict=True)):
            mine = table.filter(level_of() == x.name).select(F.col("peer_key").alias(k), F.struct(*rest).alias(f"at_{i}"))
            found = found.join(F.broadcast(mine), k, "left")
            at = F.col(f"at_{i}")
            ok = at.isNotNull() & (F.lit(True) if condition is None else condition(lambda n, at=at: at[n]))
            met.append(F.when(ok, F.struct(F.lit(x.name).alias("level"), F.col(k).alias("peer_key"), *[at[n].alias(n) for n in rest])))
        return found.select(*kept, F.coalesce(*met).alias("best"))
    every = with_keys(rows, levels, kept).filter("peer_key IS NOT NULL").join(table, "peer_key")
    every = every if condition is None else every.filter(condition(F.col))
    best = every.groupBy(ident).agg(F.min_by(F.struct(level_of().alias("level"), "peer_key", *rest), "ordinal").alias("best"))
    return rows.select(*kept).join(best, ident, "left")


def first_place(rows: DataFrame, levels: tuple[Level, ...], table: DataFrame, ident: str, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """The stored rows of keyed() with place: the number, from 1, of the first level whose group is in table(peer_key, ...), 0 without one.

    As first_match(), but the keys stay and up to limit groups cost no shuffle and no copy of the rows, so they may be read twice.
    """
    table = stored(table.select("peer_key"), "groups")
    if table.count() > limit:
        every = with_keys(rows, levels, [ident]).filter("peer_key IS NOT NULL").join(table, "peer_key")
        return stored(rows.join(every.groupBy(ident).agg((F.min("ordinal") + 1).cast("bigint").alias("place")), ident, "left").fillna(0, ["place"]), "placed")
    found = rows
    for i, (x, k) in enumerate(zip(levels, key_columns(levels), strict=True)):
        found = found.join(F.broadcast(table.filter(level_of() == x.name).select(F.col("peer_key").alias(k), F.lit(True).alias(f"at_{i}"))), k, "left")
    return found.select(*rows.columns, F.array_position(F.array(*[F.coalesce(f"at_{i}", F.lit(False)) for i in range(len(levels))]), True).alias("place"))


def first_sufficient(rows: DataFrame, levels: tuple[Level, ...], support: DataFrame, ident: list[str], limit: int = BROADCAST_GROUPS) -> DataFrame:
    """ident, level, peer_key and support's other columns: the first level of each row whose group is in support(peer_key, ...); rows without such a level are absent.

    rows hold ident, whose first column does not repeat, and either the columns that keys are made of or the keys.
    """
    rows = rows.select(*ident, *key_columns(levels)) if set(key_columns(levels)) <= set(rows.columns) else stored(keyed(rows, levels, ident), "keyed")
    return first_match(rows, levels, support, ident[0], limit=limit).filter("best IS NOT NULL").select(*ident, "best.*")


def indexed(targets: DataFrame, reference: DataFrame, ident: str, same: dict[str, Column]) -> DataFrame:
    """targets with indexed: whether the reference holds the row's ident.

    same: what a held row must have in common with the reference's; a target that differs
    fails the job, since its own share could not be taken out.  The reference has one row
    for each ident.
    """
    mark = F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in same.values()])
    held = reference.select(ident, mark.alias("held_mark"))
    rows = targets.withColumn("own_mark", mark).join(held, ident, "left")
    differs = F.raise_error(F.concat(F.lit("differs from the reference: "), F.col(ident))).cast("boolean")
    flag = F.when(F.col("held_mark").isNull(), False).when(F.col("held_mark") == F.col("own_mark"), True).otherwise(differs)
    return rows.withColumn("indexed", flag).drop("held_mark", "own_mark")


def keys_of(levels: tuple[Level, ...]) -> dict[str, Column]:
    """Each level's key by its name."""
    return {x.name: key(x) for x in levels}
