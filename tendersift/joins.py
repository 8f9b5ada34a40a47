"""Joins whose hot keys are dealt over tasks, broadcasts behind a count, and populations that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of at most so many cells is broadcast; a larger one is joined by a shuffle.
BROADCAST_CELLS = 50_000


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not use yet (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def attached(rows: DataFrame, few: DataFrame, key: str | list[str], by: str, cells: Column | None = None, limit: int = BROADCAST_CELLS) -> DataFrame:
    """rows left join few on key, where the stored table few has one row for each key.

    few is broadcast if its cells (rows, or the sum of the column cells) are counted to be
    at most limit; beyond that both sides are shuffled by spread_join().
    """
    n = few.agg(F.coalesce(F.sum(F.lit(1) if cells is None else cells), F.lit(0)).alias("n")).first().n
    return rows.join(F.broadcast(few), key, "left") if n <= limit else spread_join(rows, few, key, by)


def spread_join(rows: DataFrame, few: DataFrame, key: str | list[str], by: str, salts: int = 16) -> DataFrame:
    """rows left join few on key, where few has one row for each key and rows may hold one key very often.

    Each row of few is sent to every salt and each row of rows to the salt of its column
    by, so the rows of one key are dealt over that many tasks at least; adaptive execution
    splits what is still large, as it may on the left of a left join.
    """
    salt = free_name(rows, "salt")
    copies = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [key] if isinstance(key, str) else key
    return rows.withColumn(salt, F.pmod(F.xxhash64(F.col(by)), F.lit(salts)).cast("int")).join(copies, [*on, salt], "left").drop(salt)


def population(df: DataFrame, ident: list[str]) -> tuple[int, int, int]:
    """The number of rows and two sums of hashes of their identities, the same for the same rows in any order; one pass without a shuffle of rows."""
    text = [F.col(c).cast("string") for c in ident]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *text).cast("decimal(38,0)")), F.lit(0))
    row = df.agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    return row.n, int(row.a), int(row.b)


def same_population(tables: dict[str, DataFrame], ident: list[str]) -> None:
    """ValueError if the tables hold different rows, or one holds an identity twice."""
    found = {name: population(df, ident) for name, df in tables.items()}
    if len(set(found.values())) > 1:
        raise ValueError(f"different rows: {', '.join(f'{n} has {p[0]}' for n, p in found.items())}")
    first = next(iter(tables.values()))
    if first.groupBy(*ident).count().filter("count > 1").head(1):
        raise ValueError(f"an identity ({', '.join(ident)}) stands twice")
