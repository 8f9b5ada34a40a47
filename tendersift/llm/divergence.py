"""Divergence of sources within a language by systolic rotation.

The kept terms of a language are dealt into slices.  A group (language, source) has one
vector a slice: the ids of its terms and their counts, compressed.  Each vector stays in its
partition; in the rounds of a tournament (the circle method, every pair meets once) the
peers' vectors come to it, and each meeting yields both directions.  A term's distance to
the whole language is ranked where the slice is packed, in a heap for each group.

No task holds more than a slice of the vectors it compares: about SLICE counts when it packs,
two vectors and ROUNDS visitors when they meet.  Documents are counted where they lie, so a
hot source or term is a few sums a task.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tendersift.llm.common import attached, read_table, stored

SCALE = 1_000_000_000
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Counts (term, group) of a slice on average, and rounds of the tournament that one job plays.
SLICE, ROUNDS = 200_000, 5
#: A task's counts are passed on when it holds so many.
FLUSH = 500_000
#: Texts of more code points are read match by match.
LONG = 1 << 20


def _terms(text: str) -> Iterator[list[str]]:
    """The terms of a text in order, in lists; a long text gives several."""
    low = text.encode().lower().decode()  # of bytes, lower() turns A-Z alone
    if len(low) < LONG:
        yield TERM.findall(low)
        return
    found = (m[0] for m in TERM.finditer(low))
    while some := list(islice(found, LONG)):
        yield some


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs (documents with the term): partial sums; each group has a row of the empty term with n = 0."""
    rows = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = ["", *n]
                yield pa.record_batch([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*[batch.column(x).to_pylist() for x in ("lang", "source", "text")], strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, here = len(n), set()
                for terms in _terms(text):
                    n.update(terms)
                    here.update(terms)
                docs.update(here)
                size += len(n) - before
                if size > FLUSH:
                    yield from out()
                    size = 0
        yield from out()

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(partials: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, lang_n (of all sources) and first (one row of each term): the terms of at least `least` documents of a language, and each group's empty term."""
    c, term = F.col, W.partitionBy("lang", "term")
    sums = partials.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = sums.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return rows.filter((c("lang_docs") >= least) | (c("term") == "")).select("lang", "source", "term", "n", "lang_n", "first")


def probabilities(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    if counts.size and int(counts.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(n) + 1) // total for n in counts], np.int64)
    return 1 + SCALE * (counts + 1) // max(total, 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def _pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data) if data else b""
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<i8", n, 4 * n).astype(np.int64)


def packed(rows: DataFrame, top: int) -> DataFrame:
    """lang, slice, source, vector, terms (of the slice) and best: the vector of each group in each slice and its `top` terms by distance to the language.

    rows: lang, slice, source, term, n, lang_n, total and lang_total (sums of counts and the number of terms).
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        names, terms = np.unique(pdf["term"].to_numpy(object), return_inverse=True)
        q = probabilities(pdf["lang_n"].to_numpy(np.int64), int(pdf["lang_total"].iloc[0]))
        counts, out = pdf["n"].to_numpy(np.int64), []
        for source, at in pdf.groupby("source").indices.items():
            at = at[np.argsort(terms[at])]
            p, lang_p = probabilities(counts[at], int(pdf["total"].iloc[at[0]])), q[at]
            over = np.flatnonzero((p > lang_p) & (counts[at] > 0))
            f = distance(p[over], lang_p[over])
            ranked = heapq.nsmallest(top, zip((-f).tolist(), (names[t].encode() for t in terms[at[over]]), strict=True))
            out.append((pdf["lang"].iloc[0], int(pdf["slice"].iloc[0]), source, _pack(terms[at], counts[at]), len(names), [{"item": t.decode(), "value": -v} for v, t in ranked]))
        return pd.DataFrame(out, columns=["lang", "slice", "source", "vector", "terms", "best"])

    return rows.groupBy("lang", "slice").applyInPandas(pack, "lang string, slice int, source string, vector binary, terms bigint, best array<struct<item: string, value: bigint>>")


def opponent(seat: Column, round_: Column, seats: Column) -> Column:
    """Whom a seat meets in a round (from 0) of the circle method with an even number of seats: all others, one a round."""
    ring = seats - 1
    facing = F.pmod(round_ - seat, ring)
    return F.when(seat == ring, F.pmod(round_ * (seats / 2).cast("int"), ring)).when(facing == seat, ring).otherwise(facing).cast("int")


def _meetings(residents: DataFrame, rounds: range) -> DataFrame:
    """lang, source, peer, value of one slice: what the pairs that meet in the rounds are apart, in both directions.

    Of two seats the lesser one is the host if their sum is even, else the greater; the other's vector comes to it.
    """
    c = F.col
    even = (c("groups") + c("groups") % 2).cast("int")
    asked = residents.withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds]))).filter(c("round") < even - 1)
    asked = asked.withColumn("host", opponent(c("seat"), c("round"), even)).filter(c("host") < c("groups"))
    comes = F.when((c("seat") + c("host")) % 2 == 0, c("host") < c("seat")).otherwise(c("host") > c("seat"))
    visitors = asked.filter(comes).select(c("lang").alias("at_lang"), c("slice").alias("at_slice"), c("host").alias("at_seat"), c("source").alias("peer"), c("vector").alias("theirs"), c("total").alias("their_total"))

    def meet(stays: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(stays):
            me = stays.iloc[0]
            ids, counts = _unpack(me["vector"])
            for peer, vector, total in zip(come["peer"], come["theirs"], come["their_total"], strict=True):
                other, theirs = _unpack(vector)
                both = np.union1d(ids, other)
                a, b = np.zeros(len(both) + 1, np.int64), np.zeros(len(both) + 1, np.int64)  # the last is a term of neither
                a[np.searchsorted(both, ids)], b[np.searchsorted(both, other)] = counts, theirs
                p, q = probabilities(a, int(me["total"])), probabilities(b, int(total))
                times = np.ones(len(both) + 1, np.int64)
                times[-1] = int(me["terms"]) - len(both)
                out.append((me["lang"], me["source"], peer, int((distance(p, q) * times).sum())))
                out.append((me["lang"], peer, me["source"], int((distance(q, p) * times).sum())))
        return pd.DataFrame(out, columns=["lang", "source", "peer", "value"])

    seat = ["lang", "slice", "seat"]
    return residents.select(*seat, "source", "vector", "total", "terms").groupBy(*seat).cogroup(visitors.groupBy(*[f"at_{x}" for x in seat])).applyInPandas(meet, "lang string, source string, peer string, value bigint")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank of the sources of docs(lang, source, text), null read as ''.

    Part pair: item is each other source of the language, value how far the group's terms are
    from it; part term: the `top` terms that the group has more of than its language.  Equal values are
    ranked by item.  A group without terms, and a language without any, has its pairs too; a
    language of one source has none.  Repeated rows count again, an empty table gives an
    empty one, other columns don't matter.
    """
    c = F.col
    rows = stored(kept_terms(stored(counted(docs), "counted"), least), "kept-terms")
    real = rows.filter("term <> ''")
    sizes = real.groupBy("lang").agg(F.count_if("first").alias("terms"), F.count("*").alias("counts"), F.sum(F.when(c("first"), c("lang_n"))).alias("all_n"))
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    whole = W.partitionBy("lang")
    groups = groups.withColumns({"seat": F.row_number().over(whole.orderBy("source")) - 1, "groups": F.count("*").over(whole).cast("int")})
    groups = groups.join(sizes, "lang", "left").fillna({"terms": 0, "counts": 0, "all_n": 0})
    groups = stored(groups.select("lang", "source", "seat", "groups", F.greatest(F.ceil(c("counts") / SLICE), F.lit(1)).cast("int").alias("slices"), (c("group_n") + c("terms")).alias("total"), (c("all_n") + c("terms")).alias("lang_total")), "groups")
    known = attached(real.drop("first"), groups, ["lang", "source"], "term")
    packs = stored(packed(known.withColumn("slice", F.pmod(F.xxhash64("term"), c("slices")).cast("int")), top), "vectors")

    of_slice = packs.groupBy("lang", "slice").agg(F.max("terms").alias("terms"))
    grid = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), c("slices") - 1))).join(of_slice, ["lang", "slice"], "left").join(packs.select("lang", "slice", "source", "vector"), ["lang", "slice", "source"], "left")
    grid = grid.select("lang", "slice", "seat", "source", "groups", "total", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("vector", F.lit(b"")).alias("vector"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    residents = grid.repartition(tasks, "lang", "slice", "seat").persist(StorageLevel.DISK_ONLY)
    seats = groups.agg(F.coalesce(F.max("groups"), F.lit(0)).alias("n")).first().n
    last = seats + seats % 2 - 1  # rounds
    played = [stored(_meetings(residents, range(r, min(r + ROUNDS, last))), "meetings") for r in range(0, last, ROUNDS)]
    residents.unpersist()

    ranked = lambda df: F.row_number().over(W.partitionBy("lang", "source").orderBy(c("value").desc(), "item")).cast("int")
    terms = packs.select("lang", "source", F.inline("best")).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    terms = terms.withColumn("rank", ranked(terms)).filter(c("rank") <= top)
    if not played:
        return terms
    sums = reduce(DataFrame.unionAll, played).groupBy("lang", "source", c("peer").alias("item")).agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", ranked(pairs)).unionByName(terms)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + s.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (s.n + s.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)
    LEFT JOIN totals t ON (t.lang, t.source) = (g.lang, g.source)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON (x.lang, x.source, x.item) = (a.lang, a.source, b.source)
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
