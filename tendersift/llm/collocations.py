"""Mining of phrase collocations: sketch, candidates, automata, counts, thresholds.

Documents are packed into shards of one language, each a canonical text in which every word
stands between single spaces and every delimiter is a word "\\n" of its own.  The sketch is a
count-min row of 2^BITS counters, held sparsely: each shard sends its counters, in ranges,
to the task that sums a range, and gets back a bit for each of them that tells whether it
reaches the threshold.  A sum is never less than a phrase's count, so the phrases of a shard
whose counter reaches it are all that can matter there.  They compile into the shard's
automaton, whose keys are guarded by the spaces around them; one scan counts all
matches, overlapping ones too.  The counts of a few shards of a language are added up where
they are made, packed by ranges of counters, and added up by range.

Only texts are stored; a shard's counters are made again where they are needed, since they
take more room than its text.  Nothing is broadcast or sent to the driver but the number of
characters, and what a task holds is a few shards or one range, whatever the size of the
corpus or the number of phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, pairwise
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tendersift.llm.common import free_name, read_table, stored

#: Counters of the sketch: 2^BITS.  Phrases that share one may become needless candidates, and counters of fewer bits are shorter to send.
BITS = 34
#: Characters of a shard, and of the texts whose counters one range holds on average; larger ones send fewer messages and take more memory.
SHARD, RANGE = 4 << 20, 8 << 20
#: Shards whose counts are added up before they are sent, and ranges whose counts are added up in one group.
UNIT, PART = 8, 4
_STOP = re.compile(r"[.,;:!?\x0A-\x0D]+")
#: How hard texts are compressed.
TEXT_LEVEL = 6
#: Slots of the table that tells most counters apart from those that came back.
_SLOTS = 1 << 22


def canonical_words(text: str) -> list[str]:
    """The words of a text in order, A-Z lower-cased, and "\\n" for each run of delimiters."""
    low = text.encode().lower().decode()  # of bytes, lower() turns A-Z alone
    return [w for w in _STOP.sub(" \n ", low).replace("\t", " ").split(" ") if w]


def _numbered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, and the distinct words in the order of their numbers."""
    return pd.factorize(np.array([*words, None], object)[:-1])


def _cells(lang: str, ids: np.ndarray, names: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places where a phrase starts that lies within a piece, and its counter in the sketch."""
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    marks = np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in names), np.uint64, len(names))[ids]
    word = np.array([w != "\n" for w in names], bool)[ids]
    at = np.flatnonzero(word)
    mixed = np.zeros(len(at), np.uint64)
    for length in range(1, longest + 1):
        inside = at + length - 1 < len(ids)
        at, mixed = at[inside], mixed[inside]
        inside = word[at + length - 1]
        at, mixed = at[inside], mixed[inside]
        mixed = (mixed ^ marks[at + length - 1]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        yield at, ((mixed + np.uint64(length)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def _squeezed(data: bytes, level: int = 1) -> bytes:
    """Compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", level).compress(data, asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _planes(numbers: np.ndarray, width: int) -> bytes:
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _of_planes(raw: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.int64)


def _pack(cells: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted counters as differences in planes of bytes; with their counts."""
    gaps = _planes(np.diff(cells.astype(np.int64), prepend=0), (BITS + 7) // 8)
    return _squeezed(len(cells).to_bytes(8, "little") + gaps + (b"" if counts is None else _planes(counts, 4)))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw, width = _restored(data), (BITS + 7) // 8
    n = int.from_bytes(raw[:8], "little")
    counted = len(raw) > 8 + n * width
    return np.cumsum(_of_planes(raw, n, width, 8)), _of_planes(raw, n, 4, 8 + n * width) if counted else np.zeros(0, np.int64)


def sharded(docs: DataFrame, longest: int, ranges: int) -> DataFrame:
    """shard, unit (up to UNIT shards of a task and language), lang, words (their number), text (compressed), and longest and ranges, by which its counters are made: the documents of each task, by language."""
    text, lang = (F.coalesce(F.col(n).cast("string"), F.lit(d)) for n, d in (("text", ""), ("lang", "und")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        units: dict[str, tuple[int, int]] = {}
        made = TaskContext.get().partitionId() << 32

        def out(lang: str) -> pd.DataFrame:
            nonlocal made
            words = held.pop(lang)
            size.pop(lang)
            made += 1
            unit, full = units.get(lang, (made, 0))
            unit, full = (unit, full) if full < UNIT else (made, 0)
            units[lang] = unit, full + 1
            total = sum(w != "\n" for w in words)
            return pd.DataFrame({"shard": [made], "unit": [unit], "lang": [lang], "words": [total], "text": [_squeezed(f" {' '.join(words)} ".encode(), TEXT_LEVEL)]})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = canonical_words(text)
                held.setdefault(lang, []).extend([*words, "\n"])
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= SHARD:
                    yield out(lang)
                elif sum(size.values()) >= 2 * SHARD:
                    yield out(max(size, key=size.get))
        for lang in list(held):
            yield out(lang)

    rows = docs.select(lang.alias("lang"), text.alias("text")).mapInPandas(run, "shard bigint, unit bigint, lang string, words bigint, text binary")
    return rows.withColumns({"longest": F.lit(longest), "ranges": F.lit(ranges)})


def _ranged(cell: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """The ranges that hold any of the sorted counters, each with its first place and the one after its last."""
    of = ((cell * np.uint64(ranges)) >> np.uint64(BITS)).astype(np.int64)
    edges = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[a]), int(a), int(b)) for a, b in pairwise([*edges, len(cell)])]


def asked(shards: DataFrame) -> DataFrame:
    """unit, shard, range and cells: the counters of each shard with their counts, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                unit, shard, lang, packed, longest, ranges = (batch.column(k)[i].as_py() for k in range(6))
                ids, names = _numbered(_restored(packed).decode()[1:-1].split(" "))
                cell, n = np.unique(np.concatenate([x for _, x in _cells(lang, ids, names, longest)]), return_counts=True)
                rows = [(r, _pack(cell[a:b], n[a:b])) for r, a, b in _ranged(cell, ranges)]
                columns = [[unit] * len(rows), [shard] * len(rows), [r for r, _ in rows], [x for _, x in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["unit", "shard", "range", "cells"])

    return shards.select("unit", "shard", "lang", "text", "longest", "ranges").mapInArrow(run, "unit bigint, shard bigint, range int, cells binary")


def frequent(shards: DataFrame, least: int) -> DataFrame:
    """unit, shard, range and hot: a bit for each counter that the shard sent to the range, whether its sum over all shards is at least `least`; ranges without any are absent."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [_unpack(x) for x in pdf["cells"]]
        every = np.concatenate([c for c, _ in sent])
        cells, inverse = np.unique(every, return_inverse=True)
        hot = (np.bincount(inverse, np.concatenate([n for _, n in sent]), len(cells)) >= least)[inverse]
        out, lo = [], 0
        for unit, shard, at, (mine, _) in zip(pdf["unit"], pdf["shard"], pdf["range"], sent, strict=True):
            back = hot[lo : lo + len(mine)]
            lo += len(mine)
            if back.any():
                out.append((unit, shard, at, np.packbits(back).tobytes()))
        return pd.DataFrame(out, columns=["unit", "shard", "range", "hot"])

    return asked(shards).groupBy("range").applyInPandas(add, "unit bigint, shard bigint, range int, hot binary")


def _hot(cell: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the counters are among the sorted wanted ones."""
    slots = np.zeros(_SLOTS, bool)
    slots[(wanted % np.uint64(_SLOTS)).astype(np.int64)] = True
    maybe = np.flatnonzero(slots[(cell % np.uint64(_SLOTS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(wanted, cell[maybe]), len(wanted) - 1)
    out = np.zeros(len(cell), bool)
    out[maybe] = wanted[place] == cell[maybe]
    return out


def _candidates(cells: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, names: np.ndarray, wanted: np.ndarray) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """The single words whose counter is wanted with their counts, the longer phrases, and the counters of both."""
    single, n, phrases, counters = [], np.zeros(0, np.int64), [], []
    for length, (at, cell) in enumerate(cells, 1):
        hot = _hot(cell, wanted)
        at, cell = at[hot], cell[hot]
        if length == 1:
            found, first, n = np.unique(ids[at], return_index=True, return_counts=True)
            single = names[found].tolist()
        else:
            code = ids[at]
            for k in range(1, length):  # numbers of phrases stay below the number of places
                code = np.unique(code, return_inverse=True)[1] * len(names) + ids[at + k]
            _, first = np.unique(code, return_index=True)
            phrases += [" ".join(row) for row in names[ids[at[first][:, None] + np.arange(length)]].tolist()]
        counters.append(cell[first])
    return single, n, phrases, np.concatenate(counters)


def _counted(text: str, phrases: list[str]) -> np.ndarray:
    """How often each phrase stands in a canonical text, by the automaton of all of them."""
    n = np.zeros(len(phrases), np.int64)
    if phrases:
        automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            automaton.add_word(f" {phrase} ", i)
        automaton.make_automaton()
        found = map(itemgetter(1), automaton.iter(text))
        while len(some := np.fromiter(islice(found, 1 << 20), np.int64)):
            n += np.bincount(some, minlength=len(phrases))
    return n


def _added(phrases: list[pa.Array], part: list[np.ndarray], n: list[np.ndarray]) -> pa.Table:
    """part, phrase and n_sum of arrays of phrases, parts and counts."""
    table = pa.table({"part": np.concatenate(part), "phrase": pa.chunked_array(phrases, pa.string()), "n": np.concatenate(n)})
    return table.group_by(["part", "phrase"]).aggregate([("n", "sum")])


def matches(shards: DataFrame, hot: DataFrame, longest: int) -> DataFrame:
    """lang, phrase and n: how often each candidate stands in the shards where it is one: single words by counting them, phrases by each shard's automaton."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        back: dict[int, dict[int, bytes]] = {}
        for shard, at, bits in zip(*(right[x].to_pylist() for x in ("shard", "range", "hot")), strict=True):
            back.setdefault(shard, {})[at] = bits
        phrases, part, n = [], [], []
        for shard, lang, packed, ranges in zip(*(left[x] for x in ("shard", "lang", "text", "ranges")), strict=True):
            shard, lang, ranges = shard.as_py(), lang.as_py(), ranges.as_py()
            if shard not in back:
                continue
            text = _restored(packed.as_py()).decode()
            ids, names = _numbered(text[1:-1].split(" "))
            cells = list(_cells(lang, ids, names, longest))
            every = np.unique(np.concatenate([x for _, x in cells]))
            flags = np.zeros(len(every), bool)
            for at, a, b in _ranged(every, ranges):
                if at in back[shard]:
                    flags[a:b] = np.unpackbits(np.frombuffer(back[shard][at], np.uint8), count=b - a)
            single, times, longer, counters = _candidates(cells, ids, names, every[flags])
            phrases.append(pa.array(single + longer, pa.string()))
            part.append(((counters * np.uint64(max(1, ranges // PART))) >> np.uint64(BITS)).astype(np.int64))
            n.append(np.concatenate([times, _counted(text, longer)]))
        if not phrases:
            return kinds.empty_table()
        table = _added(phrases, part, n).sort_by("part")
        part, n = table["part"].to_numpy(), table["n_sum"].to_numpy()
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
        rows = [{"lang": lang, "part": part[a], "phrases": _squeezed("\n".join(table["phrase"][a:b].to_pylist()).encode()), "n": _squeezed(_planes(n[a:b], 8))} for a, b in pairwise(edges)]
        return pa.Table.from_pylist(rows, kinds)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        phrases = [pa.array(_restored(x.as_py()).decode().split("\n"), pa.string()) for x in table["phrases"]]
        n = [_of_planes(_restored(x.as_py()), len(p), 8, 0) for p, x in zip(phrases, table["n"], strict=True)]
        sums = _added(phrases, [np.zeros(len(x), np.int64) for x in n], n)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(sums), pa.string()), "phrase": sums["phrase"], "n": sums["n_sum"]}).combine_chunks()

    kinds = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("phrases", pa.binary()), ("n", pa.binary())])
    texts = shards.select("unit", "shard", "lang", "text", "ranges")
    packed = texts.groupBy("unit").cogroup(hot.groupBy("unit")).applyInArrow(count, "lang string, part bigint, phrases binary, n binary")
    return packed.groupBy("lang", "part").applyInArrow(add, "lang string, phrase string, n bigint")


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """The phrases of up to `longest` words that stand `least` times or more in a language: lang, phrase, a; and lang, n (all words)."""
    characters = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    shards = stored(sharded(docs, longest, max(1, characters // RANGE)), "shards")
    found = matches(shards, frequent(shards, least), longest)
    counts = found.filter(F.col("n") >= least).select("lang", "phrase", F.col("n").alias("a"))
    return stored(counts, "phrase-counts"), shards.groupBy("lang").agg(F.sum("words").alias("n"))


def _slices(words: Column, shortest: int, longest: int) -> Column:
    """All shorter runs of words with a length between the two, as phrases."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.when(F.size(words) > n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[runs(n) for n in range(shortest, longest + 1)]))


def scored(counts: DataFrame, longest: int = 3, share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r and score of the candidates (phrases of two words or more) of counts(lang, phrase, a) that no longer one makes redundant.

    Cut after its first k words, a candidate has l and r occurrences of its parts and the
    score floor(10^6 a^2 / (l r)), in decimals of 38 digits: exact up to a of 10^16.  The
    lowest-scoring cut counts, of equals the least k.  A candidate is dropped if a longer one,
    dropped or not, holds it and stands share % as often or more.
    """
    c = F.col
    words = F.split("phrase", " ")
    rows = counts.filter(F.size(words) > 1)
    if longest > 2:
        inside = rows.select("lang", F.explode(_slices(words, 2, longest - 1)).alias("phrase"), c("a").alias("longer"))
        most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        rows = rows.join(most, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < " + f"{share} * a")
    # What can be told from the phrase is not shuffled with it.
    cuts = rows.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    part = lambda side, name: counts.select("lang", c("phrase").alias(side), c("a").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"])
    cuts = cuts.select("lang", "phrase", "a", "k", "l", F.expr("substring(phrase, length(left) + 2)").alias("right")).join(part("right", "r"), ["lang", "right"])
    score = F.expr("CAST(1000000 * (CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def mined(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first `top` collocations of docs(lang, text).

    A null text is empty, a null language `und`; repeated rows count again; an empty table
    gives an empty one; other columns don't matter.  Ties go to the more frequent phrase,
    then by the bytes of the phrase.  The best of parts of a language are ranked before those
    of the whole, so no task orders all candidates of a language.
    """
    counts, totals = phrase_counts(docs, least, longest)
    rows = scored(counts, longest, share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = free_name(rows, "salt")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mined(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM worded
    UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM worded
    UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM worded),
f AS (SELECT lang, size, phrase, count(*) AS a FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
inner_ones AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM candidates WHERE size = 3),
redundant AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ones GROUP BY ALL),
cuts AS (
    SELECT c.*, unnest(range(1, size)) AS k FROM candidates c LEFT JOIN redundant r ON c.lang = r.lang AND c.phrase = r.phrase
    WHERE longer IS NULL OR 100 * longer < 50 * a),
parts AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, 1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS score FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
