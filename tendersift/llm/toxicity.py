"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, homoglyphs, invisible characters and digit or sign
substitutions.  The lexicon holds whole words and word beginnings with weights that are
learned from labelled texts; phrases in which a lexicon word is harmless cancel the
hits inside them.  The sum of the hits is normalised by the square root of the length.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import free_name, read_table, stored, whole_text
from tendersift.llm.quality import acceptance_cut

#: At most so many labelled texts are used, those with the smallest hash.
LABELS = 20_000
#: The least number of toxic texts that an entry of the lexicon must add.
LEAST = 3
#: Log of the ratio of shares from which a word speaks for toxicity.
LEAST_WEIGHT = 1.6
#: Different entries that a toxic text should hold.
WANTED = 6
#: Lengths of the word beginnings that are tried.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Words and weights used without labels.
PLAIN = {" idiot": 3.0, " moron": 3.0, " stupid": 2.0, " scum": 3.0, " trash ": 1.5, " worthless": 2.0, " pathetic": 2.0, " disgusting": 2.0, " loser": 2.0}

# Letters that look like Latin ones, and signs written for letters.
_LOOKS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Fold(dict):
    """Code point to its folded letter, to nothing if invisible, to a space if not a letter; filled as met."""

    def __missing__(self, point: int) -> str:
        low = chr(point).lower()
        if 0xFF41 <= ord(low[0]) <= 0xFF5A:
            low = chr(ord(low[0]) - 0xFF41 + 0x61)
        self[point] = out = "" if low in _INVISIBLE else _LOOKS.get(low, low if low.isalpha() else " ")
        return out


_FOLD = _Fold()
_SIGN = re.compile(r"[013457@$]+")


def _letters(m: re.Match) -> str:
    """A run of signs inside a word, or of digits at its edge, as letters."""
    text, lo, hi = m.string, m.start(), m.end()
    after = hi < len(text) and text[hi].isalpha()
    before = lo > 0 and text[lo - 1].isalpha()
    if after or before and m[0].isdigit():
        return "".join(map(_SIGNS.get, m[0]))
    return " "


def folded(text: str) -> str:
    """The folded words of a text, each with a space before it, and a space at the end."""
    return f" {' '.join(_SIGN.sub(_letters, text).translate(_FOLD).split())} "


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    cut: float = 0.1

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            a.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase.strip()} ", (len(phrase.strip()) + 2, None))
        if len(a):
            a.make_automaton()
        return a


def hits(automaton: ahocorasick.Automaton, text: str) -> dict[int, float]:
    """Where the hit words of a folded text start, with the greatest weight of an entry; without those inside an exception."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if not len(automaton):
        return found
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    spared.sort()
    i, reach = 0, -1
    for at in sorted(found) if spared else ():
        while i < len(spared) and spared[i][0] <= at:
            reach = max(reach, spared[i][1])
            i += 1
        if at < reach:
            del found[at]
    return found


def strength(found: dict[int, float], text: str) -> float:
    return sum(found.values()) / np.sqrt(text.count(" ") + 10.0) if found else 0.0


def _features(text: str) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) >= k}


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][x] for x in names], pa.int64()), pa.array([counts[1][x] for x in names], pa.int64())], ["feature", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_features(folded(text)))
        if len(counts[0]) + len(counts[1]) > 200_000:
            yield out()
            counts = Counter(), Counter()
    yield out()


def _chosen(shared):
    """The numbers of the candidates in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            rows = [[number[f] for f in _features(folded(t)) if f in number] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "features"])

    return run


def _phrases(shared):
    """Each hit word with its neighbour before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            rows, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text, mine = folded(text), set()
                for at in hits(automaton, text):
                    before, here, after = text[:at].rpartition(" ")[2], *(text[at + 1 :].split(" ", 2) + ["", ""])[:2]
                    mine |= {f"{before} {here}"} if before else set()
                    mine |= {f"{here} {after}"} if after else set()
                rows += mine
                toxic += [label] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(toxic, pa.int32())], ["phrase", "toxic"])

    return run


def _strengths(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            texts = [folded(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([strength(hits(automaton, t), t) for t in texts], pa.float64())], ["toxic", "strength"])

    return run


def _cover(names: list[str], weights: np.ndarray, rows: list[tuple[int, list[int]]]) -> list[int]:
    """Candidates, the most useful first, until each toxic text holds WANTED or no more than LEAST texts gain one.

    Of a word's beginnings and the word itself only the first chosen is taken, so a text is covered by different words.
    """
    toxic = [f for label, f in rows if label]
    holders: dict[int, list[int]] = {}
    for i, features in enumerate(toxic):
        for f in features:
            holders.setdefault(f, []).append(i)
    need, chosen, taken, beginnings = [WANTED] * len(toxic), [], set(), set()
    gains = {f: len(h) for f, h in holders.items()}
    order = lambda f: (-gains[f] * weights[f], -len(names[f]), f)
    queue = [order(f) for f in holders]
    heapq.heapify(queue)
    while queue:  # gains only fall, so the first whose order still holds is the best
        top = heapq.heappop(queue)
        f = top[2]
        related = names[f] in beginnings or any(names[f][:k] in taken for k in range(1, len(names[f]) + 1))
        if gains[f] < LEAST or related:
            continue
        if (now := order(f)) != top:
            heapq.heappush(queue, now)
            continue
        chosen.append(f)
        taken.add(names[f])
        beginnings |= {names[f][:k] for k in range(1, len(names[f]) + 1)}
        for i in holders[f]:
            if need[i]:
                need[i] -= 1
                if not need[i]:
                    for g in toxic[i]:
                        gains[g] -= 1
    return chosen


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from at most limit labelled texts, one for each distinct text.

    labels: doc_id and toxic (0 or 1).  A weight is the log of the ratio of the shares of
    toxic and clean texts that hold the entry.  Without labels of both kinds the plain list is used.
    """
    spark = docs.sparkSession
    some = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    marked = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(some), "doc_id").select(F.xxhash64("text").alias("h"), "text", "toxic")  # at most limit ids
    marked = stored(marked, "labelled")
    chosen = stored(marked.groupBy("h").agg(F.max("toxic").alias("is")).orderBy("h").limit(limit), "label-hashes")  # hashes alone are ordered
    train = marked.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("is").alias("toxic"))
    train = stored(train.select("text", "toxic").repartition(spark.sparkContext.defaultParallelism), "train")
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = Lexicon(dict(PLAIN), list(exceptions))
    if sizes.get(0) and sizes.get(1):
        counts = train.mapInArrow(_feature_counts, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        weight = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0))
        best = counts.withColumn("weight", weight).filter((F.col("toxic") >= LEAST) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc(F.col("toxic") * F.col("weight")), "feature").collect()  # bounded by the label sample
        names, weights = [r.feature for r in best], np.array([r.weight for r in best])
        shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
        rows = [(r.toxic, r.features) for r in train.mapInArrow(_chosen(shared), "toxic int, features array<int>").filter("toxic = 1").collect()]
        lexicon.weights = {names[i]: float(weights[i]) for i in _cover(names, weights, rows)}
        found = train.mapInArrow(_phrases(spark.sparkContext.broadcast(lexicon)), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
        lexicon.exceptions += [r.phrase for r in found.filter((F.col("toxic") == 0) & (F.col("n") >= LEAST)).orderBy(F.desc("n"), "phrase").collect()]
        pairs = [(r.strength, r.toxic) for r in train.mapInArrow(_strengths(spark.sparkContext.broadcast(lexicon)), "toxic int, strength double").collect()]
        cut = acceptance_cut(pairs)
        lexicon.cut = cut if np.isfinite(cut) and cut > 0 else lexicon.cut
    return lexicon


def with_scores(docs: DataFrame, lexicon: Lexicon, score: str = "score", words: str = "toxic_words") -> DataFrame:
    """docs with a score from 0 to 1 (0.5 at the lexicon's cut; 0 without hits, so for null or empty texts too) and the number of hit words; columns of these names are replaced."""
    text = free_name(docs, "folded_text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    out = docs.withColumns({text: whole_text(), score: F.lit(0.0), words: F.lit(0).cast("bigint")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cut = shared.value.automaton(), shared.value.cut
        for batch in batches:
            scores, counts = [], []
            for t in batch.column(text).to_pylist():
                t = folded(t)
                found = hits(automaton, t)
                x = strength(found, t)
                scores.append(x / (x + cut))
                counts.append(len(found))
            put = {score: pa.array(scores, pa.float64()), words: pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([put.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(run, fields).drop(text)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and toxic_words for each row of docs.

    Labels of rows with crc32(doc_id as text) mod 5 = 0 are never read.  A null doc_id is
    not held out and has no label.  Repeated rows get equal scores.
    """
    lexicon = learn(docs.filter(~held_out()), labels.filter(~held_out()))
    out = with_scores(docs.select("doc_id", "text", held_out().alias("held_out")), lexicon)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_words")


def query(spark, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
