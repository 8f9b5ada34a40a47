"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: each run of WINDOW words of an item,
or all words of a shorter item.  The search moves a window end over the words of a
document.  The block of words at the end indexes a shift table: a positive shift skips
positions at which no pattern can end; at shift 0 the block's suffix bucket selects
patterns, which are compared word by word and then as bytes.  Long documents are cut
into segments and all segments of a batch move on together in numpy.

Benchmark items are loaded in blocks of bounded size.  Each block is one search of the
documents; its tables are broadcast, and dropped before the next block's are built, so
neither the driver nor a task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import attached, free_name, read_table, stored, text_key, whole_text
from tendersift.llm.wordhash import FOLD, Tokens, flat, mix, tokens

WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 2
#: Bytes of benchmark text whose tables are broadcast at once.
ITEM_BYTES = 4 << 20
_SEGMENT = 256


class ShiftTables:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, patterns: np.ndarray, texts: list[bytes], owners: list[list[str]]):
        self.length = patterns.shape[1]
        self.block = min(BLOCK, self.length)
        self.bits = max(12, int(4 * len(patterns)).bit_length())
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.uint8)
        for end in range(self.block - 1, self.length):
            at = self.blocks(patterns[:, end - self.block + 1 : end + 1]) >> np.uint64(64 - self.bits)
            np.minimum.at(self.shift, at.astype(np.int64), self.length - 1 - end)
        suffix = self.blocks(patterns[:, -self.block :])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.patterns = suffix[order], patterns[order]
        self.texts, self.owners = [texts[i] for i in order], [owners[i] for i in order]

    @staticmethod
    def blocks(words: np.ndarray) -> np.ndarray:
        out = words[..., 0].copy()
        for k in range(1, words.shape[-1]):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[..., k]
        return mix(out)

    def search(self, t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words and pattern numbers of the occurrences in the words of t, whose rows start at at."""
        n, none = len(t.hash), np.empty(0, np.int64)
        if n < self.length:
            return none, none
        ends = self.blocks(np.lib.stride_tricks.sliding_window_view(t.hash, self.block))  # of the block that ends at its index + block - 1
        first, last = at[:-1] + self.length - 1, at[1:]
        pieces = np.maximum(0, -(-(last - first) // _SEGMENT))
        row = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = first[row] + nth * _SEGMENT
        stop = np.minimum(pos + _SEGMENT, last[row])
        found, which = [none], [none]
        while len(pos):
            block = ends[pos - self.block + 1]
            move = self.shift[(block >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
            stand = move == 0
            if stand.any():
                here, key = pos[stand], block[stand]
                lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
                while True:
                    live = lo < hi
                    if not live.any():
                        break
                    here, lo, hi = here[live], lo[live], hi[live]
                    same = np.ones(len(here), bool)
                    for k in range(self.length):
                        same[same] = t.hash[here[same] - self.length + 1 + k] == self.patterns[lo[same], k]
                    found.append(here[same])
                    which.append(lo[same])
                    lo = lo + 1
                move[stand] = 1
            pos = pos + move
            live = pos < stop
            pos, stop = pos[live], stop[live]
        return np.concatenate(found), np.concatenate(which)


def tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[ShiftTables]:
    """Tables for (item id, text), one for each pattern length."""
    by: dict[bytes, tuple[np.ndarray, dict[str, None]]] = {}
    column = pa.array([text for _, text in items], pa.string())
    raw = FOLD[flat(column)[0]].tobytes()
    for t in tokens(column):
        at = t.per_row()
        for r in range(t.rows):
            i, j = int(at[r]), int(at[r + 1])
            size = min(window, j - i)
            for k in range(i, j - size + 1) if size else ():
                text = b" ".join(raw[t.start[x] : t.end[x]] for x in range(k, k + size))
                by.setdefault(text, (t.hash[k : k + size], {}))[1].setdefault(items[t.first + r][0])
    lengths = sorted({len(h) for h, _ in by.values()})
    groups = [[(h, text, list(ids)) for text, (h, ids) in by.items() if len(h) == n] for n in lengths]
    return [ShiftTables(np.array([g[0] for g in group]), [g[1] for g in group], [g[2] for g in group]) for group in groups]


def _search(shared, text: str, words: str, spans: str, ids: str):
    """Adds what the shared tables find to the word ranges in spans and the item ids in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            raw = flat(column)[0]
            old_spans, old_ids = batch.column(spans).to_pylist(), batch.column(ids).to_pylist()
            counts: list[np.ndarray] = []
            for t in tokens(column):
                at = t.per_row()
                counts.append(np.diff(at))
                for table in shared.value:
                    for end, which in zip(*(x.tolist() for x in table.search(t, at)), strict=True):
                        start = end - table.length + 1
                        here = b" ".join(FOLD[raw[t.start[x] : t.end[x]]].tobytes() for x in range(start, end + 1))
                        if here == table.texts[which]:
                            row = int(t.row[end])
                            base = int(at[row - t.first])
                            old_spans[row] += [start - base, end + 1 - base]
                            old_ids[row] = sorted({*old_ids[row], *table.owners[which]})
            put = {words: pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64)), spans: pa.array([_merged(s) for s in old_spans], pa.list_(pa.int64())), ids: pa.array(old_ids, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([put.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return run


def _merged(flat_spans: list[int]) -> list[int]:
    """Start, end, start, end ... of the union of the ranges, ascending."""
    out: list[int] = []
    for start, end in sorted(zip(flat_spans[::2], flat_spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, words: str, spans: str, ids: str, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs with three more columns: the number of words, the hit word ranges (start, end, start, end ..., end exclusive) and the sorted ids of the items that occur.

    A null text has no words.  A null item id counts as the empty id; items without
    words never occur; items of one id count once.  Without items nothing is hit.
    """
    text, key = free_name(docs, "search_text"), free_name(docs, "search_key")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), whole_text().alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // item_bytes))
    none = {words: F.lit(0).cast("bigint"), spans: F.array().cast("array<bigint>"), ids: F.array().cast("array<string>")}

    def searched(rows: DataFrame, i: int):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).distinct()
        shared = docs.sparkSession.sparkContext.broadcast(tables([tuple(r) for r in part.collect()], window))  # about item_bytes of text
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(_search(shared, text, words, spans, ids), fields), shared

    earlier = None
    for i in range(blocks - 1):  # equal texts have equal hits, and few texts have any
        found, shared = searched(docs.select(text_key().alias(key), whole_text().alias(text)).withColumns(none), i)
        found = stored(found.filter(F.size(ids) > 0).select(key, F.col(spans).alias("s"), F.col(ids).alias("i")).dropDuplicates([key]), "block-hits")
        shared.destroy()
        earlier = found if earlier is None else earlier.union(found)
    if earlier is not None:
        earlier = stored(earlier.groupBy(key).agg(F.flatten(F.collect_list("s")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("i")), "hits")  # a text's hits of at most as many blocks
        rows = attached(docs.withColumn(key, text_key()), earlier.select(key, F.struct("s", "i").alias(hits := free_name(docs, "search_hits"))), key, "doc_id", F.size(f"{hits}.s") + F.size(f"{hits}.i"))
        none |= {spans: F.coalesce(F.col(hits)["s"], none[spans]), ids: F.coalesce(F.col(hits)["i"], none[ids])}
        out = rows.withColumns({text: whole_text(), **none}).drop(key, hits)
    else:
        out = docs.withColumns({text: whole_text(), **none})
    return searched(out, blocks - 1)[0].drop(text)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, hit_ranges and contaminated for each row of docs."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, "n_words", "hit_ranges", "items", window)
    ranges = F.transform(F.col("hit_ranges"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.withColumn("n_hit", hit).select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "hit_ranges", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window occurs; columns and names stay as they are."""
    words, spans, ids = (free_name(docs, x) for x in ("hit_words", "hit_spans", "hit_ids"))
    found = with_hits(docs, benchmark, words, spans, ids, window)
    return found.filter(F.size(F.col(ids)) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), v AS (
  SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d
), u AS (
  SELECT r, k, list(x) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM v
), p AS (
  SELECT DISTINCT id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)
), s AS (
  SELECT r, n, k, array_to_string(l[1:n], ' ') AS t FROM u, (SELECT DISTINCT n FROM p) WHERE len(l) >= n
), h AS (
  SELECT s.r, s.n, s.k, p.id FROM s JOIN p ON s.n = p.n AND s.t = p.t
), c AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM h) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
