"""N-gram Jaccard join by MinHash banding.

Texts are compared as sets of word n-grams (a text of fewer words is one n-gram; a
text without words links to nothing).  Two texts link if their sets' Jaccard
similarity is at least the threshold.

1. One pass hashes each text's word sequence to a 128-bit key and its n-grams to
   MinHash bands.  Rows of one key are copies; only one member of each key goes on.
2. Keys are shuffled on (band, band hash).  Buckets with the same members are one.
3. The n-gram sets of the keys left are sent to their buckets and compared in full.
   A bucket of many keys is cut into blocks by a hash, and each pair of blocks is one
   group, so a group's size is bounded; a pair is counted in the first band it shares.
   A group returns per key the links it found and a root, never its pairs.
4. Roots are joined to components by iterated minimum labels.

The number of bands is chosen from the recall wanted at the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import BROADCAST_CELLS, free_name, read_table, spread_join, stored, whole_text
from tendersift.llm.wordhash import Tokens, flat, mix, tokens, windows

NGRAM = 5
THRESHOLD = 0.8
#: Chance that a pair exactly at the threshold shares a band.
RECALL = 0.9999
ROWS = 4
#: A block holds about so many texts and n-grams at most.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 1_000_000

_SEED = 0x5EED


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of that many rows that reach the recall at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _grams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all rows of t, and where each row's start, with their number at last."""
    at = t.per_row()
    words = np.diff(at)
    counts = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    wide = windows(t.hash, n)
    full = np.flatnonzero(words >= n)
    if len(full):
        size = counts[full]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(starts[full], size) + place] = wide[np.repeat(at[full], size) + place]
    for i in np.flatnonzero((words > 0) & (words < n)):
        out[starts[i]] = windows(t.hash[at[i] : at[i + 1]], int(words[i]))[0]
    return out, starts


def _keys(t: Tokens, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bytes for each row, equal for equal word sequences; a text without words has a key of its bytes."""
    at = t.per_row()
    words = np.diff(at)
    out = np.zeros((len(words), 2), np.uint64)
    full = words > 0
    if len(t.hash):
        place = (np.arange(len(t.hash)) - np.repeat(at[:-1], words)).astype(np.uint64)
        for k, salt in enumerate((0x1234567, 0x89ABCDE)):
            worth = mix(t.hash ^ mix(place + np.uint64(salt)))
            out[full, k] = mix(np.add.reduceat(worth, at[:-1][full]) + words[full].astype(np.uint64))
    for i in np.flatnonzero(~full):
        text = raw[offsets[t.first + i] : offsets[t.first + i + 1]].tobytes()
        out[i] = np.frombuffer(hashlib.md5(text).digest(), np.uint64)
    return out


def _signature(ngram: int, rows: int, bands: int):
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 2**63, rows * bands, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, rows * bands, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, marks = [], [], []
            whole = flat(batch.column("text"))
            for t in tokens(batch.column("text")):
                grams, starts = _grams(t, ngram)
                size = np.diff(starts)
                full, out = size > 0, np.zeros((t.rows, bands), np.uint64)
                if len(grams):
                    for k in range(rows * bands):
                        low = np.minimum.reduceat(grams * a[k] + b[k], starts[:-1][full])
                        out[full, k // rows] = mix(out[full, k // rows] ^ low) + np.uint64(k)
                keys.append(_keys(t, *whole))
                sizes.append(size)
                marks.append(out)
            if not keys:
                continue
            marks = np.concatenate(marks).view(np.int64)
            key = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary()),
                    pa.array(np.concatenate(sizes)),
                    pa.ListArray.from_arrays(np.arange(0, marks.size + 1, bands, dtype=np.int32), marks.ravel()),
                ],
                ["doc_id", "key", "size", "bands"],
            )

    return run


def with_keys(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with the binary key of each text's word sequence in the column name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = flat(batch.column(text))
            keys = [_keys(t, *whole) for t in tokens(batch.column(text).cast(pa.string()))]
            key = np.concatenate(keys) if keys else np.empty((0, 2), np.uint64)
            column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` binary")


def _gram_sets(ngram: int):
    """Each text's sorted distinct n-gram hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for t in tokens(batch.column("text")):
                grams, starts = _grams(t, ngram)
                sets += [np.unique(grams[i:j]).tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), batch.column("bands"), batch.column("at"), pa.array(sets, pa.binary())], ["key", "copies", "bands", "at", "grams"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each two sets, by products of 0/1 matrices over shared elements."""
    n = len(sets)
    if n == 2:
        a, b = sorted(sets, key=len)
        x = np.zeros((2, 2), np.int64)
        if len(a):
            i = np.minimum(np.searchsorted(b, a), len(b) - 1)
            x[0, 1] = x[1, 0] = int((b[i] == a).sum())
        return x
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((n, n), np.float32), 4096
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _compare(threshold: float):
    """Groups stand in consecutive rows of a partition; each is compared once its last row is there."""

    def compared(band: int, lo: int, hi: int, rows: list[tuple]) -> Iterator[tuple]:
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) < 2:
            return
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        marks = np.array([r[2] for r in rows])
        size = np.array([len(s) for s in sets])
        common = _overlaps(sets)
        hit = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        first = np.ones_like(hit)
        for k in range(band):
            first &= marks[:, None, k] != marks[None, :, k]
        if lo != hi:  # a pair inside one block belongs to the group of that block alone
            block = np.array([r[4] for r in rows])
            first &= block[:, None] != block[None, :]
        hit &= first
        np.fill_diagonal(hit, False)
        linked = np.flatnonzero(hit.any(1))
        if not len(linked):
            return
        order = sorted(range(len(rows)), key=lambda i: rows[i][0])
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        label = rank.copy()
        while True:
            low = np.where(hit, label[None, :], len(rows)).min(1)
            new = np.minimum(label, low)
            if (new == label).all():
                break
            label = new
        links = hit @ np.array([r[1] for r in rows])
        for i in linked:
            yield rows[i][0], int(links[i]), rows[order[label[i]]][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, found = None, [], []

        def out() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["key", "links", "root"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("band", "hash", "lo", "hi", "key", "copies", "bands", "grams", "block")), strict=True):
                if r[:4] != at:
                    if rows:
                        found += compared(at[0], at[2], at[3], rows)
                    at, rows = r[:4], []
                rows.append(r[4:])
            if len(found) > 10_000:
                yield out()
                found = []
        if rows:
            found += compared(at[0], at[2], at[3], rows)
        yield out()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(key, label) for the vertices of edges(key, root): label is the least key of the component.

    Each round takes the least label among the neighbours and then the label's own
    label, so paths shorten by halves; a round ends in a stored table.
    """
    both = stored(edges.union(edges.select("root", "key")).toDF("key", "root").distinct(), "edges")
    labels = stored(both.groupBy("key").agg(F.least(F.col("key"), F.min("root")).alias("label")), "labels")
    while True:
        near = spread_join(both, labels.select(F.col("key").alias("root"), "label"), "root", "key").groupBy("key").agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = stored(spread_join(step, jump, "label", "key").select("key", "old", F.least("label", "further").alias("label")), "labels")
        if not new.filter("old != label").head(1):
            return new.select("key", "label")
        labels = new.select("key", "label")


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, key, class_id, copy_id, n_links and first_key for each row of docs(doc_id, text).

    class_id: the least doc_id of all texts that are connected by links; copy_id: the
    least doc_id with the same word sequence; n_links: the other rows that this row
    links to, copies included.  first_key: the key of the class's first text.

    A null text is an empty one.  Rows without words have n_links 0 and are their own
    class.  Null doc_ids don't count for the least ids, so class_id is null only if all
    of a class are null.  Repeated rows are copies of each other.  An empty table gives
    an empty result; other columns are ignored.
    """
    bands = bands_for(threshold, rows, recall)
    docs = docs.select("doc_id", whole_text().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sig = stored(docs.mapInArrow(_signature(ngram, rows, bands), f"doc_id {id_type}, key binary, size bigint, bands array<bigint>"), "signatures")
    texts = sig.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = stored(texts, "texts")

    member = texts.select("key", "size", F.posexplode("bands").alias("band", "hash"))
    mark = lambda salt: F.bit_xor(F.xxhash64("key", F.lit(salt)))
    buckets = member.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("grams"), mark(1).alias("m1"), mark(2).alias("m2")).filter("n > 1")
    buckets = buckets.groupBy("n", "grams", "m1", "m2").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.*", F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("grams") / BLOCK_GRAMS)).alias("blocks"))
    places = member.join(buckets, ["band", "hash"]).groupBy("key").agg(F.collect_list(F.struct("band", "hash", "blocks")).alias("at"))
    wanted = texts.join(places, "key").select(_row_key(F.col("key"), F.col("copy_id")).alias("row_key"), "copies", "bands", "at")

    keyed = with_keys(docs, "key").withColumn("row_key", _row_key(F.col("key"), F.col("doc_id"))).join(wanted, "row_key").dropDuplicates(["row_key"])  # one shuffle: repeated rows meet where they are joined
    at_type = "array<struct<band:int,hash:bigint,blocks:bigint>>"
    sets = keyed.select("key", "copies", "bands", "at", "text").mapInArrow(_gram_sets(ngram), f"key binary, copies bigint, bands array<bigint>, at {at_type}, grams binary")
    dealt = sets.select("key", "copies", "bands", "grams", F.inline("at")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("band", "hash", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "copies", "bands", "grams", "block")
    group = ["band", "hash", "lo", "hi"]
    found = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold), "key binary, links bigint, root binary")
    found = stored(found, "links")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.filter("key != root").select("key", "root").distinct()
    labels = components(edges)
    rows = stored(texts.select("key", "copy_id", "copies").join(links, "key", "left").join(labels, "key", "left"), "members")
    counted = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    linked = rows.filter("label IS NOT NULL")
    first = linked.groupBy("label").agg(F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "key")).alias("f"))
    linked = spread_join(linked, first, "label", "key").select("key", "copy_id", F.col("f.copy_id").alias("class_id"), F.col("f.key").alias("first_key"), counted)  # a component may be large
    alone = rows.filter("label IS NULL").select("key", "copy_id", F.col("copy_id").alias("class_id"), F.col("key").alias("first_key"), counted)
    classes = linked.union(alone)
    out = sig.select("doc_id", "key", "size").join(classes, "key", "left")
    lone = F.col("size") == 0
    return out.select("doc_id", "key", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.when(lone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"), "first_key")


def _row_key(key: Column, doc_id: Column) -> Column:
    """What only repeated rows share: the text's key with the doc_id; a null id differs from every string."""
    return F.concat(key, F.when(doc_id.isNull(), F.lit(b"0")).otherwise(F.concat(F.lit(b"1"), doc_id.cast("string").cast("binary"))))


def deduplicated(docs: DataFrame, limit: int = BROADCAST_CELLS, **how) -> DataFrame:
    """docs with one row of each class: the row of the least doc_id.

    Of repeated rows one stays.  Rows without words all stay, but for repeated ones.
    Columns and their names stay as they are; an empty table stays empty.

    The rows to drop or thin out are counted: up to limit of them are broadcast, and
    the texts stay where they are; beyond that the texts are shuffled once by row.
    """
    key, change = free_name(docs, "row_key"), free_name(docs, "row_change")
    near = near_duplicates(docs.select("doc_id", "text"), **how)
    first = F.col("first_key").isNull() | (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    each = near.select(_row_key(F.col("key"), F.col("doc_id")).alias(key), first.alias("stays")).groupBy(key).agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    each = stored(each.select(key, F.when(~F.col("stays"), "drop").when(F.col("n") > 1, "thin").alias(change)), "row-changes")
    keyed, names = with_keys(docs, key).withColumn(key, _row_key(F.col(key), F.col("doc_id"))), [F.col(f"`{c}`") for c in docs.columns]
    changed = each.filter(F.col(change).isNotNull())
    if changed.count() > limit:
        return keyed.join(each.filter(F.coalesce(change, F.lit("")) != "drop").select(key), key, "left_semi").dropDuplicates([key]).select(*names)
    if not changed.filter(F.col(change) == "thin").head(1):
        return keyed.join(F.broadcast(changed.select(key)), key, "left_anti").select(*names)
    marked = keyed.join(F.broadcast(changed), key, "left")
    return marked.filter(F.col(change).isNull()).union(marked.filter(F.col(change) == "thin").dropDuplicates([key])).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", "class_id", "copy_id", "n_links")
