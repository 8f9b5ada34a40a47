"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one of the target (labelled
good texts) and one of the raw corpus (every text).  The log of the ratio of a text's
likelihoods is its importance weight; adding Gumbel noise and taking the k largest
samples k texts without replacement in proportion to the weights.  k is a parameter; by
default it is the number of texts whose weight exceeds the cut that best separates the
labelled texts, an estimate of how many texts are like the target.  The cut sets only
how many are sampled, and is no part of the key.

Tokens are runs of word characters and runs of punctuation, A-Z folded; a token equal
to one of the two before it becomes a repeat mark.  The n-grams are the tokens and the
pairs of neighbours.  Labels are read from a sample of at most LABELS rows, the ones
with the smallest hash of doc_id; the raw model counts all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import free_name, read_table, stored, whole_text
from tendersift.llm.wordhash import TOKEN_CLASS, Tokens, mix, tokens

#: Buckets of the n-gram models.
BUCKETS = 1 << 14
#: At most so many labelled rows are used.
LABELS = 20_000
#: Added to each bucket's target count, in raw-model shares of so many n-grams.
PRIOR = 2_000.0
SEED = 20

_REPEAT = np.uint64(0xA5A5A5A5A5A5A5A5)


def _buckets(t: Tokens, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the row (from 0) of each n-gram."""
    h = t.hash.copy()
    for back in (1, 2):
        same = (t.hash[back:] == t.hash[:-back]) & (t.row[back:] == t.row[:-back])
        h[back:][same] = _REPEAT
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    inside = t.row[1:] == t.row[:-1]
    grams = np.concatenate([mix(h), pair[inside]])
    row = np.concatenate([t.row, t.row[1:][inside]]) - t.first
    return (grams % np.uint64(buckets)).astype(np.int64), row


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for t in tokens(batch.column("text"), TOKEN_CLASS):
                gram, row = _buckets(t, buckets)
                raw += np.bincount(gram, minlength=buckets)
                target += np.bincount(gram[good[t.first + row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


def _score(shared, text: str, weight: str, grams: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            sums, counts = [], []
            for t in tokens(batch.column(text), TOKEN_CLASS):
                gram, row = _buckets(t, len(ratio))
                sums.append(np.bincount(row, ratio[gram], t.rows).astype(float))  # integers if there is no n-gram
                counts.append(np.bincount(row, minlength=t.rows))
            put = {weight: pa.array(np.concatenate(sums) if sums else np.empty(0)), grams: pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64))}
            yield pa.RecordBatch.from_arrays([put.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return run


def label_sample(labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """At most limit rows (doc_id, quality), one for each labelled doc_id; 1 if any of its labels is 1."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratio(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target share / raw share) of each bucket; all 0 without good labels."""
    good = F.broadcast(sample.filter("quality = 1").select("doc_id", F.lit(True).alias("good")))  # at most LABELS rows
    marked = docs.select("doc_id", whole_text().alias("text")).join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_count(buckets), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # at most one row for each bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(buckets)
    share = (raw + 1) / (raw.sum() + buckets)
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR) / share)


def scored(docs: DataFrame, ratio: np.ndarray, weight: str, grams: str) -> DataFrame:
    """docs with each text's log importance weight and its number of n-grams; columns of these names are replaced."""
    text = free_name(docs, "score_text")
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    out = docs.withColumns({text: whole_text(), weight: F.lit(0.0), grams: F.lit(0).cast("bigint")})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(_score(shared, text, weight, grams), fields).drop(text)


def gumbel(*of: str, seed: int = SEED) -> Column:
    """Gumbel noise that is a function of the columns, the same on every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in of]), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, name: str, k: int, few: int = 10_000, bins: int = 1024) -> float:
    """The k-th largest value of a stored column, by counts in ever narrower bins."""
    if k <= 0:
        return float("inf")
    lo, hi = values.agg(F.min(name), F.max(name)).first()
    if lo is None:
        return float("inf")
    rest = values.select(name)
    while True:
        n = rest.count()
        if k >= n:
            return lo
        if n <= few:
            return rest.orderBy(F.desc(name)).limit(k).agg(F.min(name)).first()[0]
        if lo == hi:
            return lo
        number = F.least(F.floor((F.col(name) - lo) / (hi - lo) * bins), F.lit(bins - 1))
        for r in rest.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy(F.desc("bin")).collect():  # at most bins rows
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
        rest = rest.filter(F.col(name).between(lo, hi))


def acceptance_cut(pairs: list[tuple[float, int]]) -> float:
    """The cut on a score with the best mean of the two classes' hit rates; -inf if one class is absent."""
    good = np.sort([s for s, q in pairs if q == 1])
    bad = np.sort([s for s, q in pairs if q != 1])
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([at[:1] - 1, (at[:-1] + at[1:]) / 2])
    rate = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(rate >= rate.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def _key(weight: str, noise: str, exponent: float) -> Column:
    """Gumbel top-k over these keys samples in proportion to the importance weight raised to exponent."""
    return F.col(weight) * float(exponent) + F.col(noise)


def _plan(docs: DataFrame, labels: DataFrame, k: int | None, buckets: int, exponent: float):
    sample = stored(label_sample(labels), "label-sample")
    ratio = log_ratio(docs, sample, buckets)
    table = scored(docs.select("doc_id", "text"), ratio, "log_weight", "n_grams").withColumn("noise", gumbel("doc_id", "text")).drop("text")
    table = stored(table.withColumn("sample_key", _key("log_weight", "noise", exponent)), "weights")
    if k is None:
        marked = table.join(F.broadcast(sample), "doc_id").select("log_weight", "quality", F.xxhash64("doc_id", "noise").alias("h"))
        pairs = marked.orderBy("h").limit(LABELS).select("log_weight", "quality").collect()
        k = table.filter(F.col("log_weight") > acceptance_cut([tuple(r) for r in pairs])).count()
    return ratio, table, kth_largest(table, "sample_key", k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, exponent: float = 1.0) -> DataFrame:
    """doc_id, log_weight, n_grams, sample_key and kept for each row of docs.

    log_weight is the log of the likelihood ratio, sample_key that times exponent plus
    Gumbel noise.  k: the number of rows to sample; for None see above.  Rows with the
    k-th largest key are all kept, so repeated rows share their fate.

    A null text is an empty one; it has weight 0 and only noise.  Null or unknown
    doc_ids have no label.  Without labels of both kinds no row is rejected by default.
    """
    _, table, least = _plan(docs, labels, k, buckets, exponent)
    return table.select("doc_id", "log_weight", "n_grams", "sample_key", (F.col("sample_key") >= F.lit(least)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, exponent: float = 1.0) -> DataFrame:
    """The rows of docs that resample() keeps; columns and names stay as they are, clashing ones included."""
    ratio, _, least = _plan(docs, labels, k, buckets, exponent)
    weight, grams = free_name(docs, "log_weight"), free_name(docs, "n_grams")
    whole = scored(docs, ratio, weight, grams).withColumn((noise := free_name(docs, "gumbel_noise")), gumbel("doc_id", "text"))
    return whole.filter(_key(weight, noise, exponent) >= F.lit(least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
