import functools
import math
import re
from collections import Counter

import numpy as np
import pytest

from tendersift.llm import quality

SF = "/root/testdata/sf0.01"


M, PRIME = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def brute_weights(docs, good, buckets):
    """Log weights of (doc_id, text), token by token."""

    @functools.cache
    def word_hash(word):
        return mix(sum((b + 1) * pow(PRIME, i, 1 << 64) for i, b in enumerate(word.encode())) & M)

    def grams(text):
        word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
        plain = re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = [0xA5A5A5A5A5A5A5A5 if x in plain[max(0, i - 2) : i] else word_hash(x) for i, x in enumerate(plain)]
        return [mix(x) % buckets for x in h] + [mix(x * PRIME + y & M) % buckets for x, y in zip(h, h[1:], strict=False)]

    each = [grams(text) for _, text in docs]
    raw, target = Counter(), Counter()
    for (d, _), g in zip(docs, each, strict=True):
        raw.update(g)
        if d in good:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    share = lambda x: (raw[x] + 1) / (n + buckets)
    ratio = {x: math.log((target[x] + quality.PRIOR * share(x)) / (m + quality.PRIOR) / share(x)) for x in raw}
    return [sum(ratio[x] for x in g) for g in each]


def test_weights_and_top_k_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows, good = docs.collect(), {r.doc_id for r in labels.filter("quality = 1").collect()}
    want = dict(zip([r.doc_id for r in rows], brute_weights(rows, good, quality.BUCKETS), strict=True))
    got = quality.resample(docs, labels, k=300, exponent=0.5).collect()
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel("doc_id", "text").alias("g")).collect()}
    for r in got:
        assert r.log_weight == pytest.approx(want[r.doc_id], abs=1e-6), r
        assert r.sample_key == pytest.approx(r.log_weight * 0.5 + noise[r.doc_id])
    best = sorted(got, key=lambda r: -r.sample_key)[:300]
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in best} and len(best) == 300


def test_the_sample_is_none_of_a_threshold(spark):
    """Among the heaviest half of the texts, flattened weights let noise decide."""
    args = (spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = quality.resample(*args, k=400, exponent=0.02).collect()
    least = sorted(r.log_weight for r in got)[-400]
    assert 0.1 < sum(r.kept != (r.log_weight >= least) for r in got) / len(got) < 0.5


def test_separates_labelled_texts(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05, (np.mean(good), np.mean(bad))


def test_kth_largest_equals_sorting(spark):
    rnd = np.random.default_rng(0)
    x = np.round(rnd.normal(size=3000), 2).tolist()
    df = spark.createDataFrame([(v,) for v in x], "v double").cache()
    order = sorted(x, reverse=True)
    for k in (1, 2, 500, 2999, 3000):
        assert quality.kth_largest(df, "v", k, few=50, bins=16) == order[k - 1]
    assert quality.kth_largest(df, "v", 0) == float("inf")
    assert quality.kth_largest(df, "v", 5000) == min(x)
    same = spark.createDataFrame([(1.0,)] * 300, "v double")
    assert quality.kth_largest(same, "v", 100, few=50) == 1.0


def test_sampling_follows_the_weights(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("g", quality.gumbel("doc_id"))
    heavy = df.withColumn("key", df.g + (df.doc_id < 10_000).cast("double") * float(np.log(3)))
    top = heavy.orderBy(heavy.key.desc()).limit(1000)
    share = top.filter("doc_id < 10000").count() / 1000
    assert abs(share - 0.75) < 0.04


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good plain words here", 5), (2, None, 1), (None, "", 2), (3, "!! !! !! ##", 3), (3, "!! !! !! ##", 3), (4, "word " * 60_000, 4)], "doc_id bigint, text string, log_weight int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 0), (9, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.resample(docs, labels).count() == 6
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in quality.resample(docs, labels, k=2).filter("kept").collect()} == {r.doc_id for r in quality.accepted(docs, labels, k=2).collect()}
    assert quality.accepted(docs, labels.limit(0)).count() == 6
    assert quality.accepted(docs.limit(0), labels).count() == 0
