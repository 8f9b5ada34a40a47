import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tendersift.llm import collocations as cl

from .oracle import rows_of

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, least=10, longest=3, share=50, top=2000):
    f, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        redundant = {q for p, n in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * n >= share * found[q := p[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in redundant:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, words[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(ranked)[:top])]
    return sorted(map(str, out))


def rows():
    rnd = random.Random(2)
    words = ["New", "york", "city", "of", "the", "the", "a", "é", "É", "日本", "a b", "x\x00y", "🙂", "-", "a-b"]
    out = [(i, "".join(rnd.choice(words[: 4 + i % 12]) + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b"]) for _ in range(rnd.randrange(60))), rnd.choice(["en", "en", "fr", None, ""])) for i in range(250)]
    return out + [(None, None, "en"), (1, "", None), (2, " \t ., \n", "zz"), out[9], out[9], (3, "go on " * 20_000, "hot"), (4, "word" * 50_000, "hot")]


def test_equals_brute_force(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("Salt", F.lit(1)).withColumn("phrase", F.lit("clash")).repartition(5)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = lambda *x: sorted(str(tuple(r)) for r in cl.mined(df, *x).select(*names).collect())
    assert got() == brute(rows())
    monkeypatch.setattr(cl, "SHARD", 300)
    monkeypatch.setattr(cl, "RANGE", 9_000)
    assert got() == brute(rows())
    assert got(3, 4, 70, 5) == brute(rows(), 3, 4, 70, 5)


def test_more_candidates_do_not_change_counts(spark):
    """More candidates than need be, as counters that many phrases share let through, don't change the counts."""
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    shards = cl.sharded(df, 3, 1).cache()
    few = cl.matches(shards, cl.frequent(shards, 10), 3).count()
    every = cl.matches(shards, cl.frequent(shards, 1), 3)
    assert every.count() > few
    counts = lambda x: {(r.lang, r.phrase): r.n for r in x.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter("n >= 10").collect()}
    assert counts(every) == counts(cl.matches(shards, cl.frequent(shards, 10), 3))


def test_counters_are_sent_once_and_answered_by_bits(spark, monkeypatch):
    """Counters are not stored beside the texts, an answer is a bit a counter, and the shards of a unit and all units send sums."""
    monkeypatch.setattr(cl, "SHARD", 300)
    shards = cl.sharded(spark.createDataFrame(rows(), SCHEMA).repartition(3), 3, 4).cache()
    assert not {"asked", "cells"} & set(shards.columns)
    assert shards.count() > 3 * shards.select("unit").distinct().count()
    hot = cl.frequent(shards, 10).cache()
    sent = cl.asked(shards).join(hot, ["unit", "shard", "range"]).collect()
    assert len(sent) == hot.count() > 0
    assert all(len(r.hot) == (len(cl._unpack(r.cells)[0]) + 7) // 8 for r in sent)
    assert not cl.matches(shards, hot, 3).groupBy("lang", "phrase").count().filter("count > 1").head(1)


def test_counters_survive_packing():
    import numpy as np

    cells = np.array([0, 5, 5 + (1 << 33), (1 << 40) - 1], np.uint64)
    a, n = cl._unpack(cl._pack(cells, np.array([1, 2, 3, 4])))
    assert a.tolist() == cells.tolist() and n.tolist() == [1, 2, 3, 4]
    assert cl._unpack(cl._pack(cells))[0].tolist() == cells.tolist() and len(cl._unpack(cl._pack(cells[:0]))[0]) == 0


def test_scores_pass_64_bits(spark):
    a, left, r = 3 * 10**12, 4 * 10**12, 5 * 10**12
    df = spark.createDataFrame([("en", "p q", a), ("en", "p", left), ("en", "q", r)], "lang string, phrase string, a bigint")
    assert [(x.score, x.l, x.r) for x in cl.scored(df).collect()] == [(10**6 * a * a // (left * r), left, r)]


def test_sql_and_empty_table(spark):
    left, right = rows_of(spark, cl.query, cl.ORACLE_SQL, "/root/testdata/sf0.001")
    assert left == right and len(left) > 100
    assert cl.mined(spark.createDataFrame([], SCHEMA)).count() == 0
