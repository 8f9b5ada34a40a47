import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tendersift.llm import divergence as dv

from .oracle import rows_of

SCHEMA = "doc_id bigint, text string, lang string, source string"


def brute(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        every = Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})

        def p(count, total, v=len(kept)):
            return 1 + 10**9 * (count + 1) // (total + v)

        of = {s: {t: p(counts[lang, s][t], sum(counts[lang, s][x] for x in kept)) for t in kept} for s in sources}
        whole = {t: p(every[t], sum(every.values())) for t in kept}
        for s in sources:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((of[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(map(str, out))


def rows():
    rnd = random.Random(4)
    words = ["One", "one", "two", "three", "vier", "été", "ÉTÉ", "x9y", "A_b", "日本", "🙂"] + [f"w{chr(97 + i)}" for i in range(26)]
    out = [(i, " ".join(rnd.choice(words[: 5 + 6 * (i % 6)]) for _ in range(rnd.randrange(30))), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", "é", None])) for i in range(150)]
    return out + [(None, None, "en", "only-null"), (1, "", "fr", "alone"), (2, "rare", "it", "s1"), (3, "words", "it", "s2"), out[7], out[7], (4, "long " * 30_000 + "Tail", "en", "hot")]


def test_equals_brute_force(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("Seat", F.lit(1)).withColumn("term", F.lit("clash")).repartition(5)
    want = brute(rows())
    for limits in ({}, {"SLICE": 7, "ROUNDS": 2, "FLUSH": 3, "LONG": 50}):
        for name, value in limits.items():
            monkeypatch.setattr(dv, name, value)
        assert sorted(str(tuple(r)) for r in dv.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()) == want
    assert sorted(str(tuple(r)) for r in dv.audit(df, 2, 3).select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows(), 2, 3)


def test_every_pair_meets_once(spark):
    for n in (2, 4, 6, 14):
        df = spark.range(n).selectExpr("cast(id as int) AS seat").crossJoin(spark.range(n - 1).selectExpr("cast(id as int) AS round"))
        met = [(r.seat, r.other, r.round) for r in df.select("seat", "round", dv.opponent(F.col("seat"), F.col("round"), F.lit(n)).alias("other")).collect()]
        assert {(a, b) for a, b, _ in met} == {(a, b) for a in range(n) for b in range(n) if a != b} and len(met) == n * (n - 1)
        assert {(b, a, r) for a, b, r in met} == set(met)


def test_large_counts_stay_exact():
    import numpy as np

    n = np.array([0, 10**10, 9 * 10**15], np.int64)
    assert dv.probabilities(n, 10**16).tolist() == [1 + 10**9 * (int(x) + 1) // 10**16 for x in n]


def test_sql_and_empty_table(spark):
    left, right = rows_of(spark, dv.query, dv.ORACLE_SQL, "/root/testdata/sf0.001")
    assert left == right
    assert dv.audit(spark.createDataFrame([], SCHEMA)).count() == 0
