import re
import time
import zlib

from tendersift.llm import toxicity as tx


def test_folding():
    assert tx.folded("The 1d10t and tr4sh, idiot$$$ l0ser! p@thetic іdіоt 2047​") == " the idiot and trash idiot loser pathetic idiot "
    assert tx.folded("") == "  "


def test_hits_against_plain_search():
    lexicon = tx.Lexicon({" bad ": 2.0, " awf": 1.0, " badly ": 3.0}, ["not bad", "bad luck"])
    text = tx.folded("bad, awful badly not bad; bad luck awf bad awfully")
    words = text.split()
    want, at = {}, 0
    for i, w in enumerate(words):
        weight = 2.0 if w == "bad" else 3.0 if w == "badly" else 1.0 if w.startswith("awf") else 0
        if weight and not (w == "bad" and (i and words[i - 1] == "not" or words[i + 1 : i + 2] == ["luck"])):
            want[at] = weight
        at += len(w) + 1
    assert tx.hits(lexicon.automaton(), text) == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = tx.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    recall = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right > 0.97 and recall > 0.9, (right, recall)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "you idiot", 4), (2, "", 5), (2, "", 5), (3, "x" * 300_000 + " idiot moron", 6)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {(r.doc_id, r.toxic_words) for r in tx.scored(docs, labels).collect()}
    assert got == {(1, 0), (None, 1), (2, 0), (3, 2)}
    assert tx.with_scores(docs, tx.Lexicon({}), "s").filter("s = 0").count() == 5
    assert tx.scored(docs.limit(0), labels).count() == 0
    replaced = tx.with_scores(docs, tx.Lexicon({" idiot": 1.0}))
    assert replaced.columns == ["doc_id", "text", "score", "toxic_words"] and replaced.filter("score > 0").count() == 2


def test_exceptions_in_a_long_text():
    """Hits and exceptions in one sweep: a text full of both takes time in proportion, and only hits inside exceptions go."""
    automaton = tx.Lexicon({" trash ": 1.0, " idiot": 2.0}, ["trash can", "no idiot at"]).automaton()
    text = tx.folded("the trash can is idiot trash; no idiot at all " * 40_000)
    began = time.time()
    found = tx.hits(automaton, text)
    assert time.time() - began < 20 and len(found) == 80_000
    some = text[: len(text) // 40_000 * 3 + 1]
    near = tx.hits(automaton, some)
    inside = [(m.start(), m.end()) for phrase in (" trash can ", " no idiot at ") for m in re.finditer(f"(?={phrase})", some) for m in [re.compile(phrase).match(some, m.start())]]
    all_ = [m.start() for m in re.finditer(" trash(?= )| idiot", some)]
    assert sorted(near) == [x for x in all_ if not any(lo <= x < hi for lo, hi in inside)] and len(near) == 6


def test_rare_toxic_words_are_learned(spark):
    """More candidates than 2,000: each of 900 words stands in three toxic texts only."""
    letters = "bcdfghjklm"
    word = lambda i: "".join(letters[int(d)] for d in f"{i:03}") + "aquoz"
    toxic = [f"{word(i)} t{'abc'[k]}{word(i)[:3]}" for i in range(900) for k in range(3)]
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(5000 + i, f"plain {'abcdefgh'[i % 8]}{word(i % 900)[:3]}x", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = tx.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    automaton = lexicon.automaton()
    assert all(tx.hits(automaton, tx.folded(t)) for t in toxic)
