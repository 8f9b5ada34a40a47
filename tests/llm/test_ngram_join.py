import random
import re

import pytest
from tendersift.llm import ngram_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grams(text, n=5):
    w = WORD.findall(fold(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    """n_links and the component's least id of each row by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    n, parent = len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    inverted = {}
    for i, s in enumerate(sets):
        for g in s:
            inverted.setdefault(g, []).append(i)
    for i in range(n):
        seen = {}
        for g in sets[i]:
            for j in inverted[g]:
                seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if j != i and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, least.get(top(i)), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()), key=str)


def made_rows():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = [rnd.choice(words) for _ in range(120)]
        for _ in range(rnd.choice([1, 4, 30])):
            t = list(text)
            for _ in range(rnd.randrange(0, 5)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(900, "one two"), (901, "One, TWO!"), (902, "one two three"), (903, ""), (904, None), (905, "..."), (None, rows[0][1]), (2, rows[2][1]), (2, rows[2][1])]
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    rows = made_rows()
    assert result(spark, rows) == brute(rows)


def test_documents_equal_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert result(spark, [tuple(r) for r in df.collect()]) == brute([tuple(r) for r in df.collect()])


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, key string, bands int")
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f", "x", 1, "s"), (2, "A b c d e f", "x", 2, "s"), (3, None, None, None, None), (1, "a b c d e f", "x", 1, "s"), (None, "q r s", "x", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, row_key int, label string")
    assert ngram_join.deduplicated(empty).count() == 0
    for limit in (0, 100):
        kept = ngram_join.deduplicated(df, limit)
        assert kept.columns == df.columns
        assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "3", "None"]
    wordless = spark.createDataFrame([(None, "..."), (None, "!!"), (None, "!!"), (4, None), (4, "")], "doc_id bigint, text string")
    assert sorted(str((r.doc_id, r.text or "")) for r in ngram_join.deduplicated(wordless).collect()) == ["(4, '')", "(None, '!!')", "(None, '...')"]


def test_bands_reach_recall():
    bands = ngram_join.bands_for(0.8, 4, 0.9999)
    assert 1 - (1 - 0.8**4) ** bands >= 0.9999 > 1 - (1 - 0.8**4) ** (bands - 1)


def test_a_null_id_differs_from_the_word_null(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), ("null", text), ("null", text)], "doc_id string, text string")
    assert [r.doc_id for r in ngram_join.deduplicated(docs).collect()] == ["null"]  # a null id is never the least
    assert {r.class_id for r in ngram_join.near_duplicates(docs).collect()} == {"null"}
