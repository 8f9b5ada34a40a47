import re

import pytest
from tendersift.llm import decontamination as dc

from .oracle import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            p = words(t)
            n = min(10, len(p))
            for i in range(len(p) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == p[i : i + n]:
                        hit |= set(range(k, k + n))
                        ids.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(ids), ",".join(sorted(ids))))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(700))
ITEMS = [(1, "a b c d e f g h i j k l"), (2, "Solo"), (3, "x y"), (10, "C d E f g h i j k l"), (None, "q r s"), (4, ""), (5, None), (2, "other one"), (6, " ".join(f"w{i}" for i in range(250, 275)))]
DOCS = [(1, "zz A, b c d e f g h i j k l zz"), (2, "solo x. Y solo"), (3, ""), (4, None), (5, LONG), (5, LONG), (None, "q r s q r s"), (7, "b c d e f g h i j"), (8, "é SOLOé solo"), (9, "x x y y")]


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_equals_brute_force(spark, item_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = dc.with_hits(docs, items, "n", "ranges", "ids", item_bytes=item_bytes).collect()
    hit = lambda r: sum(b - a for a, b in zip(r.ranges[::2], r.ranges[1::2], strict=True))
    assert sorted(((r.doc_id, r.n, hit(r), len(r.ids), ",".join(r.ids)) for r in got), key=str) == brute(DOCS, ITEMS)


def test_stage_and_empty_tables(spark):
    docs = spark.createDataFrame([(*d, "s", 1) for d in DOCS], "doc_id bigint, text string, search_text string, hit_ids int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = dc.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute(DOCS, ITEMS) if not x[3])
    assert dc.decontaminated(docs, items.limit(0)).count() == len(DOCS)
    assert dc.contamination(docs.limit(0), items).count() == 0


def test_sql(spark):
    left, right = rows_of(spark, dc.query, dc.ORACLE_SQL, "/root/testdata/sf0.001")
    assert left == right
