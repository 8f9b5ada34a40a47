import math
import random
import re
import time
from collections import defaultdict

from tendersift.llm import pii

# The contract's patterns as they are stated.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_equals_the_stated_patterns():
    rnd = random.Random(1)
    pieces = ["a", "b.c", "@", "@x.y", ".", "1", "25", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "--", "(", "é", "_%", "1.2.3.4", "999.1.1.1", "\n", "0049"]
    for _ in range(20000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("at " + "0" * 9000 + "1.1.1.1") == [(1, 3, 9010)]
    assert pii.base_spans("9" * 9000 + ".1.1.1") == []


def test_learned_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} tomorrow") for i in range(12)]
    rows += [(100, "so call me at 555 010 4242 tomorrow"), (101, "weights 555 010 4242 of stone"), (100, "so call me at 555 010 4242 tomorrow"), (None, ""), (207, None), (102, "x" * 200_000 + " a@b.co")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, base string")
    got = [(r.doc_id, r.base, r.spans) for r in pii.found_spans(df).collect()]
    assert len(got) == len(rows)
    by = {d: (b, s) for d, b, s in got}
    assert by[100][0] == [] and [tuple(x) for x in by[100][1]] == [(3, 14, 26)]
    assert by[101] == ([], []) and by[207] == ([], []) and by[None] == ([], [])
    assert [tuple(x) for x in by[102][1]] == [(0, 200_001, 200_007)]
    clean = pii.redacted(df.withColumn("n_chars", df.doc_id)).filter("doc_id = 100").first()
    assert clean.text == "so call me at [phone] tomorrow" and clean.n_chars == len(clean.text)
    assert pii.found_spans(df.limit(0)).count() == 0
    assert pii.redacted(df).filter("doc_id = 207").first().text is None


def brute_graph(texts, support=pii.SUPPORT, confidence=pii.CONFIDENCE, rounds=pii.ROUNDS, z=pii.Z):
    """Confidence of the good patterns, by plain loops over the edges."""
    edges = defaultdict(dict)
    for text in set(texts):
        for m in pii.mentions(text, pii.base_spans(text)):
            for p in m["patterns"]:
                at = edges[m["kind"], p]
                at[m["instance"]] = at.get(m["instance"], False) or m["seed"]
    belief, good = {}, {}
    for _ in range(rounds):
        good = {}
        for (kind, p), held in edges.items():
            n, seeds = len(held), sum(held.values())
            share = sum(1.0 if seed else belief.get((kind, i), 0.0) for i, seed in held.items()) / n
            low = (share + z * z / (2 * n) - z * math.sqrt(max(share * (1 - share), 0) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if seeds >= support and low >= confidence:
                good[kind, p] = low
        belief = {}
        for (kind, p), low in good.items():
            for i, seed in edges[kind, p].items():
                if not seed:
                    belief[kind, i] = max(low, belief.get((kind, i), 0.0))
    return good, belief


def planted(seed=4):
    """Texts of the fixture's words with identifiers in contexts, and what of them should be found."""
    rnd = random.Random(seed)
    words = ["vel", "orn", "the", "asti", "of", "mento", "der", "nicht", "que", "ist", "rha", "thn"]
    num = lambda n: "".join(rnd.choice("123456789") for _ in range(n))

    def card(join):
        d = num(15)
        d += next(x for x in "0123456789" if luhn(d + x))
        return join.join(d[i : i + 4] for i in range(0, 16, 4))

    made = {
        ("phone", True): (60, lambda: f"please call me at +1 ({num(3)}) 555-{num(4)} tomorrow"),
        ("card", True): (40, lambda: f"paid with card no: {card(' ')} today"),
        ("ip", True): (40, lambda: f"login from host {rnd.randrange(256)}.{rnd.randrange(256)}.1.{rnd.randrange(256)} at night"),
        ("email", True): (40, lambda: f"write a mail to {rnd.choice(words)}{num(3)}@example.com please"),
        ("phone", False): (15, lambda: f"please call me at <{num(3)} 555 {num(4)}> tomorrow"),
        ("card", False): (10, lambda: f"paid with card no: <{card('.')}> today"),
        ("ip", False): (10, lambda: f"login from host <fe80::{num(3)}:{num(2)}> at night"),
        ("email", False): (10, lambda: f"write a mail to <{rnd.choice(words)}{num(3)}@büro.de> please"),
        (None, False): (60, lambda: f"lot {num(3)} 555 {num(4)} of {num(8)} parts by {card('.')} and {num(16)} at 12:30:15 or a@b now"),
    }
    texts, want = [], []
    for (kind, _), (n, make) in made.items():
        for _ in range(n):
            fill = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(4, 30))) for _ in range(2)]
            text = f"{fill[0]} {make()} {fill[1]}"
            want.append({(kind, text.index("<"), text.index(">") - 1)} if "<" in text else set())
            texts.append(text.replace("<", "").replace(">", ""))
    return texts, want


def test_graph_equals_brute_force_and_planted_identifiers_are_found(spark):
    texts, want = planted()
    texts, want = texts + texts[:20] + [None, ""], want + want[:20] + [set(), set()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    patterns, belief = pii.good_patterns(pii.extracted(df))
    good, believed = brute_graph([t or "" for t in texts])
    assert {(r.kind, r.pattern): round(r.confidence, 9) for r in patterns.collect()} == {k: round(v, 9) for k, v in good.items()}
    assert {(r.kind, r.instance): round(r.belief, 9) for r in belief.collect()} == {k: round(v, 9) for k, v in believed.items()}
    assert {k for k, _ in good} == {0, 1, 2, 3} and len(believed) >= 40
    found = {r.doc_id: {(pii.KINDS[s.kind], s.start, s.end) for s in r.spans} - {(pii.KINDS[s.kind], s.start, s.end) for s in r.base} for r in pii.found_spans(df).collect()}
    right = sum(len(found[i] & w) for i, w in enumerate(want))
    assert right / sum(map(len, found.values())) > 0.97, "precision"
    assert right / sum(map(len, want)) > 0.97, "recall"


def test_decoys_of_the_fixture_are_left_alone(spark):
    """The fixture's other long numbers fail the check digit, and no unseen identifier stands there: patterns are learned and add nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    patterns, belief = pii.good_patterns(pii.extracted(docs))
    assert {"_@..", "_....", "_(3) 3-4"} <= {r.pattern for r in patterns.collect()} and belief.count() == 0


def test_query_keeps_the_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in pii.query(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = brute(d.text)
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))


def test_long_lists_of_numbers_take_linear_time():
    """Runs are those of the plain pattern, which looks ahead from every start."""
    plain = re.compile(r"(?<![^\W])[0-9(+](?:[\x20().:/-]{0,2}[0-9])++(?![^\W])")
    rnd = random.Random(12)
    for _ in range(3000):
        text = "".join(rnd.choice("01(+) .:/-x_é ") for _ in range(rnd.randrange(30)))
        assert list(pii._runs_of_digits(text)) == [m.span() for m in plain.finditer(text)], text
    began = time.process_time()
    for text in ("1 " * 500_000 + "1x", "(1" * 300_000 + "x", "+1 " * 300_000, "1." * 500_000 + "y", "1-" * 500_000):
        pii.base_spans(text), pii._like(text)
    assert time.process_time() - began < 30


def test_redaction_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, Redact_Text string")
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == 0
