import random
import re

from tendersift.llm import licenses as li

from .oracle import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, label) for p, label in li.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    more, best = set(), 0.0
    for line in (text or "").lower().split("\n"):
        s = set(WORD.findall(line))
        for label, t, must, bars in li.TEMPLATES:
            t = set(li.template_words(t))
            if len(s & t) >= li.THRESHOLD * len(t) - 1e-9 and s.issuperset(must) and s.isdisjoint(bars):
                more.add(label)
                best = max(best, len(s & t) / len(t))
    base = sorted({x for _, x in at})
    places = sorted({(x, sum(y == x for _, y in at), min(k for k, y in at if y == x), max(k for k, y in at if y == x)) for x in base})
    return len(w), places, base, sorted(more | set(base)), 1.0 if at else round(best, 9)


def rows():
    rnd = random.Random(11)
    out = []
    for i in range(300):
        parts = []
        for _ in range(rnd.randrange(6)):
            t = rnd.choice(li.TEMPLATES)[1].split()
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(len(t))] = rnd.choice(["zz", "the", "of", "é", "Apache", "BY"])
            parts.append(rnd.choice([" ", "\n", "-", "\n\n"]).join(t) if rnd.random() < 0.2 else " ".join(t))
        out.append((i, rnd.choice(["\n", " "]).join(parts)))
    odd = ["", None, "MIT-License mit LICENSE. MITlicense", "cc by cc  by-nc ccby CC/BY", "éapache license apache licenseé apache license", "word " * 60_000 + "cc by"]
    return out + [(900 + i, t) for i, t in enumerate(odd)] + [(None, "MIT License"), (900, ""), (3, out[3][1])]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id bigint, text string, labels string").repartition(4)
    got = [str((r.doc_id, (r.n_words, sorted((p.label, p.n, p.first, p["last"]) for p in r.places), r.base_labels, r.labels, round(r.score, 9)))) for r in li.scan(df).collect()]
    assert sorted(got) == sorted(str((d, brute(t))) for d, t in rows())


def test_sql_and_empty_table(spark):
    left, right = rows_of(spark, li.query, li.ORACLE_SQL, "/root/testdata/sf0.001")
    assert left == right
    assert li.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_wrapped_notices(spark, tmp_path):
    import textwrap

    names = {t.label: i for i, t in enumerate(li.TEMPLATES) if t.label in ("mit", "bsd", "lgpl", "agpl", "mpl")}
    rows = []
    for label, i in names.items():
        text = li.TEMPLATES[i][1]
        rows += [(label, "\n".join(textwrap.wrap(text, 40))), (label, "zz yy\n" + textwrap.fill(text, 70, initial_indent=" * ", subsequent_indent=" * ") + "\nzz"), (label, text.replace(" ", "\n\n"))]
    words = li.TEMPLATES[names["bsd"]][1].split()
    rows += [("", "\n".join(("zz " * 9 + w) for w in words)), ("", "\n".join(words[: len(words) // 2])), ("", None)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.labels, r.score) for r in li.query(spark, str(tmp_path)).collect()}
    for i, (label, _) in enumerate(rows):
        assert label in got[i][0].split(",") and got[i][1] == (1.0 if label else 0.0), (i, label, got[i])
    assert all(got[i][0] == "" for i in range(len(rows) - 3, len(rows)))


def test_runs_equal_sliding_window(spark):
    """Runs against every window of words, with the lines' own finds."""
    want = {}
    for d, text in [(i, t) for i, (_, t) in enumerate(rows())]:
        w, more = WORD.findall((text or "").lower())[:3000], set(brute(text)[3])
        if len([x for x in (text or "").lower().split("\n") if set(WORD.findall(x)) & set(li.vocabulary_of(li.TEMPLATES))]) > 1:
            for label, t, must, bars in li.TEMPLATES:
                t, span = set(li.template_words(t)), li.SPAN * li.template_length(t)
                windows = [set(w[k : k + span]) for k in range(len(w))]
                for k in range(len(w)):  # a window ends before a barred word
                    stop = next((j for j in range(k, min(k + span, len(w))) if w[j] in bars), k + span)
                    windows[k] = set(w[k:stop])
                more |= {label for x in windows if len(x & t) >= li.THRESHOLD * len(t) - 1e-9 and x.issuperset(must)}
        want[d] = sorted(more)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows())], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in li.scan(df, wrapped=True).collect()} == want


def test_sister_licenses_get_their_own_label_alone(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    kinds = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
    rows = [(k, notice.format(v)) for k, v in kinds.items()]
    rows += [(k, notice.format(v).replace(" the ", " the\n * ").replace(" it", "\n * it")) for k, v in kinds.items()]
    rows += [("gpl,lgpl", notice.format(kinds["lgpl"]) + "\n\n" + notice.format(kinds["gpl"])), ("agpl,gpl", notice.format(kinds["gpl"]).replace(" under", "\nunder") + "\n" + notice.format(kinds["agpl"]).replace(" under", "\nunder"))]
    rows += [("cc-by,cc-by-nc", "Licensed under CC BY-NC 4.0"), ("cc-by,cc-by-sa", "Licensed under CC BY-SA 4.0"), ("cc-by", "Licensed under CC BY 4.0"), ("lgpl", notice.format("Library General Public License"))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: ",".join(r.labels) for r in li.scan(df, wrapped=True).collect()}
    assert got == {i: want for i, (want, _) in enumerate(rows)}
