"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule's pattern is turned into a Boolean query over trigrams that any match must
hold: alternatives of trigram sets.  The index holds a posting (trigram, text) for the
trigrams of the queries; intersecting the postings of each alternative gives the
candidate texts, and only they are searched with the rule's pattern.  A rule whose
pattern has no mandatory trigram searches every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import BROADCAST_CELLS, attached, read_table, stored, whole_text

#: More strings or alternatives than that make a part of a pattern count as anything.
MANY = 40


class Rule(NamedTuple):
    """least: code points that the group must have at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Public token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
)

Query = set[frozenset[str]]  # alternatives; an empty alternative is met by any text
_ANY: Query = {frozenset()}


def _least(q: Query) -> Query:
    return {a for a in q if not any(b < a for b in q)}


def _both(p: Query, q: Query) -> Query:
    out = _least({a | b for a, b in product(p, q)})
    return out if len(out) <= MANY else min(p, q, key=len)


def _of_strings(strings: set[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _parts(tree) -> tuple[set[str] | None, Query]:
    """The strings that a sequence can be, if they are few, and what every match must hold."""
    exact: set[str] | None = {""}
    run, need = {""}, _ANY
    for code, value in tree:
        strings, inner = _node(code, value)
        if strings is not None and len(run) * len(strings) <= MANY:
            run = {a + b for a, b in product(run, strings)}
            exact = {a + b for a, b in product(exact, strings)} if exact is not None and len(exact) * len(strings) <= MANY else None
            continue
        need = _both(need, _of_strings(run))
        run, exact = strings if strings is not None else {""}, None
        need = _both(need, inner)
    need = _both(need, _of_strings(run))
    return exact, need


def _node(code, value) -> tuple[set[str] | None, Query]:
    if code is op.LITERAL:
        return {chr(value).lower()}, _ANY
    if code is op.IN:
        literals = {chr(v).lower() for c, v in value if c is op.LITERAL}
        return (literals, _ANY) if all(c is op.LITERAL for c, _ in value) and len(literals) <= 8 else (None, _ANY)
    if code is op.SUBPATTERN:
        return _parts(value[-1])
    if code is op.BRANCH:
        found = [_parts(x) for x in value[1]]
        strings = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        return (strings if strings is not None and len(strings) <= MANY else None), _least(set().union(*(q for _, q in found)))
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, need = _parts(inner)
        if (low, int(high)) == (0, 1) and strings is not None:
            return strings | {""}, _ANY
        return (strings, need) if (low, int(high)) == (1, 1) else (None, need if low else _ANY)
    if code is op.AT:
        return {""}, _ANY
    return None, _ANY


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, of which each match holds one in full; {frozenset()} if none is mandatory."""
    return _parts(parser.parse(pattern))[1]


def text_key() -> Column:
    """16 bytes that equal texts share."""
    return F.unhex(F.md5(whole_text().cast("binary")))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, text_key) for each of the trigrams that a text of docs holds, case folded."""
    words = F.array(*[F.lit(t) for t in trigrams]) if trigrams else F.array().cast("array<string>")
    held = F.transform(F.array(F.lower(whole_text())), lambda text: F.filter(words, lambda t: F.contains(text, t)))[0]  # folds the text once
    return docs.select(text_key().alias("text_key"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(text_key, rules): the numbers of the rules whose trigram query each distinct text meets."""
    clauses = [(r, c, t, 1 << i, (1 << len(alt)) - 1) for r, rule in enumerate(rules) for c, alt in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))) for i, t in enumerate(alt)]
    if not clauses:
        return docs.sparkSession.createDataFrame([], "text_key binary, rules array<int>")
    table = docs.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, bit bigint, all bigint")  # bounded by the rules
    hits = postings(docs, sorted({c[2] for c in clauses})).join(F.broadcast(table), "trigram")
    met = hits.groupBy("text_key", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("all").alias("all")).filter("bits = all")
    return met.groupBy("text_key").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """All matches of a rule, leftmost and non-overlapping, in code points: what stands between the matches gives their places."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(whole)), F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("size"), F.transform(part, F.char_length).alias("group"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        hi = lo + x["size"]
        span = F.array(F.struct(lo.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), hi.alias("end")))
        return F.struct(hi.alias("at"), F.when(x["group"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, add, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """doc_id and spans (start, rank, kind, end) by start, then rule, for each row of docs(doc_id, text).

    Offsets are code points, ends exclusive.  A null text is empty.  Matches of different
    rules may overlap.  Equal texts have equal spans.  Other columns are ignored.
    """
    found = stored(candidates(docs, rules), "candidates")
    rows = docs.select("doc_id", whole_text().alias("text"), text_key().alias("text_key"))
    rows = attached(rows, found, "text_key", "doc_id", limit=broadcast_cells)  # a row holds as many numbers as there are rules at most
    none = F.array().cast(_SPANS)
    each = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("text"), i, rule)
        if trigram_query(rule.pattern) == _ANY:
            each.append(F.when(F.rlike("text", F.lit(rule.pattern)), spans).otherwise(none))
        else:
            each.append(F.when(F.array_contains("rules", i), spans).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    of = lambda i: F.filter("spans", lambda s: s["rank"] == i)
    counts = [F.size(of(i)).cast("bigint").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same by searching every text with every pattern."""
    parts = []
    for i, r in enumerate(BASE + MORE):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, {i} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda k: {{
           's': list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0),
           'n': length(m[k]), 'q': length(q[k])}})) AS x
  FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS q, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))
  """)
    least = "CASE rank " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(BASE + MORE)) + " END"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({"  UNION ALL".join(parts)}),
s AS (SELECT r, rank, kind, CAST(x.s AS BIGINT) AS lo, kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT) AS t FROM a WHERE x.q >= {least}),
g AS (SELECT r, {counts}, string_agg(t, ',' ORDER BY lo, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(t, ',' ORDER BY lo, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL = _oracle()
