"""Personal data by bootstrapped contextual extraction.

Seeds are what the fixed patterns of each kind find.  A seed induces lexical patterns:
the words around it, one word with the shape of the identifier, a label before it, the
shape by itself.  Spark scores the graph of patterns and instances in rounds: a pattern
is as good as the lower bound of the share of its distinct instances that are believed
(Wilson's, at Z standard deviations), an instance as its best pattern of high confidence.
Those patterns then take further identifiers of a fitting form that the fixed patterns
miss: numbers in other notations, addresses with other letters, IPv6.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import attached, free_name, read_table, stored, text_key, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern needs, the confidence from which it is used, and the rounds of scoring.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.7, 3
#: Standard deviations by which a share of few instances is taken lower.
Z = 1.0

# The base patterns.  The possessive forms match the same strings.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Forms of identifiers that the base patterns may miss; never a part of a longer word.
_LIKE, _INSIDE = re.compile(r"(?<![^\W])[0-9(+](?:[\x20().:/-]{0,2}[0-9])++"), re.compile(r"\w")
_IP6 = re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])")
_NEAR_AT = re.compile(r"[^\s@,;<>]+")
_ENDS = frozenset("@,;<>")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile("[0-9]+")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20.-]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; ends exclusive, in code points."""
    out: list[Span] = [(0, *x) for x in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _fitting(found: str) -> list[int]:
    """The kinds that a string may be of by its form."""
    if "@" in found:
        return [0]
    if "::" in found or found.count(":") == 7:
        return [1]
    digits = "".join(_DIGIT.findall(found))
    kinds = [2] if 13 <= len(digits) <= 19 and _luhn(digits) else []
    return kinds + ([3] if 7 <= len(digits) <= 15 and found.count("(") == found.count(")") and ":" not in found else [])


def _shape(found: str, kind: int) -> str:
    """Digits by the lengths of their runs, without a country's number; dots of an address."""
    if kind == 0:
        return "@" + "." * found.rpartition("@")[2].count(".")
    if kind == 1:
        return "::" if ":" in found else "...."
    return _RUN.sub(lambda m: str(len(m[0])), _COUNTRY.sub("", found))


def _around(text: str, start: int, end: int, kind: int) -> list[str]:
    """Lexical patterns of a place, _ for the identifier.

    The two words before it; the word before with the word after; the word before with the
    shape, and with a mark between (card no: _); the shape, if it has a mark of its own.
    """
    left = text[max(0, start - 60) : start]
    before = [w.lower() for w in _WORD.findall(left)[-2:]]
    after = [w.lower() for w in _WORD.findall(text[end : end + 40])[:1]]
    shape, mark = _shape(text[start:end], kind), left.rstrip()[-1:]
    out = [f"{before[0]} {before[1]} _"] if len(before) == 2 else []
    if before:
        out += [f"{before[-1]} _ {after[0]}"] if after else []
        out += [f"{before[-1]} _{shape}"] + ([f"{before[-1]}{mark} _"] if mark in (":", "=", "#") else [])
    return out + ([f"_{shape}"] if not shape.replace(" ", "").isdigit() else [])


def _runs_of_digits(text: str) -> Iterator[tuple[int, int]]:
    """Matches of _LIKE that no word goes on from.

    A run that a word goes on from has no match in it at all, as any later start leads to the
    same end; it is passed over at once, so long lists of numbers take linear time.
    """
    for m in _LIKE.finditer(text):
        if not _INSIDE.match(text, m.end()):
            yield m.span()


def _like(text: str) -> list[tuple[int, int]]:
    """Strings of an identifier's shape, leftmost first and apart: what stands around each @, and runs of digits."""
    found, last = list(_runs_of_digits(text)) + ([m.span() for m in _IP6.finditer(text) if len(m[0].replace(":", "")) > 3] if ":" in text else []), 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and not text[start - 1].isspace() and text[start - 1] not in _ENDS:
            start -= 1
        m = _NEAR_AT.match(text, at + 1)
        if m and start < at:
            found.append((start, m.end()))
        last = at + 1
        at = text.find("@", at + 1)
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def mentions(text: str, spans: list[Span]) -> list[dict]:
    """Seeds and further strings of an identifier's form, each with the patterns around it; one row for each kind it may be of."""
    found = [(s, e, k, True) for k, s, e in spans]
    if "@" in text or ":" in text or _DIGIT.search(text):
        taken = sorted((s, e) for _, s, e in spans)
        i = 0
        for start, end in _like(text):
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if i == len(taken) or taken[i][0] >= end:
                found += [(start, end, k, False) for k in _fitting(text[start:end])]
    name = lambda x, k: x.lower() if k < 2 else "".join(_DIGIT.findall(x))
    return [{"start": s, "end": e, "kind": k, "seed": seed, "instance": name(text[s:e], k), "patterns": _around(text, s, e, k)} for s, e, k, seed in found]


_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
_MENTIONS = "array<struct<start:bigint,end:bigint,kind:int,seed:boolean,instance:string,patterns:array<string>>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_MENTIONS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, found = [], []
        for x in batch.column("text"):
            text = x.as_py()
            mine = base_spans(text)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in mine])
            found.append(mentions(text, mine))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(spans, _SPANS_ARROW), pa.array(found, _MENTIONS_ARROW)], ["doc_id", "text_key", "base", "mentions"])


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base spans and mentions for each row of docs."""
    rows = docs.select("doc_id", text_key().alias("text_key"), whole_text().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(_extract, f"doc_id {id_type}, text_key binary, base {_SPANS}, mentions {_MENTIONS}"), "mentions")


def _wilson(share: Column, n: Column, z: float) -> Column:
    """The lower bound of a share seen in n cases."""
    spread = z * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def _on(*columns: str) -> Column:
    return F.xxhash64(*columns)


def good_patterns(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, z: float = Z) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, confidence, seeds, key) of the patterns and (kind, instance, belief, key) of the unseen instances that they hold.

    A seed is believed with 1, another instance with the confidence of its best good
    pattern in the round before, at first with 0.  Equal instances count once for a
    pattern, whatever the number of their places.
    """
    each = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.instance", "m.seed", F.explode("m.patterns").alias("pattern"))
    edges = each.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = stored(edges.withColumns({"pattern_key": _on("kind", "pattern"), "instance_key": _on("kind", "instance")}), "graph")
    belief = None
    for i in range(rounds):
        held = edges.withColumn("belief", F.lit(0.0)) if belief is None else attached(edges, belief.select(F.col("key").alias("instance_key"), "belief"), "instance_key", "pattern")
        held = held.groupBy("kind", "pattern").agg(
            F.avg(F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0)))).alias("share"),
            F.count("*").alias("n"),
            F.count_if("seed").alias("seeds"),
        )
        scored = held.filter(F.col("seeds") >= support).select("kind", "pattern", _wilson(F.col("share"), F.col("n"), z).alias("confidence"), "seeds", _on("kind", "pattern").alias("key"))
        patterns = stored(scored.filter(F.col("confidence") >= confidence), f"patterns-{i}")
        taken = attached(edges.filter("NOT seed"), patterns.select(F.col("key").alias("pattern_key"), "confidence"), "pattern_key", "instance").filter("confidence IS NOT NULL")
        belief = stored(taken.groupBy("kind", "instance", F.col("instance_key").alias("key")).agg(F.max("confidence").alias("belief")), f"belief-{i}")
    return patterns, belief


def discovered(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, z: float = Z) -> DataFrame:
    """(text_key, more): the further spans of each distinct text, each of the kind of its best pattern."""
    patterns, _ = good_patterns(found, support, confidence, rounds, z)
    each = found.select("text_key", F.explode("mentions").alias("m")).filter("NOT m.seed").select("text_key", "m.start", "m.end", "m.kind", F.explode("m.patterns").alias("pattern"))
    each = each.withColumn("pattern_key", _on("kind", "pattern"))
    held = attached(each, patterns.select(F.col("key").alias("pattern_key"), "confidence"), "pattern_key", "text_key").filter("confidence IS NOT NULL")
    best = held.groupBy("text_key", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("rank"), "kind")).alias("b"))
    return best.groupBy("text_key").agg(F.collect_set(F.struct(F.col("b.kind").alias("kind"), "start", "end")).alias("more"))


def found_spans(docs: DataFrame, **how) -> DataFrame:
    """doc_id, base and spans for each row of docs: arrays of (kind, start, end) by kind, then start.

    base holds what the fixed patterns find, spans that and what the learned patterns add;
    the two never overlap.  Offsets are code points, ends exclusive.  A null text is empty.
    Equal texts have equal spans, whatever their ids.
    """
    found = extracted(docs)
    more = stored(discovered(found, **how), "discovered")
    none = F.array().cast(_SPANS)
    return attached(found.select("doc_id", "text_key", "base"), more, "text_key", "doc_id", F.size("more")).select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, **how) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in brackets.

    n_chars is set to the new length where docs has it.  Overlapping spans become one,
    of the kind of the first.  Null texts stay null; columns and names stay as they are.
    """
    key, text, more = (free_name(docs, x) for x in ("text_key", "redact_text", "redact_more"))
    extra = stored(discovered(extracted(docs.select("doc_id", "text")), **how).select(F.col("text_key").alias(key), F.col("more").alias(more)), "discovered")
    rows = attached(docs.withColumns({key: text_key(), text: whole_text()}), extra, key, "doc_id", F.size(more)).drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(text), batch.column(more), strict=True):
                whole, parts, last = x.as_py(), [], 0
                for start, end, kind in sorted([(s, e, k) for k, s, e in base_spans(whole)] + [(m["start"], m["end"], m["kind"]) for m in y.as_py() or ()]):
                    if start >= last:
                        parts += [whole[last:start], f"[{KINDS[kind]}]"]
                    last = max(last, end)
                out.append("".join(parts) + whole[last:])
            made = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([made if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    clean = rows.mapInArrow(run, fields)
    put = {"text": F.when(F.col("text").isNotNull(), F.col(text)).alias("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("n_chars").isNotNull(), F.char_length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return clean.select(*[put.get(c, F.col(f"`{c}`")) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = found_spans(read_table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *[count(i) for i in range(4)], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
