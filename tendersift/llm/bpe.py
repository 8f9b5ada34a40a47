"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is merged on its own.  A segment
tree over the ranks of the adjacent pairs holds in its root the leftmost pair of the
lowest rank; a merge updates three leaves and the nodes above them, until the root
holds no mergeable pair.  Pieces that recur are looked up in a bounded table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import free_name, read_table, whole_text

#: At most twice so many merged pieces are remembered by a worker: the newer half drops out last.
REMEMBERED = 200_000
#: Longer pieces are not remembered.
LONG = 64

# The pattern of the tokenizer, and the same for ASCII texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece to its ids as bytes; what isn't there is merged, or fetched from the generation before."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = b"".join(i.to_bytes(4, "little") for i in self.merge(piece.encode()))
        if len(piece) <= LONG:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, vocab = _byte_letters(), data["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.token = {i: as_bytes(t) for t, i in vocab.items()}
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.width = max(i for i in vocab.values()) + 1
        self.rank = {vocab[a] * self.width + vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.any, self.ascii = regex.compile(_PATTERN), re.compile(_ASCII, re.A)
        self.known = _Pieces(self.piece)

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        none, rank, width = len(self.merged) * size, self.rank, self.width
        lowest = [none] * (2 * size)  # rank * size + place; node i stands over 2i and 2i + 1
        for i in range(n - 1):
            r = rank.get(ids[i] * width + ids[i + 1])
            if r is not None:
                lowest[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = lowest[2 * i], lowest[2 * i + 1]
            lowest[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := lowest[1]) < none:
            r, i = divmod(top, size)
            gone = after[i]
            behind = after[gone]
            ids[i] = self.merged[r]
            ids[gone] = -1
            after[i] = behind
            if behind < n:
                before[behind] = i
            changed = [(i, rank.get(ids[i] * width + ids[behind]) if behind < n else None)]
            if before[i] >= 0:
                changed.append((before[i], rank.get(ids[before[i]] * width + ids[i])))
            if gone < size:
                changed.append((gone, None))
            for leaf, r in changed:
                node = size + leaf
                value = none if r is None else r * size + leaf
                if lowest[node] == value:
                    continue
                lowest[node] = value
                while node > 1:
                    node >>= 1
                    a, b = lowest[2 * node], lowest[2 * node + 1]
                    low = a if a < b else b
                    if lowest[node] == low:
                        break
                    lowest[node] = low
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, (self.ascii if text.isascii() else self.any).findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text are found first."""
        if self.special_re is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.special_re.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_LOADED: dict[str, BytePairs] = {}


def loaded(path: str | None) -> BytePairs:
    """The encoder of a file, kept by the worker; None: the public byte-level file of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def _mapped(df: DataFrame, name: str, kind: str, source: str, make) -> DataFrame:
    df = df.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, arrow = make(), pa.binary() if kind == "binary" else pa.string()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # smaller batches leave sooner
                part = batch.slice(lo, 500)
                made = pa.array([one(x.as_py()) for x in part.column(source)], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return df.mapInArrow(run, f"{fields}, `{name}` {kind}")


def encoded(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, as little-endian unsigned 32-bit integers.

    path: a tokenizer file that every executor can read.  A null text is an empty one
    and has no ids.  A column of the result's name (in any case) is replaced, all others
    stay as they are; an empty table gives an empty one.
    """
    text = free_name(docs, "encode_text")
    return _mapped(docs.withColumn(text, whole_text()), ids, "binary", text, lambda: loaded(path).encode).drop(text)


def decoded(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of the ids; null ids give the empty text; a column of the result's name is replaced."""
    source = free_name(docs, "decode_ids")
    return _mapped(docs.withColumn(source, F.coalesce(F.col(ids), F.lit(b""))), text, "string", source, lambda: loaded(path).decode).drop(source)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs."""
    both = decoded(encoded(docs.select("doc_id", "text"), path).drop("text"), path)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
