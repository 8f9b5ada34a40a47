import hashlib
import random

import public_tokenizers
from tendersift.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  ", "\n\n a\t\tb", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's I'll we've 'sd 'S", "é ñ ß ü", "日本語 一二 ½ ²", "\x00\x1c\x1f\x85\xa0  z", "a" * 5000, "ab" * 3000, "🙂🙂‍x", "Ⅻ ٣٤ ｆｕｌｌ", "!!??...--  ..", "\r\n\r\n", "é ​ x"]


def test_equals_the_library():
    mine, lib = bpe.BytePairs(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    alphabet = [*"abcdefghijklmnopqrstuvwxyz" * 3, *"ABC 019.,'\n\t  ", *"éßñçü", "日", "²", "\x85", "\xa0", "\x1d", "　", "🙂", "́"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(2000)]
    for text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        got = mine.encode(text)
        assert list(memoryview(got).cast("I")) == ids if got else ids == [], text
        assert mine.decode(got) == lib.decode(ids, skip_special_tokens=False)


def test_tree_equals_scanning_for_the_lowest_pair():
    mine, rnd = bpe.BytePairs(PATH), random.Random(4)
    for _ in range(500):
        data = bytes(rnd.choice(b"theinaros ") for _ in range(rnd.randrange(1, 60)))
        ids = [mine.single[b] for b in data]
        while True:
            ranks = [mine.rank.get(a * mine.width + b, 10**9) for a, b in zip(ids, ids[1:], strict=False)]
            if not ranks or min(ranks) == 10**9:
                break
            i = ranks.index(min(ranks))
            ids[i : i + 2] = [mine.merged[ranks[i]]]
        assert mine.piece(data) == ids


def test_query_equals_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    for d in docs.collect():
        ids = lib.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2), (None, "", 3), (4, "hello world" * 40_000, 4), (4, "<|endoftext|>", 5), (4, "<|endoftext|>", 5)], "doc_id bigint, text string, decoded int")
    both = bpe.decoded(bpe.encoded(docs), text="back")
    assert both.columns == ["doc_id", "text", "decoded", "ids", "back"]
    assert sorted(r.back for r in both.collect()) == sorted([r.text or "" for r in docs.collect()])
    assert bpe.digests(docs.limit(0)).count() == 0 and bpe.encoded(docs.limit(0)).count() == 0
    clash = bpe.decoded(bpe.encoded(docs.withColumn("IDS", docs.doc_id)))
    assert clash.columns == ["doc_id", "text", "ids", "decoded"] and sorted(r.decoded for r in clash.collect()) == sorted([r.text or "" for r in docs.collect()])
