import hashlib

import corpus_pipeline as cp
import public_tokenizers
from pyspark.sql import functions as F
from tendersift.llm import quality
from tokenizers import Tokenizer

from .test_decontamination import brute as hits
from .test_ngram_join import brute as near
from .test_pii import brute as spans

SF = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]

    one = cp.keep_quality(spark, docs, SF).cache()
    kept = {r.doc_id for r in quality.query(spark, SF).filter("kept").collect()}
    assert one.columns == names and {r.doc_id for r in one.collect()} == kept and 700 < len(kept) < 1000

    two = cp.keep_one_of_each_group(spark, one, SF).cache()
    want = sorted(d for d, least, _ in near([(r.doc_id, r.text) for r in one.collect()]) if d == least)
    assert two.columns == names and sorted(r.doc_id for r in two.collect()) == want

    three = cp.drop_contaminated(spark, two, SF).cache()
    some = [(r.doc_id, r.text) for r in two.filter("n_chars < 1500").collect()]
    clean = {r.doc_id for r in three.collect()}
    assert three.columns == names and {d for d, _ in some if d in clean} == {d for d, _, n, _, _ in hits(some, items) if not n}

    four = cp.redact(spark, three, SF).cache()
    before = {r.doc_id: r.text for r in three.collect()}
    assert four.columns == names and four.count() == len(before)
    for r in four.collect():
        assert r.n_chars == len(r.text) and not spans(r.text)
        assert (r.text == before[r.doc_id]) or spans(before[r.doc_id])

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in four.collect()}
    five = cp.encode(spark, four, SF).collect()
    assert len(five) == len(text)
    for r in five:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and hashlib.sha256(r.ids).digest() == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).digest()


def test_stages_on_odd_tables(spark):
    """Empty tables, null texts and ids, repeated rows, and columns named like the stages' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("doc_id < 40").withColumn("text_key", F.lit("mine")).withColumn("Grams", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, "mine", 1), (1, "", "en", "s", 0, "mine", 1)], some.schema)
    rows = some.unionByName(odd).unionByName(some.filter("doc_id = 3"))
    for name, stage in cp.STAGES:
        none = stage(spark, some.limit(0), SF)
        assert none.count() == 0, name
        out = stage(spark, rows, SF)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= {r.doc_id for r in rows.select("doc_id").distinct().collect()}, name
        if name != "bpe":
            assert out.columns == none.columns == rows.columns, name
            assert {(r.text_key, r.Grams) for r in out.select("text_key", "Grams").distinct().collect()} == {("mine", 1)}, name
        if name in ("decontamination", "pii", "bpe"):
            assert ids.count(3) == 2 and None in ids, name  # repeated rows stay, as do rows without text
        if name == "near_duplicates":
            assert ids.count(3) == 1 and None in ids and 1 in ids, name
