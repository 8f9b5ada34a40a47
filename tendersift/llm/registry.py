"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tendersift.llm import bpe, collocations, decontamination, divergence, html_text, licenses, mixing, ngram_join, pii, quality, secrets, toxicity, transport_stream

_MODULES = {
    "op1_ngram_jaccard_join": ngram_join,
    "op2_media_columns": transport_stream,
    "op3_html_extraction": html_text,
    "op4_quality_classifier": quality,
    "op5_secret_scan": secrets,
    "op6_toxicity": toxicity,
    "op7_benchmark_decontamination": decontamination,
    "op8_pii": pii,
    "op9_license_scan": licenses,
    "op10_bpe": bpe,
    "op11_mixing": mixing,
    "op12_collocations": collocations,
    "op13_source_divergence": divergence,
}


def queries() -> dict:
    """name -> function(spark, sf_dir)."""
    return {name: module.query for name, module in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if hasattr(module, "ORACLE_SQL")}
