"""Queries of this subpackage, by module: each has QUERIES and, where SQL can express them, ORACLES."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_ngram_jaccard", "op2_suffix_dedup", "op3_mixing", "op4_pii", "op5_langid", "op6_quality", "op7_packing", "op8_html", "op9_ann", "op10_secrets"]


def _modules():
    return [import_module(f"weftlog.llm.{m}") for m in MODULES]


def queries() -> dict:
    import corpus_pipeline

    found = {"pipeline": corpus_pipeline.run}
    for m in _modules():
        found |= m.QUERIES
    return found


def oracles() -> dict[str, str]:
    import corpus_pipeline

    found = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    for m in _modules():
        found |= m.ORACLES
    return found
