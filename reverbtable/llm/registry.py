"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib

from reverbtable.llm import book

MODULES = ["ngram_join", "quality_rules", "sharding", "url_filter", "packing",
           "token_blocks", "license_scan", "html_text", "line_dedup", "decontaminate", "piece_table", "importance",
           "conversation_trie"]


def queries() -> dict:
    for name in MODULES:
        importlib.import_module(f"reverbtable.llm.{name}")
    import corpus_pipeline
    return {**book.QUERIES, "pipeline": corpus_pipeline.run}


def oracles() -> dict:
    queries()
    return dict(book.ORACLES)
