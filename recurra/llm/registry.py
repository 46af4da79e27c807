"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, divergence, filter_audit, licenses, media, ngram_lm, packing, simhash, substring_dedup, suffix_dedup, token_files, toxicity

MODULES = (packing, toxicity, media, ngram_lm, substring_dedup, simhash, decontaminate, licenses, chat, suffix_dedup, divergence, token_files, filter_audit)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    found = {k: v for m in MODULES for k, v in m.ORACLES.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
