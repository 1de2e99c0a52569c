"""Operators of a training-data pipeline, one module each, and their queries."""

from . import clustering, decontaminate, language, language_model, neardup, packing, personal, quality, secret_scan, suffix_dedup, topk, toxicity, whitening

MODULES = (language, decontaminate, topk, language_model, neardup, suffix_dedup, toxicity, quality, packing, secret_scan, clustering, personal, whitening)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
