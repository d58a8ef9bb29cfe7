"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from phasegrid.llm import lexical_search, mixing, ngram_join, packing, pii, quality_model, quality_rules, sharding, tandem_runs, token_counts, topk_search, url_filter, warc

_MODULES = (lexical_search, mixing, ngram_join, packing, pii, quality_model, quality_rules, sharding, tandem_runs, token_counts, topk_search, url_filter, warc)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
