"""The numbered queries of this package, by name."""

from __future__ import annotations

from importlib import import_module

#: Query, module, and whether the module has its SQL for DuckDB in ``ORACLE_SQL``.
QUERIES = {
    "op1_token_counts": "tokens",
    "op2_suffix_dedup": "repeats",
    "op3_jaccard_join": "jaccard",
    "op4_sentencepiece": "pieces",
    "op5_topk_search": "topk",
    "op6_mixing": "mixing",
    "op7_quality_rules": "quality",
    "op8_line_dedup": "lines",
    "op9_chat_format": "chat",
    "op10_sharding": "shards",
    "op11_simhash": "simhash",
    "op12_collocations": "phrases",
    "op13_merkle_manifest": "manifest",
}


def _function(name: str):
    return getattr(import_module(f"{__package__}.{QUERIES[name]}"), name)


def queries() -> dict:
    return {name: _function(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
