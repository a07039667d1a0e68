"""The queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

# query name -> module; the query is the function of that name, its SQL the ``ORACLE_SQL`` there.
MODULES = {
    "op1_ann": "ann",
    "op2_chat_format": "chat",
    "op3_decontaminate": "decontaminate",
    "op4_ngram_join": "jaccard",
    "op5_lm_score": "lm",
    "op6_substrings": "substrings",
    "op7_line_dedup": "lines",
    "op8_quality": "quality",
    "op9_bpe": "bpe",
    "op10_token_counts": "rollup",
    "op11_lexical_search": "search",
    "op12_prefix_trie": "prefix_trie",
    "op13_warc": "warc",
}


def _module(name: str):
    return import_module(f"{__package__}.{MODULES[name]}")


def llm_queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def llm_oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(name), "ORACLE_SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
