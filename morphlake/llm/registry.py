"""Queries of the training-data operators, by name, with SQL where it can express them."""

from __future__ import annotations

from morphlake.llm import chat_format, exact_dedup, mixing, packing, personal_data, pu_quality, quality_rules, secrets, simhash, token_files

_MODULES = (packing, pu_quality, quality_rules, secrets, personal_data, chat_format, mixing, simhash, exact_dedup, token_files)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
