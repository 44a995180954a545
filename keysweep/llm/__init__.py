"""Operators for preparing a training corpus, each with its registered query.

``QUERIES`` maps query names to (spark, sf_dir) functions, ``ORACLE`` to DuckDB SQL where SQL can express the query.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = ("suffix_dedup", "quality_rules", "jaccard", "ann", "html_text", "quality_model", "pieces", "packing", "token_counts", "hmm",
            "circulant", "filter_audit", "merkle")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"keysweep.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
