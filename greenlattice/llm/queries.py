"""The queries of the training-data operators and their SQL."""

import importlib

from greenlattice.llm.common import ORACLES, QUERIES

for _module in ("quality_rules", "sharding", "chat", "bpe", "language_model", "near_dedup", "secrets", "url_filter", "html_text", "decontaminate", "exact_dedup", "token_alignment", "hard_negatives"):
    importlib.import_module(f"greenlattice.llm.{_module}")

__all__ = ["ORACLES", "QUERIES"]
