"""Importing this module registers the training-data queries."""

from importlib import import_module

from formbook.llm.common import ORACLES, QUERIES

MODULES = ("separators", "packing", "language", "bpe", "quality", "licenses", "transport", "toxicity", "simhash", "chat", "repair", "urls", "spelling")

for _name in MODULES:
    import_module(f"formbook.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
