"""The queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "toxicity", "pieces", "urls", "quality", "sharding", "chat", "decontam", "tokenfile", "langid", "embeddings", "repair", "trie")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"tidemark.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"tidemark.llm.{m}").ORACLES.items()}
