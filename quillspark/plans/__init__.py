"""Queries for the driver's contract and the SQL that checks them."""

from importlib import import_module

MODULES = ("texts", "retrieval", "judging", "corpus", "turns", "chunks", "models", "harness", "composed", "drafting", "vectors", "streams", "answering")


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    registry = import_module(f"{__name__}.registry")
    return registry.QUERIES, registry.ORACLE_SQL
