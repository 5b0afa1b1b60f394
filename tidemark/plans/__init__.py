"""Queries by name, and their SQL."""

from importlib import import_module

MODULES = ("features", "quality", "events", "joins", "states", "study", "shapes", "cycles", "picks", "outcomes", "reconcile", "trades", "stats", "replay", "zones", "sections", "platforms", "clusters", "fits", "phases", "exits")


def gathered(kind: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"tidemark.plans.{m}"), kind).items()}
