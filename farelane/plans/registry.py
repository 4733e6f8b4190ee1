"""Imports every module that registers queries."""

from importlib import import_module

MODULES = ("core", "expressions", "arrivals", "tables", "matching", "pairs", "files", "evidence")


def load() -> None:
    for name in MODULES:
        import_module(f"farelane.plans.{name}")
