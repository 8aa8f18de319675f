"""Import every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cleaning", "history", "stats", "encoding", "models", "reports")


def load() -> None:
    for name in MODULES:
        import_module(f"checks.{name}")
