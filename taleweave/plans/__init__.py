"""Registered queries: each module applies operators to the supplied tables and gives the equivalent SQL."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("web", "text", "timeline", "match", "ledger", "numbers", "sequential", "contracts", "files", "chapters", "audit")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
