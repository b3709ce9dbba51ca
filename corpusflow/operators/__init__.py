"""Relational operators by family."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    from corpusflow import functions, sources, streaming

    for home in (__import__(__name__, fromlist=["x"]), functions, sources, streaming):
        for m in sorted(x.name for x in pkgutil.iter_modules(home.__path__)):
            importlib.import_module(f"{home.__name__}.{m}")
