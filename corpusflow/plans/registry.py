"""Queries by name and the SQL that each is compared with; the operator modules fill both."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def load() -> None:
    """Import the modules that hold operators."""
    from corpusflow.operators import load as operators
    from corpusflow.plans import adapters  # noqa: F401

    operators()
