"""All registered queries, grouped by family."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

FAMILIES = ("scalars", "coverage", "contest", "ledger", "runs", "network", "pixels", "profiles", "streams")


def load():
    """(queries, oracle SQL), with every family module imported once."""
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return dict(QUERIES), dict(ORACLES)
