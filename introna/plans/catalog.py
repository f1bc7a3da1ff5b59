"""All registered queries."""

from __future__ import annotations

import importlib

from introna.plans.registry import ORACLES, QUERIES

AREAS = ["reference", "source", "count", "graph", "neighbor", "splice", "psi", "marker"]

for _area in AREAS:
    importlib.import_module(f"introna.plans.{_area}_queries")


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
