"""Every runnable query, grouped by theme; importing a theme registers its queries."""

from __future__ import annotations

import importlib

from pitpanel.plans.registry import REGISTRY, Entry

THEMES = ["calendar", "pointintime", "quality", "features", "forecast", "regression", "gaps", "sources", "anchor", "dynamics", "refresh"]


def registry() -> dict[str, Entry]:
    for theme in THEMES:
        importlib.import_module(f"pitpanel.plans.{theme}")
    return dict(REGISTRY)
