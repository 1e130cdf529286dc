"""Registered queries: each pairs an operator run over the given tables with a SQL check."""

from __future__ import annotations

from importlib import import_module

from partwise.plans.registry import REGISTRY

MODULES = [
    "sources_sinks",
    "relational",
    "mapping_profile",
    "text_features",
    "linkage",
    "duplicates",
    "classification",
    "templates",
    "quality",
    "changes",
    "taxonomy",
    "training",
]


def load_all():
    for name in MODULES:
        import_module(f"partwise.plans.{name}")
    return REGISTRY
