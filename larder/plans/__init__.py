"""Registered queries, by theme."""

import importlib

MODULES = ("relational", "temporal", "records", "documents", "clinical", "notes", "people", "facts", "orders", "reports")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"larder.plans.{name}")
