"""Collects every registered query and its check SQL."""

import importlib
import importlib.util

from bidlens.plans import registry, shared_sql  # noqa: F401

PARTS = [
    "q_analytics", "q_metrics", "q_sources", "q_text", "q_retrieval", "q_personal",
    "q_sessions", "q_ranking", "q_training", "q_streams",
]


def _load():
    for part in PARTS:
        name = f"bidlens.plans.{part}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return registry.all_oracles()
