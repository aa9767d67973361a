"""All registered queries of the library (the training-data subpackage registers its own)."""

from __future__ import annotations

from lodestone.plans import q_eval, q_events, q_features, q_ml, q_pairs, q_stats, q_text, q_vectors  # noqa: F401
from lodestone.plans.registry import REGISTRY, Query


def reference_queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in REGISTRY.items()}


def reference_oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
