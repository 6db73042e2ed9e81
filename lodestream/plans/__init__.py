"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from lodestream.plans.registry import Registry


def registries() -> list[Registry]:
    """The registries of the core, in the order in which queries are listed."""
    from lodestream.plans import evaluate, hours, learned, problems, scores, words

    return [problems.REGISTRY, hours.REGISTRY, scores.REGISTRY, evaluate.REGISTRY, words.REGISTRY, learned.REGISTRY]
