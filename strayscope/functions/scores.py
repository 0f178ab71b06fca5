"""Score-function registry (name -> detector factory) with a duplicate check."""

from __future__ import annotations

from collections.abc import Callable

SCORE_FUNCTIONS: dict[str, Callable] = {}


def register_score(name: str):
    def deco(factory: Callable) -> Callable:
        if name in SCORE_FUNCTIONS:
            raise ValueError(f"score function {name!r} is already registered")
        SCORE_FUNCTIONS[name] = factory
        return factory
    return deco


def get_score(name: str, **kwargs):
    if name not in SCORE_FUNCTIONS:
        raise ValueError(f"unknown score function {name!r}; known: {sorted(SCORE_FUNCTIONS)}")
    return SCORE_FUNCTIONS[name](**kwargs)


def _register_builtins() -> None:
    from ..operators import detectors as D
    register_score("max")(D.LogitsMSPScore)
    register_score("entropy")(D.LogitsEntropyScore)
    register_score("mahalanobis")(D.ClassMahalanobis)
    register_score("euclidean")(D.ClassEuclidean)
    register_score("mahalanobis-pca")(D.ClassMahalanobisPCA)
    register_score("marginal-mahalanobis")(D.MarginalMahalanobis)
    register_score("marginal-mahalanobis-pca")(D.MarginalMahalanobisPCA)


_register_builtins()
