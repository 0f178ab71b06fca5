"""All detectors by name: what they read, what they return, how they are made.

``make(name, **settings)`` gives an unfitted detector.  ``reads`` is the input column
(``v`` vectors or ``text``); ``returns`` is ``score`` (``score(df)`` -> id, score) or ``label``
(``predict(df)`` -> id and a decision)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from . import detectors as D
from . import gradient as G
from . import likelihood as LR
from . import sparse as SP
from . import text as TO


class Entry(NamedTuple):
    make: Callable
    reads: str = "v"
    returns: str = "score"


DETECTORS: dict[str, Entry] = {
    **{name: Entry(cls) for name, cls in D.REGISTRY.items()},
    **{cls.name: Entry(cls) for cls in (G.TrainedHead, G.TrainedDOC, G.KernelSVC)},
    "adb": Entry(D.ADB, returns="label"),
    "rake": Entry(TO.RakeDetector, "text", "label"),
    "likelihood_ratio": Entry(LR.LikelihoodRatio, "text"),
    **{cls.name: Entry(cls, "text") for cls in (SP.TextKNN, SP.TextCosineNN)},
}


def entry(name: str) -> Entry:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known: {sorted(DETECTORS)}")
    return DETECTORS[name]


def make(name: str, **settings):
    return entry(name).make(**settings)
