"""Frozen weights that are applied to another catalogue of features, by name and with a digest.

A document of weights carries the SHA-256 of its names and values in a canonical
form.  Weights are aligned by feature name, never by position, so they hold for
catalogues of other sizes and orders; anything that doesn't fit stops the run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence


def weights_digest(weights: Mapping[str, float]) -> str:
    text = json.dumps({k: float(v) for k, v in weights.items()}, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def freeze(weights: Mapping[str, float]) -> dict:
    """{"weights", "sha256"}; a negative weight or none above 0 is an error."""
    if min(weights.values(), default=0.0) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights are not negative and not all zero")
    return {"weights": dict(weights), "sha256": weights_digest(weights)}


def aligned(document: Mapping, catalogue: Sequence[str], leave_out: Sequence[str] = ()) -> list[float]:
    """The weights in the order of ``catalogue``.  A document that was changed, a feature
    without weight, and a weight without feature that isn't in ``leave_out`` are errors."""
    weights = document["weights"]
    if weights_digest(weights) != document["sha256"]:
        raise ValueError("the weights are not those that were frozen")
    unknown = sorted(set(catalogue) - set(weights))
    unused = sorted(set(weights) - set(catalogue) - set(leave_out))
    if len(set(catalogue)) != len(catalogue) or unknown or unused:
        raise ValueError(f"catalogues differ: without weight {unknown}, without feature {unused}")
    return [float(weights[f]) for f in catalogue]
