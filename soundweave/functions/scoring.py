"""Score weights."""

from __future__ import annotations

from dataclasses import dataclass, fields

COMPONENTS = ("phonetic", "embedding", "mora", "coda", "vowel", "familiarity", "containment")


@dataclass(frozen=True)
class Weights:
    phonetic: float = 0.0
    embedding: float = 0.0
    mora: float = 0.0
    coda: float = 0.0
    vowel: float = 0.0
    familiarity: float = 0.0
    containment: float = 0.0

    def normalized(self) -> Weights:
        """Weights of the same proportions that add up to 1."""
        values = [getattr(self, f.name) for f in fields(self)]
        total = sum(values)
        if total <= 0:
            raise ValueError("weights must add up to more than 0")
        return Weights(*[v / total for v in values])


# The presets, in the order of COMPONENTS.
PRESETS = {
    "pun": Weights(0.50, 0.15, 0.05, 0.10, 0.05, 0.25, 0.12),
    "rhyme": Weights(0.20, 0.10, 0.10, 0.35, 0.20, 0.10, 0.0),
    "mishearing": Weights(0.65, 0.20, 0.10, 0.03, 0.02, 0.0, 0.06),
}


def weights_of(preset: str = "pun", weights: Weights | None = None) -> Weights:
    if weights is None:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}; there are {', '.join(PRESETS)}")
        weights = PRESETS[preset]
    return weights.normalized()
