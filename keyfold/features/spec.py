"""Feature declarations: what to aggregate, over which keys, and what to put where no group matches."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

KINDS = ("count", "count_col", "distinct", "span", "stddev")


@dataclass(frozen=True)
class Feature:
    """One aggregate that is computed per key tuple and attached to every row with that tuple.

    kind: ``count`` rows, ``count_col`` non-null values of ``arg``, ``distinct`` values of ``arg``,
    ``span`` in days between the first and last ``arg`` date, ``stddev`` (sample) of ``arg``.
    fill: value for rows without a match, which includes rows with a NULL key; None keeps NULL.
    """

    name: str
    keys: tuple[str, ...]
    kind: str = "count"
    arg: str | None = None
    fill: Any = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown feature kind {self.kind!r}")
        if self.kind != "count" and self.arg is None:
            raise ValueError(f"{self.name}: kind {self.kind!r} needs an argument column")
        if not self.keys:
            raise ValueError(f"{self.name}: no key columns")


def by_key_set(features: list[Feature]) -> dict[frozenset[str], list[Feature]]:
    """Group features that share a key set (in any order), so each set is aggregated once."""
    groups: dict[frozenset[str], list[Feature]] = {}
    for feature in features:
        groups.setdefault(frozenset(feature.keys), []).append(feature)
    return groups
