"""Known modifications: what they are called, what they weigh and where they sit."""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

MASS_TOLERANCE = 1e-3


class Known(NamedTuple):
    accession: str
    name: str
    other: str | None
    mass: float
    sites: tuple[str, ...]
    position: str


# Accession, name, other name, monoisotopic mass, sites, position.
TABLE = (
    Known("UNIMOD:1", "Acetyl", "Acetylation", 42.010565, ("N-term",), "N-term"),
    Known("UNIMOD:4", "Carbamidomethyl", "Carbamidomethylation", 57.021464, ("C",), "Anywhere"),
    Known("UNIMOD:7", "Deamidated", "Deamidation", 0.984016, ("N", "Q"), "Anywhere"),
    Known("UNIMOD:21", "Phospho", None, 79.966331, ("S", "T", "Y"), "Anywhere"),
    Known("UNIMOD:27", "Glu->pyro-Glu", None, -18.010565, ("E",), "N-term"),
    Known("UNIMOD:28", "Gln->pyro-Glu", None, -17.026549, ("Q",), "N-term"),
    Known("UNIMOD:35", "Oxidation", None, 15.994915, ("M",), "Anywhere"),
    Known("UNIMOD:121", "GG", None, 114.042927, ("K",), "Anywhere"),
)
_CALLED = {call.lower(): k for k in reversed(TABLE) for call in (k.accession, k.name, k.other) if call}
_BY_MASS = sorted(TABLE, key=lambda k: k.mass)
_MASSES = [k.mass for k in _BY_MASS]


def unimod(identity: str) -> Known | None:
    """By accession, name, or a mass that fits only one."""
    fold = identity.strip().lower()
    if fold in _CALLED:
        return _CALLED[fold]
    try:
        mass = float(fold)
    except ValueError:
        return None
    near = [k for k in _BY_MASS[bisect_left(_MASSES, mass - MASS_TOLERANCE) :] if k.mass <= mass + MASS_TOLERANCE]
    if len(near) > 1:
        raise ValueError(f"mass {mass} fits several modifications: {[k.name for k in near]}")
    return near[0] if near else None
