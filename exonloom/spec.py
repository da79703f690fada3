"""Site types and the constants of the models."""

from __future__ import annotations

from dataclasses import dataclass

#: Pseudo-count of the frequency tables, chi-square threshold and cap of dependency pairs, parents of a network node (fixed values).
PSEUDO = 0.5
DEPENDENCY_THRESHOLD = 6.0
MAX_PAIRS = 16
MAX_PARENTS = 2


@dataclass(frozen=True)
class SiteSpec:
    """A kind of site: windows of `window` symbols with `motif` at the 0-based `offset`."""

    name: str
    window: int
    motif: str
    offset: int


DONOR = SiteSpec("donor", 9, "GT", 3)
ACCEPTOR = SiteSpec("acceptor", 23, "AG", 20)


def site(name: str) -> SiteSpec:
    """The spec of a site name; ValueError for an unknown one."""
    for s in (DONOR, ACCEPTOR):
        if s.name == name:
            return s
    raise ValueError(f"unknown site type: {name!r}")
