"""Statuses and models: small immutable documents that travel to executors as literals."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from transcurve.functions.curves import Curve

VERSION = 1


class ModelError(ValueError):
    """A model or status family that can't be."""


def _names(names: Iterable[str]) -> tuple[str, ...]:
    out = tuple(names)
    if not out or len(set(out)) != len(out) or not all(out):
        raise ModelError("names must be distinct and not empty")
    return out


@dataclass(frozen=True)
class StatusFamily:
    """Categorical outcomes: which are reachable from which, and which can't be told apart."""

    names: tuple[str, ...]
    reachable: dict[str, tuple[str, ...]] = field(default_factory=dict)
    same: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", _names(self.names))
        for k, v in [*self.reachable.items(), *self.same.items()]:
            if not {k, *v} <= set(self.names):
                raise ModelError(f"unknown status near {k}")

    @classmethod
    def simple(cls, names: Iterable[str]) -> StatusFamily:
        """Every status reachable from every one, each distinguishable."""
        return cls(tuple(names))

    @classmethod
    def binary(cls, yes: str = "YES", no: str = "NO") -> StatusFamily:
        return cls((no, yes))

    def from_(self, status: str) -> tuple[str, ...]:
        return self.reachable.get(status, self.names)

    def same_as(self, status: str) -> tuple[str, ...]:
        return self.same.get(status, (status,))

    def restrict(self, allowed: Iterable[str]) -> StatusFamily:
        """The family in which only these statuses can be reached."""
        ok = set(allowed)
        return replace(self, reachable={s: tuple(x for x in self.from_(s) if x in ok) for s in self.names}, same={s: tuple(x for x in self.same_as(s) if x in ok or x == s) for s in self.names})

    def ordinal(self, status: str) -> int:
        return self.names.index(status)

    def fingerprint(self) -> str:
        """SHA-256 of the family's name list and relations: equal families have equal prints."""
        return hashlib.sha256(json.dumps([self.names, sorted(self.reachable.items()), sorted(self.same.items())]).encode()).hexdigest()


@dataclass(frozen=True)
class Entry:
    """A product of regressors or curves of them; with curves, for one status only.

    ``depth`` holds (regressor, curve or None); the empty product is the intercept.
    ``restrict`` is the reachable status (its index) that the entry serves, or -1.
    """

    depth: tuple[tuple[str, Curve | None], ...] = ()
    restrict: int = -1

    @property
    def curves(self) -> int:
        return sum(2 for _, c in self.depth if c)

    @property
    def is_flag(self) -> bool:
        return len(self.depth) == 1 and self.depth[0][1] is None


#: A user's filter: whether the beta of (reachable status, entry) is frozen.
Filter = Callable[["Model", int, int], bool]


@dataclass(frozen=True)
class Model:
    """A transition model out of one status: betas [reachable][entry] over the entries' weights.

    Entry 0 is the intercept. The row of the from-status, if it is reachable, stays 0.
    """

    status: str
    reachable: tuple[str, ...]
    entries: tuple[Entry, ...] = (Entry(),)
    betas: tuple[tuple[float, ...], ...] = ()
    same: tuple[tuple[int, ...], ...] = ()
    filters: tuple[Filter, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        n = len(self.entries)
        if not self.entries or self.entries[0].depth:
            raise ModelError("entry 0 is the intercept")
        if not self.betas:
            object.__setattr__(self, "betas", tuple((0.0,) * n for _ in self.reachable))
        if not self.same:
            object.__setattr__(self, "same", tuple((k,) for k in range(len(self.reachable))))
        if len(self.betas) != len(self.reachable) or any(len(b) != n for b in self.betas):
            raise ModelError("betas don't fit statuses and entries")
        for e in self.entries:
            if e.curves and e.restrict < 0:
                raise ModelError("a curve serves one status")
            if e.restrict >= 0 and self.reachable[e.restrict] == self.status:
                raise ModelError("the from-status takes no entry")

    @classmethod
    def create(cls, family: StatusFamily, status: str) -> Model:
        reach = family.from_(status)
        return cls(status, reach, same=tuple(tuple(i for i, x in enumerate(reach) if x in family.same_as(s)) for s in reach))

    # -- structure ---------------------------------------------------------------------------
    @property
    def origin(self) -> int:
        """Index of the from-status among the reachable ones, -1 if it isn't."""
        return self.reachable.index(self.status) if self.status in self.reachable else -1

    @property
    def regressors(self) -> tuple[str, ...]:
        return tuple(sorted({r for e in self.entries for r, _ in e.depth}))

    def flag_set(self) -> tuple[str, ...]:
        """Regressors that enter by themselves, without a curve."""
        return tuple(e.depth[0][0] for e in self.entries if e.is_flag)

    def frozen(self, k: int, e: int) -> bool:
        restrict = self.entries[e].restrict
        return k == self.origin or (restrict >= 0 and restrict != k) or any(f(self, k, e) for f in self.filters)

    @property
    def parameter_count(self) -> int:
        """Free betas of the structure plus curve parameters."""
        free = len(self.reachable) - (self.origin >= 0)
        return sum((1 if e.restrict >= 0 else free) + e.curves for e in self.entries)

    def index(self, depth: Sequence[tuple[str, Curve | None]], restrict: int = -1) -> int:
        """Place of an entry, -1 if there is none."""
        wanted = Entry(tuple(depth), restrict)
        return next((i for i, e in enumerate(self.entries) if e == wanted), -1)

    # -- edits, each a new model ---------------------------------------------------------------
    def add_beta(self, regressor: str) -> Model:
        """Add a regressor by itself; no change if it is there by itself."""
        return self if regressor in self.flag_set() else self.add_entry(Entry(((regressor, None),)))

    def add_entry(self, entry: Entry, beta: float = 0.0, intercept: float = 0.0) -> Model:
        """Append an entry; ``intercept`` is added to the intercept of the status it serves."""
        rows = []
        for k, row in enumerate(self.betas):
            mine = k == entry.restrict
            rows.append((row[0] + (intercept if mine else 0.0), *row[1:], beta if mine else 0.0))
        return replace(self, entries=(*self.entries, entry), betas=tuple(rows))

    def drop(self, *indices: int) -> Model:
        if 0 in indices:
            raise ModelError("the intercept can't be dropped")
        keep = [i for i in range(len(self.entries)) if i not in indices]
        return replace(self, entries=tuple(self.entries[i] for i in keep), betas=tuple(tuple(b[i] for i in keep) for b in self.betas))

    def drop_regressor(self, regressor: str) -> Model:
        """Drop the entries whose first part is this regressor."""
        return self.drop(*[i for i, e in enumerate(self.entries) if e.depth and e.depth[0][0] == regressor])

    def with_betas(self, betas: Sequence[Sequence[float]]) -> Model:
        return replace(self, betas=tuple(tuple(float(x) for x in b) for b in betas))

    def with_filters(self, *filters: Filter) -> Model:
        return replace(self, filters=(*self.filters, *filters))

    # -- packing -------------------------------------------------------------------------------
    def places(self) -> list[tuple[int, int, int, int]]:
        """(status, entry, depth, parameter) of each free parameter; depth -1 is the beta."""
        out = []
        for k in range(len(self.reachable)):
            for e, entry in enumerate(self.entries):
                if self.frozen(k, e):
                    continue
                out.append((k, e, -1, 0))
                if entry.restrict == k:
                    out += [(k, e, d, j) for d, (_, c) in enumerate(entry.depth) if c for j in range(2)]
        return out

    def pack(self) -> np.ndarray:
        get = lambda k, e, d, j: self.betas[k][e] if d < 0 else self.entries[e].depth[d][1].params[j]
        return np.array([get(*p) for p in self.places()], float)

    def unpack(self, theta: Sequence[float]) -> Model:
        betas = [list(b) for b in self.betas]
        params = {(e, d): list(c.params) for e, entry in enumerate(self.entries) for d, (_, c) in enumerate(entry.depth) if c}
        for (k, e, d, j), x in zip(self.places(), theta, strict=True):
            if d < 0:
                betas[k][e] = float(x)
            else:
                params[e, d][j] = float(x)
        entries = tuple(replace(entry, depth=tuple((r, Curve(c.type, tuple(params[e, d])) if c else None) for d, (r, c) in enumerate(entry.depth))) for e, entry in enumerate(self.entries))
        return replace(self, entries=entries, betas=tuple(tuple(b) for b in betas))

    # -- documents -----------------------------------------------------------------------------
    def to_json(self) -> str:
        entries = [{"depth": [{"regressor": r, "curve": {"type": c.type, "params": list(c.params)} if c else None} for r, c in e.depth], "restrict": e.restrict} for e in self.entries]
        return json.dumps({"version": VERSION, "status": self.status, "reachable": self.reachable, "same": self.same, "entries": entries, "betas": self.betas})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        if d.get("version") != VERSION:
            raise ModelError("unknown version")
        entries = tuple(Entry(tuple((p["regressor"], Curve(p["curve"]["type"], tuple(p["curve"]["params"])) if p["curve"] else None) for p in e["depth"]), e["restrict"]) for e in d["entries"])
        return cls(d["status"], tuple(d["reachable"]), entries, tuple(map(tuple, d["betas"])), tuple(map(tuple, d["same"])))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()
