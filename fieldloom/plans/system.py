"""A set of definitions and evolutions over one grid, with a planner that orders, checks and reports them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field as attribute, replace

from ..errors import ConfigError, ValidationError
from ..operators.reduce import check_health
from ..sources.scratch import remove, stored
from .expr import Expr, field, halo, operators, samples
from .lower import Grid
from .schemes import Schemes, template


@dataclass
class System:
    """Auxiliary fields are defined by expressions, unknowns evolve by rates, external steps are functions Grid -> Grid.

    Auxiliaries are computed again only when something they read, or a
    resource they declare, has changed. The state is stored every
    store_every steps, so plans stay as large as those of a few steps.
    """

    grid: Grid
    schemes: Schemes = attribute(default_factory=Schemes)
    params: dict[str, float] = attribute(default_factory=dict)
    sequential: bool = False
    definitions: dict[str, Expr] = attribute(default_factory=dict)
    evolutions: dict[str, Expr] = attribute(default_factory=dict)
    before: list[tuple[str, Callable[[Grid], Grid]]] = attribute(default_factory=list)
    after: list[tuple[str, Callable[[Grid], Grid]]] = attribute(default_factory=list)
    resources: dict[str, set[str]] = attribute(default_factory=dict)
    versions: dict[str, int] = attribute(default_factory=dict)
    computed: dict[str, tuple] = attribute(default_factory=dict)
    step: int = 0
    time: float = 0.0
    store_every: int = 4
    path: str | None = None

    def define(self, name: str, e: Expr, resources: set[str] | None = None) -> None:
        self._writer(name)
        self.definitions[name] = self._bound(e)
        self.resources[name] = resources or set()

    def define_many(self, outputs: dict[str, Expr]) -> None:
        for name, e in outputs.items():
            self.define(name, e)

    def evolve(self, name: str, rate: Expr) -> None:
        self._writer(name)
        self.evolutions[name] = self._bound(rate)

    def _writer(self, name: str) -> None:
        if name in self.definitions or name in self.evolutions:
            raise ValidationError("System", f"{name} has two writers")

    def _bound(self, e: Expr) -> Expr:
        if self.grid.mesh.dim > 2:
            raise ValidationError("System", "needs a 1D or 2D mesh")
        e = self.schemes.bind(e, self.grid.mesh)
        for f, offset in samples(e):
            self.grid.boundary(f).certify(max(map(abs, offset)), self.grid.mesh.dim)
        return e

    def order(self) -> list[str]:
        """Definitions after what they read; a cycle is an error."""
        out, state = [], {}

        def visit(name: str) -> None:
            if state.get(name) == 1:
                raise ValidationError("System", f"the definitions form a cycle through {name}")
            if name not in state:
                state[name] = 1
                for f in sorted({f for f, _ in samples(self.definitions[name])} & self.definitions.keys()):
                    visit(f)
                state[name] = 2
                out.append(name)

        for name in sorted(self.definitions):
            visit(name)
        return out

    def touch(self, name: str) -> None:
        """Say that a field or resource changed from outside."""
        self.versions[name] = self.versions.get(name, 0) + 1

    def invalidate(self) -> None:
        self.computed.clear()

    def restore_clock(self, step: int, time: float) -> None:
        self.step, self.time = step, time
        self.invalidate()

    def refresh(self) -> list[str]:
        """Recompute stale auxiliaries; returns their names. Those of one level share one projection."""
        stale = []
        for name in self.order():
            reads = {f for f, _ in samples(self.definitions[name])} | self.resources[name]
            stamp = tuple(sorted((f, self.versions.get(f, 0)) for f in reads))
            if self.computed.get(name) != stamp or name not in self.grid.fields:
                self.versions[name] = self.versions.get(name, 0) + 1
                self.computed[name] = stamp
                stale.append(name)
        left = list(stale)
        while left:
            level = [n for n in left if not {f for f, _ in samples(self.definitions[n])} & set(left)]
            self.grid = self.grid.assign({n: self.definitions[n] for n in level}, self.params)
            left = [n for n in left if n not in level]
        return stale

    def advance(self, dt: float) -> None:
        """One Euler step of all unknowns, from one level or one after the other."""
        for _, fn in self.before:
            self.grid = fn(self.grid)
        if self.sequential:
            for name, rate in self.evolutions.items():
                self.refresh()
                self.grid = self.grid.assign({name: field(name) + dt * rate}, self.params)
                self.touch(name)
        else:
            self.refresh()
            self.grid = self.grid.assign({n: field(n) + dt * r for n, r in self.evolutions.items()}, self.params)
            for name in self.evolutions:
                self.touch(name)
        for _, fn in self.after:
            self.grid = fn(self.grid)
        self.step, self.time = self.step + 1, self.time + dt
        if self.step % self.store_every == 0:
            self.store()

    def store(self) -> None:
        """Write the state and go on from the table; the table before is removed."""
        df, new = stored(self.grid.df)
        if self.path:
            remove(df.sparkSession, self.path)
        self.grid, self.path = self.grid.with_df(df), new

    def advance_adaptive(self, dt: float, control) -> float:  # noqa: ANN001
        """A step whose size follows the largest rate; returns it."""
        from ..streaming.evolve import rates

        if self.sequential or self.before:
            raise ConfigError("System", "adaptive steps need one level and no steps before")
        self.refresh()
        dt = control.next(dt, max(rates(self.grid, self.evolutions, self.params).first()))
        self.advance(dt)
        if self.step % self.store_every:  # the next step looks at the whole state at once
            self.store()
        return dt

    def check(self, limit: float = float("inf")) -> None:
        check_health(self.grid.df, list(self.evolutions), limit, self.step, self.time)

    def report(self) -> str:
        """Order, reads and halos of every node as JSON."""
        nodes = {}
        for kind, own in (("definition", self.definitions), ("evolution", self.evolutions)):
            for name, e in own.items():
                width, corners = halo(e)
                nodes[name] = {"kind": kind, "reads": sorted({f for f, _ in samples(e)}), "halo": width, "corners": corners}
        return json.dumps({"order": self.order(), "nodes": nodes, "unused": self.schemes.unused()}, indent=2, sort_keys=True)


def preparation(exprs: dict[str, Expr]) -> str:
    """The scheme file that a set of equations needs."""
    return template(sorted({op for e in exprs.values() for op in operators(e)}))


def with_boundary(grid: Grid, **rules: object) -> Grid:
    return replace(grid, boundaries={**grid.boundaries, **rules})
