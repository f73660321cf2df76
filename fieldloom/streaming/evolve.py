"""Time integration: each step is one projection; states are stored every few steps to end their lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attribute, replace

from pyspark.sql import functions as F

from ..errors import ConfigError, NumericsError, ValidationError
from ..operators.reduce import check_health
from ..operators.solvers import System, conjugate_gradient, laplace
from ..plans.expr import Expr, const, field
from ..plans.lower import Grid
from ..sources.scratch import remove, stored

Callback = Callable[[int, float, Grid], None]


@dataclass
class Clock:
    """Step count and time, kept over restarts."""

    step: int = 0
    time: float = 0.0

    def advance(self, dt: float) -> None:
        self.step, self.time = self.step + 1, self.time + dt


def due(step: int, every: int) -> bool:
    """Whether something with this interval happens at a step."""
    if every <= 0:
        raise ConfigError("cadence", "intervals must be positive")
    return step % every == 0


def euler_step(grid: Grid, rhs: dict[str, Expr], dt: float, params: dict[str, float] | None = None, previous: bool = False) -> Grid:
    """All fields move at once, from the same state; previous: keep the old values as name__prev."""
    new = {k: field(k) + dt * e for k, e in rhs.items()}
    if previous:
        new |= {f"{k}__prev": field(k) for k in rhs}
    return grid.assign(new, params)


def sequential_step(grid: Grid, steps: list[tuple[str, Expr, bool]], dt: float, params: dict[str, float] | None = None) -> Grid:
    """One after the other, later ones see earlier results: (field, expression, transient); without transient the expression is the new value."""
    for name, e, transient in steps:
        grid = grid.assign({name: field(name) + dt * e if transient else e}, params)
    return grid


def rk4_step(grid: Grid, rhs: dict[str, Expr], dt: float, params: dict[str, float] | None = None) -> Grid:
    """Classical fourth order; every stage's fields get the fields' boundaries."""
    from ..plans.expr import at, transformed

    keep, stage, slopes = grid.fields, dict.fromkeys(rhs), []
    rules = {f"__s_{k}": grid.boundary(k) for k in rhs}
    grid = replace(grid, boundaries={**grid.boundaries, **rules})
    for n, weight in enumerate((0.0, 0.5, 0.5, 1.0)):
        if n:
            stage = {k: f"__s_{k}" for k in rhs}
            grid = grid.assign({f"__s_{k}": field(k) + (weight * dt) * field(slopes[-1][k]) for k in rhs})

        def staged(e: Expr) -> Expr | None:
            return at(stage[e.payload[0]], e.payload[1]) if e.op == "sample" and stage.get(e.payload[0]) else None  # noqa: B023

        grid = grid.assign({f"__k{n}_{k}": transformed(e, staged) for k, e in rhs.items()}, params)
        slopes.append({k: f"__k{n}_{k}" for k in rhs})
    total = {k: field(k) + (dt / 6) * (field(slopes[0][k]) + 2 * field(slopes[1][k]) + 2 * field(slopes[2][k]) + field(slopes[3][k])) for k in rhs}
    out = grid.assign(total)
    return out.with_df(out.df.select("i", "j", "k", *keep))


@dataclass(frozen=True)
class AdaptiveDt:
    """dt from the largest rate of change: safety tol / rate, growth limited, then clamped; the lower clamp wins."""

    tol: float
    dt_min: float
    dt_max: float
    safety: float = 0.9
    grow: float = 1.2

    def next(self, dt: float, rate: float) -> float:
        if rate != rate or rate in (float("inf"), float("-inf")):
            raise NumericsError("AdaptiveDt", f"the rate is not finite: {rate}")
        target = self.dt_max if rate == 0 else self.safety * self.tol / rate
        return max(min(target, dt * self.grow, self.dt_max), self.dt_min)


def rates(grid: Grid, rhs: dict[str, Expr], params: dict[str, float] | None = None):  # noqa: ANN201
    """One row with the largest |rhs| of each field."""
    return grid.select({f"rate_{k}": e for k, e in rhs.items()}, params).agg(*[F.max(F.abs(f"rate_{k}")).alias(f"rate_{k}") for k in rhs])


@dataclass
class Run:
    """A time loop: scheme "euler" or "rk4", storing, health checks and callbacks by interval."""

    rhs: dict[str, Expr]
    dt: float
    scheme: str = "euler"
    params: dict[str, float] = attribute(default_factory=dict)
    store_every: int = 4
    health_every: int = 100
    limit: float = float("inf")
    adaptive: AdaptiveDt | None = None
    callbacks: list[tuple[int, Callback]] = attribute(default_factory=list)
    clock: Clock = attribute(default_factory=Clock)
    history: list[float] = attribute(default_factory=list)

    def __post_init__(self) -> None:
        if self.scheme not in ("euler", "rk4"):
            raise ConfigError("Run", f"unknown scheme {self.scheme}", "euler or rk4")
        if self.adaptive and self.scheme != "euler":
            raise ValidationError("Run", "adaptive steps need euler")

    def advance(self, grid: Grid, steps: int) -> Grid:
        spark, old = grid.df.sparkSession, None
        for n in range(steps):
            if self.adaptive:
                largest = max(rates(grid, self.rhs, self.params).first())
                self.dt = self.adaptive.next(self.dt, largest)
            grid = euler_step(grid, self.rhs, self.dt, self.params) if self.scheme == "euler" else rk4_step(grid, self.rhs, self.dt, self.params)
            self.clock.advance(self.dt)
            self.history.append(self.dt)
            if (n + 1) % self.store_every == 0 or self.adaptive:
                df, path = stored(grid.df)
                if old:
                    remove(spark, old)
                grid, old = grid.with_df(df), path
            if self.health_every and self.clock.step % self.health_every == 0:
                check_health(grid.df, list(self.rhs), self.limit, self.clock.step, self.clock.time)
            for every, call in self.callbacks:
                if due(self.clock.step, every):
                    call(self.clock.step, self.clock.time, grid)
        return grid


def imex_step(grid: Grid, name: str, diffusivity: float, dt: float, explicit: Expr | None = None, **how: object) -> Grid:
    """(I - dt D lap) new = old + dt N(old)."""
    with_b = grid.assign({"__b": field(name) + dt * (explicit if explicit is not None else const(0))})
    got = conjugate_gradient(with_b, name, "__b", System(laplace(grid.mesh, diffusivity), 1.0, dt), **how).grid
    return got.with_df(got.df.drop("__b"))
