"""Global reductions: one pass, partial sums in each task."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NumericsError, ValidationError
from ..plans.expr import Expr, where
from ..plans.lower import Grid
from .stencils import grad_squared


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


#: Aggregates of one column by name.
KINDS = {
    "max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg,
    "max_abs": lambda c: F.max(F.abs(c)), "sum_sq": lambda c: F.sum(c * c), "l2": lambda c: F.sqrt(F.sum(c * c)),
    "n_bad": lambda c: F.sum(F.when(finite(c), 0).otherwise(1)), "n": lambda c: F.count(c),
}


def reduced(df: DataFrame, wanted: dict[str, tuple[str, Column | str]], mask: Column | None = None) -> DataFrame:
    """One row; wanted: {output: (kind, column)}; mask: only cells where it holds."""
    df = df if mask is None else df.filter(mask)
    return df.agg(*[KINDS[kind](F.col(c) if isinstance(c, str) else c).alias(k) for k, (kind, c) in wanted.items()])


def dot(df: DataFrame, a: str, b: str, out: str = "dot") -> DataFrame:
    return df.agg(F.sum(F.col(a) * F.col(b)).alias(out))


def summary(df: DataFrame, name: str) -> DataFrame:
    """min, max, mean, L2 and the number of values that aren't finite."""
    return reduced(df, {k: (k, name) for k in ("min", "max", "mean", "l2", "n_bad")})


def functional(grid: Grid, outputs: dict[str, tuple[str, Expr]], params: dict[str, float] | None = None) -> DataFrame:
    """Reductions of expressions: {output: (kind, expression)}."""
    values = grid.select({k: e for k, (_, e) in outputs.items()}, params)
    return reduced(values, {k: (kind, k) for k, (kind, _) in outputs.items()})


def free_energy(grid: Grid, bulk: Expr, phi: Expr, kappa: float) -> DataFrame:
    """Cell volume times the sum of bulk energy and kappa / 2 |grad phi|^2, both by one aggregate."""
    return functional(grid, {"energy": ("sum", grid.mesh.volume * (bulk + (0.5 * kappa) * grad_squared(phi, grid.mesh)))})


def difference(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Largest and L2 difference of a field in two tables, by cell."""
    joined = a.select("i", "j", "k", F.col(name).alias("a")).join(b.select("i", "j", "k", F.col(name).alias("b")), ["i", "j", "k"])
    d = F.col("a") - F.col("b")
    return joined.agg(F.max(F.abs(d)).alias("max_diff"), F.sqrt(F.sum(d * d)).alias("l2_diff"))


def block_average(df: DataFrame, ratio: tuple[int, int, int], names: list[str]) -> DataFrame:
    """Means over aligned blocks of cells."""
    keys = [F.floor(F.col(k) / r).cast("int").alias(k) for k, r in zip("ijk", ratio, strict=True)]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def check_health(df: DataFrame, names: list[str], limit: float = math.inf, step: int | None = None, time: float | None = None) -> None:
    """Raise where a field holds NaN or infinity, or exceeds the limit; one aggregate for all fields."""
    wanted = {f"{c}__{k}": (k, c) for c in names for k in ("n_bad", "max_abs")}
    got = reduced(df, wanted).first().asDict()
    for c in names:
        where = f"field {c}" + (f", step {step}" if step is not None else "") + (f", t = {time}" if time is not None else "")
        if got[f"{c}__n_bad"]:
            raise NumericsError("health", f"{where}: {got[f'{c}__n_bad']} values are not finite")
        if (got[f"{c}__max_abs"] or 0) > limit:
            raise NumericsError("health", f"{where}: |value| {got[f'{c}__max_abs']} exceeds {limit}")


@dataclass
class HealthGuard:
    """Watched fields, and named conditions that must hold in every cell; all are looked at by one aggregate, every so many steps (0: never)."""

    fields: list[str] = field(default_factory=list)
    limit: float = math.inf
    every: int = 100
    conditions: dict[str, Expr] = field(default_factory=dict)

    def watch(self, *names: str) -> HealthGuard:
        self.fields += [n for n in names if n not in self.fields]
        return self

    def require(self, name: str, condition: Expr) -> HealthGuard:
        if name in self.conditions:
            raise ValidationError("HealthGuard", f"{name} is there already")
        self.conditions[name] = condition
        return self

    def report(self, grid: Grid, params: dict[str, float] | None = None) -> DataFrame:
        """One row: cells in which each field isn't finite, its largest size, and cells in which each condition fails."""
        made = grid.assign({f"__ok_{k}": where(e, 1.0, 0.0) for k, e in self.conditions.items()}, params) if self.conditions else grid
        wanted = {f"{c}__{k}": (k, c) for c in self.fields for k in ("n_bad", "max_abs")}
        wanted |= {f"{k}__failed": ("sum", F.when(F.col(f"__ok_{k}") > 0, 0).otherwise(1)) for k in self.conditions}
        return reduced(made.df, wanted)

    def check(self, grid: Grid, step: int, time: float = 0.0, params: dict[str, float] | None = None) -> bool:
        """Raise where something is wrong; False where nothing is due at this step."""
        if not self.every or step % self.every or not (self.fields or self.conditions):
            return False
        got = self.report(grid, params).first().asDict()
        at = f"step {step}, t = {time}"
        for c in self.fields:
            if got[f"{c}__n_bad"]:
                raise NumericsError("HealthGuard", f"field {c}, {at}: {got[f'{c}__n_bad']} values are not finite")
            if (got[f"{c}__max_abs"] or 0) > self.limit:
                raise NumericsError("HealthGuard", f"field {c}, {at}: |value| {got[f'{c}__max_abs']} exceeds {self.limit}")
        for k in self.conditions:
            if got[f"{k}__failed"]:
                raise NumericsError("HealthGuard", f"{k} fails in {got[f'{k}__failed']} cells, {at}")
        return True
