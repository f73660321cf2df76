"""Staggered values: one row for each face normal to an axis.

Faces along an axis are numbered 0 to n; face f lies between cells f - 1
and f. Face tables come from the cell table without a join: each cell gives
its low face, the last also its high one. Fluxes that only feed a
divergence are better assembled without a face table (`assembled`): both
sides of a cell evaluate the same expression, so sums telescope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import KEYS, Mesh
from ..plans.expr import Expr, const, field, shift, where
from ..plans.lower import Grid
from .stencils import step


def face_table(grid: Grid, axis: int, outputs: dict[str, Callable[[Callable[[int], Expr]], Expr]]) -> DataFrame:
    """Face values; each function gets n(by), the shift for cells by steps from the cell above the face, and is evaluated on all n + 1 faces."""
    low, high = {k: fn(lambda by: by) for k, fn in outputs.items()}, {k: fn(lambda by: by + 1) for k, fn in outputs.items()}
    both = {f"{k}__lo": e for k, e in low.items()} | {f"{k}__hi": e for k, e in high.items()}
    df, n, key = grid.select(both), grid.mesh.n[axis], KEYS[axis]
    one = lambda at, side: F.struct(at.alias("at"), *[F.col(f"{k}__{side}").alias(k) for k in outputs])
    rows = F.when(F.col(key) == n - 1, F.array(one(F.col(key), "lo"), one(F.col(key) + 1, "hi"))).otherwise(F.array(one(F.col(key), "lo")))
    return df.select(*KEYS, F.explode(rows).alias("f")).select(*[F.col("f.at").alias(k) if k == key else F.col(k) for k in KEYS], *[F.col(f"f.{k}").alias(k) for k in outputs])


def interpolate(grid: Grid, name: str, axis: int, scheme: str = "LinearGhost") -> DataFrame:
    """Means of the two cells; Nearest takes the only real cell on boundary faces."""
    f = field(name)
    if scheme not in ("LinearGhost", "Nearest"):
        raise ValidationError("interp", f"unknown scheme {scheme}")
    out = face_table(grid, axis, {name: lambda n: 0.5 * (shift(f, step(axis, n(-1))) + shift(f, step(axis, n(0))))})
    if scheme == "LinearGhost":
        return out
    key, last = KEYS[axis], grid.mesh.n[axis]
    edge = face_table(grid, axis, {"__a": lambda n: shift(f, step(axis, n(-1))), "__b": lambda n: shift(f, step(axis, n(0)))})
    return edge.select(*KEYS, F.when(F.col(key) == 0, F.col("__b")).when(F.col(key) == last, F.col("__a")).otherwise(0.5 * (F.col("__a") + F.col("__b"))).alias(name))


def face_gradient(grid: Grid, name: str, axis: int) -> DataFrame:
    """Normal differences on all faces; ghosts come from the field's boundary."""
    f, d = field(name), grid.mesh.d[axis]
    return face_table(grid, axis, {name: lambda n: (shift(f, step(axis, n(0))) - shift(f, step(axis, n(-1)))) / d})


def face_tangential(grid: Grid, name: str, axis: int, component: int) -> DataFrame:
    """Differences along another axis, averaged over the two cells."""
    f, d = field(name), grid.mesh.d[component]
    if axis == component:
        return face_gradient(grid, name, axis)

    def value(n: Callable[[int], int]) -> Expr:
        here = shift(f, step(component, 1)) - shift(f, step(component, -1))
        return 0.25 * (shift(here, step(axis, n(-1))) + shift(here, step(axis, n(0)))) / d

    return face_table(grid, axis, {name: value})


def face_pointwise(faces: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """Any function of face columns, on every face."""
    return faces.withColumns(outputs)


def divergence(mesh: Mesh, faces: dict[int, DataFrame], name: str, out: str = "div") -> DataFrame:
    """Sum over axes of (high - low) / d, for face tables by axis; each face is sent to its two cells and summed there."""
    total = None
    for axis, df in faces.items():
        key, n, d = KEYS[axis], mesh.n[axis], mesh.d[axis]
        ends = F.array(F.struct((F.col(key) - 1).alias("c"), (F.col(name) / d).alias("v")), F.struct(F.col(key).alias("c"), (-F.col(name) / d).alias("v")))
        part = df.select(*[k for k in KEYS if k != key], F.explode(ends).alias("e")).filter((F.col("e.c") >= 0) & (F.col("e.c") < n))
        part = part.select(*[F.col("e.c").alias(k) if k == key else F.col(k) for k in KEYS], F.col("e.v").alias("v"))
        total = part if total is None else total.unionByName(part)
    if total is None:
        raise ValidationError("divFace", "no faces")
    return total.groupBy(*KEYS).agg(F.sum("v").alias(out))


class Faces:
    """Expressions on the face between a cell and the next one along an axis."""

    def __init__(self, mesh: Mesh, axis: int):
        self.mesh, self.axis, self.ahead = mesh, axis, step(axis, 1)

    def interp(self, e: Expr) -> Expr:
        return 0.5 * (e + shift(e, self.ahead))

    def gradient(self, e: Expr, component: int | None = None) -> Expr:
        component = self.axis if component is None else component
        if component == self.axis:
            return (shift(e, self.ahead) - e) / self.mesh.d[component]
        if component >= self.mesh.dim:
            return const(0)
        here = shift(e, step(component, 1)) - shift(e, step(component, -1))
        return 0.25 * (here + shift(here, self.ahead)) / self.mesh.d[component]


def assembled(mesh: Mesh, flux: Callable[[Faces], Expr], gate: Expr | None = None) -> Expr:
    """Divergence of a flux given as a function of its face; gate: cells where it counts (others get 0, the flux itself is not masked)."""
    out = const(0)
    for axis in range(mesh.dim):
        high = flux(Faces(mesh, axis))
        out = out + (high - shift(high, step(axis, -1))) / mesh.d[axis]
    return out if gate is None else where(gate, out, 0.0)


def anti_trapping(mesh: Mesh, c_liquid: Expr, c_solid: Expr, phi: Expr, dphidt: Expr, strength: float, width: float, least: float = 1e-12) -> Expr:
    """Divergence of the current that stops solute trapping: strength * width (cl - cs) dphi/dt along the interface normal; 0 where the gradient vanishes."""

    def flux(f: Faces) -> Expr:
        g = [f.gradient(phi, axis) for axis in range(mesh.dim)]
        size = Expr("sqrt", (sum((x * x for x in g), const(0)),))
        amount = strength * width * (f.interp(c_liquid) - f.interp(c_solid)) * f.interp(dphidt)
        return where(size > least, amount * g[f.axis] / where(size > least, size, 1.0), 0.0)

    return assembled(mesh, flux)
