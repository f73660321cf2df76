"""Fields made from expressions and names."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..mesh import AXES, Mesh
from ..operators.boundary import Boundary
from ..operators.noise import uniform01
from ..plans.expr import Expr, call, const, coord
from ..plans.lower import Grid


def make(spark: SparkSession, mesh: Mesh, fields: dict[str, Expr | str], boundary: Boundary | None = None, boundaries: dict[str, Boundary] | None = None, params: dict[str, float] | None = None) -> Grid:
    """A grid with analytic fields, or named ones: uniform:v, random:lo:hi, linear:axis:lo:hi."""
    grid = Grid(mesh.frame(spark), mesh, boundaries or {}, boundary or Boundary())
    exprs = {k: v for k, v in fields.items() if isinstance(v, Expr)}
    if exprs:
        grid = grid.assign(exprs, params)
    for k, v in fields.items():
        if not isinstance(v, Expr):
            grid = grid.with_df(grid.df.withColumn(k, named(v, mesh, k)))
    return grid


def named(spec: str, mesh: Mesh, name: str = ""):  # noqa: ANN201
    """The column of a named initialisation."""
    kind, *rest = spec.split(":")
    try:
        if kind == "uniform":
            return F.lit(float(rest[0]))
        if kind == "random":
            lo, hi = map(float, rest)
            return F.lit(lo) + F.lit(hi - lo) * uniform01(sum(map(ord, name)))
        if kind == "linear":
            axis, lo, hi = AXES.index(rest[0]), float(rest[1]), float(rest[2])
            if axis >= mesh.dim:
                raise ConfigError("init", f"the mesh has no axis {rest[0]}")
            return (mesh.coordinate(axis) - F.lit(mesh.origin[axis])) / F.lit(mesh.n[axis] * mesh.d[axis]) * F.lit(hi - lo) + F.lit(lo)
    except (ValueError, IndexError) as e:
        raise ConfigError("init", f"bad arguments in {spec}") from e
    raise ConfigError("init", f"unknown kind {kind}", "uniform, random or linear")


# initial conditions of the benchmark problems; coefficients are fixed values


def _waves(c0: float, e: float, first: float) -> Expr:
    x, y, cos = coord(0), coord(1), lambda a: call("cos", a)
    square = cos(0.13 * x) * cos(0.087 * y)
    return c0 + e * (cos(first * x) * cos(0.11 * y) + square * square + cos(0.025 * x - 0.15 * y) * cos(0.07 * x - 0.02 * y))


def spinodal(c0: float = 0.5, e: float = 0.01) -> Expr:
    """Composition of the spinodal benchmark."""
    return _waves(c0, e, 0.105)


def ripening(grains: int = 4) -> dict[str, Expr]:
    """Composition and order parameters eta1, eta2, ... of the coarsening benchmark."""
    x, y, cos = coord(0), coord(1), lambda a: call("cos", a)
    out = {"c": _waves(0.5, 0.05, 0.105)}
    for k in range(1, grains + 1):
        beat = cos((0.046 + 0.001 * k) * x + (0.0405 + 0.001 * k) * y) * cos((0.031 + 0.001 * k) * x - (0.004 + 0.001 * k) * y)
        inner = cos(0.01 * k * x - 4.0) * cos((0.007 + 0.01 * k) * y) + cos((0.11 + 0.01 * k) * x) * cos((0.11 + 0.01 * k) * y) + 1.5 * beat * beat
        out[f"eta{k}"] = 0.1 * inner * inner
    return out


def charged() -> Expr:
    """Composition of the electrochemical benchmark."""
    return _waves(0.5, 0.04, 0.2)


def dendrite_seed(x0: float = 0.0, y0: float = 0.0, radius: float = 8.0, undercooling: float = 0.3) -> dict[str, Expr]:
    """A solid seed in a uniformly undercooled melt."""
    r = Expr("hypot", (coord(0) - x0, coord(1) - y0))
    return {"phi": call("tanh", (radius - r) / math.sqrt(2.0)), "u": const(-undercooling)}


def precipitate(x0: float, y0: float, radius: float = 20.0, matrix: float = 0.0065) -> Expr:
    """A round precipitate whose interface is 5 wide between 0.05 and 0.95."""
    return disc(radius, x0, y0, 1.0, matrix, 5.0 / (2.0 * math.atanh(0.9)))


def disc(radius: float, x0: float, y0: float, inside: float, outside: float, width: float = 1.0) -> Expr:
    """A smooth disc."""
    x, y = coord(0) - x0, coord(1) - y0
    r = Expr("hypot", (x, y))
    return 0.5 * (inside + outside) - 0.5 * (inside - outside) * call("tanh", (r - radius) / width)


def seeds(places: list[tuple[float, float, float]], inside: float, outside: float, width: float = 1.0) -> Expr:
    """The largest of several discs, given as (x, y, radius)."""
    out = const(outside)
    for x, y, r in places:
        out = Expr("max", (out, disc(r, x, y, inside, outside, width)))
    return out
