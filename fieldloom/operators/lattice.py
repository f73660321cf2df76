"""Lattice-Boltzmann flow: nine populations f0..f8 in one row a cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import KEYS
from ..plans.expr import Expr, at, const, field, where
from ..plans.lower import Grid

#: Fixed values of the nine-velocity lattice: directions, weights, opposites.
CX = (0, 1, 0, -1, 0, 1, -1, -1, 1)
CY = (0, 0, 1, 0, -1, 1, 1, -1, -1)
WEIGHTS = (4 / 9, 1 / 9, 1 / 9, 1 / 9, 1 / 9, 1 / 36, 1 / 36, 1 / 36, 1 / 36)
OPPOSITE = (0, 3, 4, 1, 2, 7, 8, 5, 6)
NAMES = tuple(f"f{q}" for q in range(9))


@dataclass(frozen=True)
class Lattice:
    """Relaxation time, body force, and axes that are walled (others are periodic); solid: a column that is 1 in solid cells."""

    tau: float
    force: tuple[float, float] = (0.0, 0.0)
    walls: tuple[bool, bool] = (False, False)
    solid: str | None = None

    def __post_init__(self) -> None:
        if self.tau <= 0.5:
            raise ValidationError("Lattice", "tau must exceed one half")

    def moments(self) -> tuple[Expr, Expr, Expr]:
        """Density and velocity, with half the force."""
        f = [field(n) for n in NAMES]
        rho = sum(f[1:], f[0])
        ux = sum((CX[q] * f[q] for q in range(9) if CX[q]), const(0)) + 0.5 * self.force[0]
        uy = sum((CY[q] * f[q] for q in range(9) if CY[q]), const(0)) + 0.5 * self.force[1]
        return rho, ux / rho, uy / rho

    def _fluid(self, inside: Expr, else_: Expr) -> Expr:
        return inside if self.solid is None else where(field(self.solid) > 0, else_, inside)

    def collide(self, grid: Grid) -> Grid:
        """Relax towards equilibrium, with forcing; solid cells stay."""
        rho, ux, uy = self.moments()
        grid = grid.assign({"__rho": rho, "__ux": ux, "__uy": uy})
        rho, ux, uy = (field(n) for n in ("__rho", "__ux", "__uy"))
        fx, fy = self.force
        square, out = ux * ux + uy * uy, {}
        for q, name in enumerate(NAMES):
            cu = CX[q] * ux + CY[q] * uy
            equilibrium = WEIGHTS[q] * rho * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * square)
            source = WEIGHTS[q] * (3 * ((CX[q] - ux) * fx + (CY[q] - uy) * fy) + 9 * cu * (CX[q] * fx + CY[q] * fy))
            f = field(name)
            out[name] = self._fluid(f - (f - equilibrium) / self.tau + (1 - 0.5 / self.tau) * source, f)
        made = grid.assign(out)
        return made.with_df(made.df.drop("__rho", "__ux", "__uy"))

    def stream(self, grid: Grid) -> Grid:
        """Pull populations from upstream; from walls and solid cells the opposite one bounces back."""
        out = {}
        for q, name in enumerate(NAMES):
            source = (-CX[q], -CY[q], 0)
            pulled, back = at(name, source), field(NAMES[OPPOSITE[q]])
            blocked = const(0)
            for axis, n in enumerate(grid.mesh.n[:2]):
                if self.walls[axis] and source[axis]:
                    coordinate = Expr("coord", (), (axis, source[axis]))
                    lo, hi = grid.mesh.origin[axis], grid.mesh.origin[axis] + n * grid.mesh.d[axis]
                    blocked = (coordinate < lo) | (coordinate > hi) if blocked.op == "const" else blocked | (coordinate < lo) | (coordinate > hi)
            if self.solid is not None:
                wall = at(self.solid, source) > 0
                blocked = wall if blocked.op == "const" else blocked | wall
            moved = pulled if blocked.op == "const" else where(blocked, back, pulled)
            out[name] = self._fluid(moved, field(name))
        return grid.assign(out)

    def macroscopic(self, grid: Grid) -> DataFrame:
        """rho, ux, uy; 1, 0, 0 in solid cells."""
        rho, ux, uy = self.moments()
        return grid.select({"rho": self._fluid(rho, const(1)), "ux": self._fluid(ux, const(0)), "uy": self._fluid(uy, const(0))})

    @staticmethod
    def equilibrium(rho: Expr, ux: Expr, uy: Expr) -> dict[str, Expr]:
        square, out = ux * ux + uy * uy, {}
        for q, name in enumerate(NAMES):
            cu = CX[q] * ux + CY[q] * uy
            out[name] = WEIGHTS[q] * rho * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * square)
        return out


def open_side(grid: Grid, axis: int, side: int, velocity: DataFrame | None = None, density: float | None = None) -> Grid:
    """Velocity inlet (a table of the tangential index, un, ut; un inwards) or pressure outlet on one side.

    Unknown populations follow from the known ones: the normal one keeps
    the non-equilibrium part of its opposite, diagonals take what the
    tangential momentum needs.
    """
    if (velocity is None) == (density is None):
        raise ValidationError("open_side", "give a velocity profile or a density")
    key, other = KEYS[axis], KEYS[1 - axis]
    last = 0 if side < 0 else grid.mesh.n[axis] - 1
    c, t = (CX, CY) if axis == 0 else (CY, CX)
    inward = -side
    df = grid.df
    if velocity is not None:
        df = df.join(F.broadcast(velocity.select(F.col(other).alias("__t"), F.col("un").cast("double").alias("__un"), F.col("ut").cast("double").alias("__ut"))), F.col(other) == F.col("__t"), "left").drop("__t")
    f = [F.col(n) for n in NAMES]
    along = sum((f[q] for q in range(9) if c[q] == 0), F.lit(0.0))
    outgoing = sum((f[q] for q in range(9) if c[q] == -inward), F.lit(0.0))
    if velocity is not None:
        un, ut = F.coalesce("__un", F.lit(0.0)), F.coalesce("__ut", F.lit(0.0))
        rho = (along + 2 * outgoing) / (1 - un)
    else:
        rho, ut = F.lit(float(density)), F.lit(0.0)
        un = 1 - (along + 2 * outgoing) / rho
    sideways = sum((t[q] * f[q] for q in range(9) if c[q] == 0 and t[q]), F.lit(0.0))
    new, edge = {}, F.col(key) == last
    for q in range(9):
        if c[q] != inward:
            continue
        back = f[OPPOSITE[q]]
        value = back + (2.0 / 3.0) * rho * un if t[q] == 0 else back + rho * un / 6.0 + t[q] * (0.5 * rho * ut - 0.5 * sideways)
        new[NAMES[q]] = F.when(edge, value).otherwise(f[q])
    return grid.with_df(df.withColumns(new).drop("__un", "__ut"))
