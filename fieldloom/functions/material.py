"""Material and thermodynamic functions, as expressions, columns or plain numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, NumericsError, ValidationError
from ..plans.expr import Expr, Number, power

GAS = 8.314462618


def h_cubic(x: Expr | Column | Number):  # noqa: ANN201
    return x * x * (3.0 - 2.0 * x)


def h_cubic_prime(x):  # noqa: ANN001, ANN201
    return 6.0 * x * (1.0 - x)


def h_quintic(x):  # noqa: ANN001, ANN201
    return x * x * x * (x * (6.0 * x - 15.0) + 10.0)


def h_quintic_prime(x):  # noqa: ANN001, ANN201
    return 30.0 * x * x * (1.0 - x) * (1.0 - x)


def double_well(x):  # noqa: ANN001, ANN201
    return x * x * (1.0 - x) * (1.0 - x)


def double_well_prime(x):  # noqa: ANN001, ANN201
    return 2.0 * x * (1.0 - x) * (1.0 - 2.0 * x)


def interpolant(kind: str):  # noqa: ANN201
    try:
        return {"cubic": h_cubic, "quintic": h_quintic}[kind]
    except KeyError:
        raise ConfigError("interpolant", f"unknown kind {kind}", "cubic or quintic") from None


@dataclass(frozen=True)
class KKS:
    """Two parabolic phases: f_s = k_s/2 (c - cs0)^2 + es, likewise for the liquid."""

    ks: float
    kl: float
    cs0: float
    cl0: float
    es: float = 0.0
    el: float = 0.0

    def mu(self, c, h):  # noqa: ANN001, ANN201
        """Common diffusion potential at composition c and solid weight h."""
        return (c - h * self.cs0 - (1.0 - h) * self.cl0) / (h / self.ks + (1.0 - h) / self.kl)

    def partition(self, c, h):  # noqa: ANN001, ANN201
        """(mu, solid composition, liquid composition)."""
        mu = self.mu(c, h)
        return mu, self.cs0 + mu / self.ks, self.cl0 + mu / self.kl

    def dmu_dc(self, h):  # noqa: ANN001, ANN201
        return 1.0 / (h / self.ks + (1.0 - h) / self.kl)

    def driving_force(self, c, h):  # noqa: ANN001, ANN201
        mu, cs, cl = self.partition(c, h)
        fs = 0.5 * self.ks * (cs - self.cs0) * (cs - self.cs0) + self.es
        fl = 0.5 * self.kl * (cl - self.cl0) * (cl - self.cl0) + self.el
        return fl - fs - mu * (cl - cs)

    def equilibrium(self) -> tuple[float, float, float]:
        """(mu, cs, cl) where the phases coexist: the root of smaller size of a quadratic."""
        a, b, c = 0.5 / self.ks - 0.5 / self.kl, self.cs0 - self.cl0, self.el - self.es
        if abs(a) < 1e-300:
            if b == 0:
                raise NumericsError("KKS", "the phases have no common tangent")
            roots = [-c / b]
        else:
            disc = b * b - 4 * a * c
            if disc < 0:
                raise NumericsError("KKS", "no real equilibrium")
            roots = [(-b + s * math.sqrt(disc)) / (2 * a) for s in (-1, 1)]
        mu = min(roots, key=abs)
        return mu, self.cs0 + mu / self.ks, self.cl0 + mu / self.kl


def f_tau(tau: float) -> float:
    """Magnetic-like ordering function of the reduced temperature."""
    if tau < 0:
        raise ValidationError("f_tau", "needs tau >= 0")
    if tau < 1:
        return 1 - (79 / (140 * 0.55 * tau) + 474 / 497 * (1 / 0.55 - 1) * (tau**3 / 6 + tau**9 / 135 + tau**15 / 600)) / _ORDER if tau > 0 else 1.0
    return -(tau**-5 / 10 + tau**-15 / 315 + tau**-25 / 1500) / _ORDER


_ORDER = 518 / 1125 + 11692 / 15975 * (1 / 0.55 - 1)


def amorphous_to_liquid(temperature: float, glass: float, alpha: float, molar_volume: float) -> float:
    """Free-energy difference by volume."""
    return GAS * temperature * math.log(1 + alpha) * f_tau(temperature / glass) / molar_volume


@dataclass(frozen=True)
class Cooling:
    """Linear (K/s) or Newtonian (1/s towards the lowest) cooling, clamped."""

    start: float
    rate: float
    lowest: float
    highest: float
    kind: str = "linear"

    def temperature(self, time: float) -> float:
        if self.kind == "linear":
            t = self.start - self.rate * time
        elif self.kind == "newton":
            t = self.lowest + (self.start - self.lowest) * math.exp(-self.rate * time)
        else:
            raise ConfigError("Cooling", f"unknown kind {self.kind}", "linear or newton")
        return min(max(t, self.lowest), self.highest)


@dataclass(frozen=True)
class GrandPotential:
    """Two phases with parabolic free energies as functions of a chemical potential."""

    ks: float
    kl: float
    cs: float
    cl: float
    w: float

    def __post_init__(self) -> None:
        if min(self.ks, self.kl, self.w) <= 0:
            raise ValidationError("GrandPotential", "curvatures and barrier must be positive")

    def bulk(self, phi):  # noqa: ANN001, ANN201
        return self.w * double_well_prime(phi)

    def coupling(self, phi, mu):  # noqa: ANN001, ANN201
        """h'(phi) times the difference of the phases' grand potentials."""
        solid, liquid = -mu * mu / (2.0 * self.ks) - mu * self.cs, -mu * mu / (2.0 * self.kl) - mu * self.cl
        return h_quintic_prime(phi) * (solid - liquid)

    def composition(self, phi, mu):  # noqa: ANN001, ANN201
        h = h_quintic(phi)
        return h * (mu / self.ks + self.cs) + (1.0 - h) * (mu / self.kl + self.cl)


@dataclass(frozen=True)
class EnergyTable:
    """f(c, T) on uniform axes, bilinear and clamped; values[ic][iT]. Tables have a bounded, checked size."""

    values: tuple[tuple[float, ...], ...]
    c: tuple[float, float]
    t: tuple[float, float]

    MOST = 4_000_000

    def __post_init__(self) -> None:
        if len(self.values) == 1:
            object.__setattr__(self, "values", self.values * 2)
            object.__setattr__(self, "c", (0.0, 1.0))
        if len(self.values) * len(self.values[0]) > self.MOST or len({len(r) for r in self.values}) != 1:
            raise ValidationError("EnergyTable", "rows differ in length, or the table is too large")

    @property
    def _steps(self) -> tuple[float, float]:
        return (self.c[1] - self.c[0]) / (len(self.values) - 1), (self.t[1] - self.t[0]) / max(1, len(self.values[0]) - 1)

    def at(self, c: float, t: float) -> float:
        (dc, dt), nc, nt = self._steps, len(self.values), len(self.values[0])
        fc = (min(max(c, self.c[0]), self.c[1]) - self.c[0]) / dc
        ic = min(int(fc), nc - 2)
        wc = fc - ic
        if nt == 1:
            return (1 - wc) * self.values[ic][0] + wc * self.values[ic + 1][0]
        ft = (min(max(t, self.t[0]), self.t[1]) - self.t[0]) / dt
        it = min(int(ft), nt - 2)
        wt = ft - it
        v = self.values
        return (1 - wc) * ((1 - wt) * v[ic][it] + wt * v[ic][it + 1]) + wc * ((1 - wt) * v[ic + 1][it] + wt * v[ic + 1][it + 1])

    def frame(self, like: DataFrame) -> DataFrame:
        rows = [(a, b, float(x)) for a, r in enumerate(self.values) for b, x in enumerate(r)]
        return like.sparkSession.createDataFrame(rows, "ic int, iT int, f double")

    def lookup(self, c: Column, t: Column) -> Column:
        """The interpolated value as a column: four reads of one array literal."""
        (dc, dt), nc, nt = self._steps, len(self.values), len(self.values[0])
        flat = F.array(*[F.lit(float(x)) for r in self.values for x in r])
        clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
        fc = (clamp(c, *self.c) - F.lit(self.c[0])) / F.lit(dc)
        ic = F.least(F.floor(fc), F.lit(nc - 2)).cast("int")
        read = lambda a, b: F.get(flat, a * nt + b)
        if nt == 1:
            return (1 - (fc - ic)) * read(ic, F.lit(0)) + (fc - ic) * read(ic + 1, F.lit(0))
        ft = (clamp(t, *self.t) - F.lit(self.t[0])) / F.lit(dt)
        it = F.least(F.floor(ft), F.lit(nt - 2)).cast("int")
        wc, wt = fc - ic, ft - it
        return (1 - wc) * ((1 - wt) * read(ic, it) + wt * read(ic, it + 1)) + wc * ((1 - wt) * read(ic + 1, it) + wt * read(ic + 1, it + 1))

    def slope(self, c: Column, t: Column, axis: str = "c") -> Column:
        """Centred difference over half a table cell to each side, cut at the range's ends."""
        h = 0.5 * self._steps[0 if axis == "c" else 1]
        lo_end, hi_end = self.c if axis == "c" else self.t
        x = c if axis == "c" else t
        x = F.least(F.greatest(x, F.lit(float(lo_end))), F.lit(float(hi_end)))
        lo, hi = F.greatest(x - h, F.lit(float(lo_end))), F.least(x + h, F.lit(float(hi_end)))
        up, down = (self.lookup(hi, t), self.lookup(lo, t)) if axis == "c" else (self.lookup(c, hi), self.lookup(c, lo))
        return (up - down) / (hi - lo)

    def parabola(self, t: float, window: tuple[float, float]) -> tuple[float, float, float]:
        """(curvature, composition, energy) of a parabola through the lowest node in a window of compositions and its neighbours."""
        dc, n = self._steps[0], len(self.values)
        nodes = [(self.at(self.c[0] + i * dc, t), i) for i in range(1, n - 1) if window[0] <= self.c[0] + i * dc <= window[1]]
        if not nodes:
            raise NumericsError("parabola", "the window holds no inner node")
        i = min(nodes)[1]
        return self.parabola_at(self.c[0] + i * dc, t, vertex=True)

    def parabola_at(self, c0: float, t: float, vertex: bool = False) -> tuple[float, float, float]:
        """The second-order expansion at c0; vertex: move to its minimum."""
        h = self._steps[0]
        lo, mid, hi = (self.at(c0 + s * h, t) for s in (-1, 0, 1))
        k, slope = (lo - 2 * mid + hi) / h**2, (hi - lo) / (2 * h)
        if k <= 0:
            raise NumericsError("parabola", "the curvature is not positive")
        return (k, c0 - slope / k, mid - slope * slope / (2 * k)) if vertex else (k, c0, mid)


def mobility(table: EnergyTable | None, t: float, fallback: float) -> float:
    return table.at(0.5, t) if table else fallback


def pow_of(e: Expr, k: Number) -> Expr:
    return power(e, k)
