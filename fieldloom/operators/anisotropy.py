"""Anisotropic interface operators: direction-dependent gradient energies in 2D and 3D."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..errors import ValidationError
from ..mesh import Mesh
from ..plans.expr import Expr, atan2, call, const, shift, where
from .stencils import first, step

#: Squared gradients up to this have no direction.
NO_DIRECTION = 1e-150


@dataclass(frozen=True)
class Anisotropy:
    """a(theta) = 1 + eps cos(m (theta - theta0)), width w0; cutoff: cells with |1 - phi^2| below it use the isotropic form."""

    w0: float = 1.0
    eps: float = 0.0
    m: int = 4
    theta0: float = 0.0
    scheme: str = "CD2"
    regularize: bool = False
    cutoff: float = 0.0

    def cone(self) -> tuple[float, float]:
        """(cos(m theta_m), amplitude) of the missing orientations, found by bisection; without any the cosine can't be reached."""
        e, m = self.eps, self.m
        if not self.regularize or e * (m * m - 1) <= 1:
            return 2.0, 0.0

        def bend(t: float) -> float:
            return (1 + e * math.cos(m * t)) * math.sin(t) - e * m * math.sin(m * t) * math.cos(t)

        lo, hi = 1e-12, math.pi / m
        for _ in range(200):
            mid = 0.5 * (lo + hi)
            lo, hi = (mid, hi) if bend(mid) < 0 else (lo, mid)
        return math.cos(m * lo), (1 + e * math.cos(m * lo)) / math.cos(lo)


def _direction(px: Expr, py: Expr, theta0: Expr, m: int) -> tuple[Expr, Expr]:
    angle = m * (atan2(py, px) - theta0)
    still = px * px + py * py <= NO_DIRECTION
    return where(still, 0.0, call("cos", angle)), where(still, 0.0, call("sin", angle))


def _factors(px: Expr, py: Expr, theta0: Expr, p: Anisotropy) -> tuple[Expr, Expr]:
    """a and s = -da/dtheta at a gradient's direction."""
    c, s = _direction(px, py, theta0, p.m)
    limit, size = p.cone()
    a, slope = 1 + p.eps * c, p.eps * p.m * s
    if limit <= 1:
        delta = atan2(s, c) / p.m
        a, slope = where(c > limit, size * call("cos", delta), a), where(c > limit, size * call("sin", delta), slope)
    return a, slope


def _face_normal(f: Expr, axis: int, mesh: Mesh, scheme: str) -> Expr:
    """Normal difference on the high face; Iso9 averages it over the neighbouring rows."""
    ahead, side = step(axis, 1), step(1 - axis, 1)
    d0 = shift(f, ahead) - f
    if scheme == "CD2":
        return d0 / mesh.d[axis]
    back = tuple(-x for x in side)
    return ((5.0 / 6.0) * d0 + (1.0 / 12.0) * (shift(d0, side) + shift(d0, back))) / mesh.d[axis]


def _high_flux(f: Expr, axis: int, mesh: Mesh, theta: Expr, p: Anisotropy) -> Expr:
    """Flux on the high face of each cell."""
    ahead, side = step(axis, 1), step(1 - axis, 1)
    back = tuple(-x for x in side)
    here = shift(f, side) - shift(f, back)
    pn = _face_normal(f, axis, mesh, p.scheme)
    pt = 0.25 * (here + shift(here, ahead)) / mesh.d[1 - axis]
    px, py = (pn, pt) if axis == 0 else (pt, pn)
    a, s = _factors(px, py, theta, p)
    return p.w0**2 * (a * (a * pn + (s if axis == 0 else -s) * pt))


def aniso_div(phi: Expr, mesh: Mesh, p: Anisotropy, theta: Expr | None = None) -> Expr:
    """Divergence of the anisotropic flux; theta: a field of orientations, read on the side with the larger phi (ties: the low side)."""
    if mesh.dim != 2:
        raise ValidationError("anisoDiv", "needs a 2D mesh", "use aniso_div_3d")
    out, plain = const(0), const(0)
    for axis in (0, 1):
        ahead, behind = step(axis, 1), step(axis, -1)
        own = const(p.theta0) if theta is None else where(shift(phi, ahead) > phi, shift(theta, ahead), theta)
        flux = _high_flux(phi, axis, mesh, own, p)
        out = out + (flux - shift(flux, behind)) / mesh.d[axis]
        normal = _face_normal(phi, axis, mesh, p.scheme)
        plain = plain + p.w0**2 * ((normal - shift(normal, behind)) / mesh.d[axis])
    return out if p.cutoff <= 0 else where(call("abs", 1 - phi * phi) < p.cutoff, plain, out)


def aniso_factor(phi: Expr, mesh: Mesh, p: Anisotropy, theta: Expr | None = None) -> Expr:
    """a(theta) at cell centres."""
    px, py = first(phi, 0, mesh, p.scheme), first(phi, 1, mesh, p.scheme)
    return _factors(px, py, const(p.theta0) if theta is None else theta, p)[0]


@dataclass(frozen=True)
class Anisotropy3D:
    """a = 1 - 3 eps + 4 eps sum(n^4), in a crystal frame given by a rotation (rows: crystal axes)."""

    w0: float = 1.0
    eps: float = 0.0
    rotation: tuple[float, ...] = field(default=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))

    def __post_init__(self) -> None:
        if self.w0 <= 0 or not 0 <= self.eps < 0.3:
            raise ValidationError("Anisotropy3D", "needs w0 > 0 and 0 <= eps < 0.3")
        r = self.rotation
        for a in range(3):
            for b in range(3):
                if abs(sum(r[3 * k + a] * r[3 * k + b] for k in range(3)) - (a == b)) > 1e-8:
                    raise ValidationError("Anisotropy3D", "the rotation is not orthonormal")

    @classmethod
    def euler(cls, phi1: float, big: float, phi2: float, w0: float = 1.0, eps: float = 0.0) -> Anisotropy3D:
        """Rotation about z, x and z again (Bunge): the product of three elementary rotations."""

        def turn(axis: int, t: float) -> list[list[float]]:
            c, s, out = math.cos(t), math.sin(t), [[float(i == j) for j in range(3)] for i in range(3)]
            u, v = [k for k in range(3) if k != axis]
            out[u][u], out[v][v], out[u][v], out[v][u] = c, c, s, -s
            return out

        product = turn(2, phi1)
        for m in (turn(0, big), turn(2, phi2)):
            product = [[sum(m[i][k] * product[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
        return cls(w0, eps, tuple(x for row in product for x in row))

    def crystal(self, p: list[Expr]) -> list[Expr]:
        r = self.rotation
        return [sum((r[3 * k + a] * p[a] for a in range(3)), const(0)) for k in range(3)]


def _cubic(p: list[Expr], w: Anisotropy3D) -> tuple[list[Expr], Expr, Expr, Expr]:
    own = w.crystal(p)
    size = p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    n = [x * x / where(size > NO_DIRECTION, size, 1.0) for x in own]
    s = n[0] * n[0] + n[1] * n[1] + n[2] * n[2]
    a = 1 - 3 * w.eps + 4 * w.eps * s
    return [16 * w.eps * x * (m - s) for x, m in zip(own, n, strict=True)], a, size, s


def aniso_div_3d(phi: Expr, mesh: Mesh, w: Anisotropy3D) -> Expr:
    if mesh.dim != 3:
        raise ValidationError("anisoDiv3D", "needs a 3D mesh", "use aniso_div")
    out = const(0)
    for axis in range(3):
        p: list[Expr] = [const(0)] * 3
        for other in range(3):
            if other == axis:
                p[other] = (shift(phi, step(axis, 1)) - phi) / mesh.d[axis]
            else:
                here = shift(phi, step(other, 1)) - shift(phi, step(other, -1))
                p[other] = 0.25 * (here + shift(here, step(axis, 1))) / mesh.d[other]
        v, a, size, _ = _cubic(p, w)
        turned = sum((w.rotation[3 * k + axis] * v[k] for k in range(3)), const(0))
        flux = where(size > NO_DIRECTION, w.w0**2 * (a * (a * p[axis] + turned)), w.w0**2 * p[axis])
        out = out + (flux - shift(flux, step(axis, -1))) / mesh.d[axis]
    return out


def aniso_factor_3d(phi: Expr, mesh: Mesh, w: Anisotropy3D) -> Expr:
    _, a, size, _ = _cubic([first(phi, axis, mesh) for axis in range(3)], w)
    return where(size > NO_DIRECTION, a, 1.0)
