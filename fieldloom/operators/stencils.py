"""Difference schemes as expressions over samples.

Each function takes an expression and gives the scheme's combination of its
shifted copies; coefficients are plain multiplications. Weights are written
over a common denominator, so integer data keeps exact numerators.
"""

from __future__ import annotations

from ..errors import ValidationError, warn_once
from ..mesh import Mesh
from ..plans.expr import Expr, const, maximum, shift, where

#: Weights by offset, over their denominator, of first and second derivatives.
FIRST = {"CD2": ({-1: -1, 1: 1}, 2), "CD4": ({-2: 1, -1: -8, 1: 8, 2: -1}, 12), "CD6": ({-3: -1, -2: 9, -1: -45, 1: 45, 2: -9, 3: 1}, 60)}
SECOND = {
    "CD2": ({-1: 1, 0: -2, 1: 1}, 1),
    "CD4": ({-2: -1, -1: 16, 0: -30, 1: 16, 2: -1}, 12),
    "CD6": ({-3: 2, -2: -27, -1: 270, 0: -490, 1: 270, 2: -27, 3: 2}, 180),
}


def step(axis: int, by: int) -> tuple[int, int, int]:
    return tuple(by if a == axis else 0 for a in range(3))


def combined(e: Expr, weights: dict[tuple[int, int, int], float], scale: float) -> Expr:
    """Sum of weighted shifts, divided by scale."""
    out = const(0)
    for offset, w in sorted(weights.items()):
        out = out + w * shift(e, offset)
    return out / scale


def _table(tables: dict, scheme: str, what: str) -> tuple[dict[int, int], int]:
    if scheme not in tables:
        raise ValidationError(what, f"unknown scheme {scheme}", f"one of {sorted(tables)}")
    return tables[scheme]


def first(e: Expr, axis: int, mesh: Mesh, scheme: str = "CD2") -> Expr:
    """First derivative. Iso9 averages over the neighbouring rows in 2D; elsewhere it is CD2."""
    if axis >= mesh.dim:
        return const(0)
    if scheme == "Iso9":
        if mesh.dim == 2 and axis < 2:
            weights = {step(axis, s): 4.0 * s for s in (-1, 1)}
            for s in (-1, 1):
                for t in (-1, 1):
                    weights[tuple(s if a == axis else t if a == 1 - axis else 0 for a in range(3))] = float(s)
            return combined(e, weights, 12 * mesh.d[axis])
        warn_once("grad Iso9", "Iso9 gradients are for 2D: CD2 is used")
        scheme = "CD2"
    weights, scale = _table(FIRST, scheme, "grad")
    return combined(e, {step(axis, o): float(w) for o, w in weights.items()}, scale * mesh.d[axis])


def second(e: Expr, axis: int, mesh: Mesh, scheme: str = "CD2") -> Expr:
    if axis >= mesh.dim:
        return const(0)
    weights, scale = _table(SECOND, scheme, "second derivative")
    return combined(e, {step(axis, o): float(w) for o, w in weights.items()}, scale * mesh.d[axis] ** 2)


def mixed(e: Expr, axes: tuple[int, int], mesh: Mesh, scheme: str = "CD2") -> Expr:
    """Mixed derivative: the tensor product of two first derivatives."""
    weights, scale = _table(FIRST, scheme, "mixed derivative")
    both = {}
    for o, w in weights.items():
        for p, v in weights.items():
            both[tuple(x + y for x, y in zip(step(axes[0], o), step(axes[1], p), strict=True))] = float(w * v)
    return combined(e, both, scale**2 * mesh.d[axes[0]] * mesh.d[axes[1]])


def laplacian(e: Expr, mesh: Mesh, scheme: str = "CD2") -> Expr:
    mesh.cartesian("lap")
    if scheme == "Iso9" and mesh.dim == 2:
        if abs(mesh.d[0] - mesh.d[1]) > 1e-12 * mesh.d[0]:
            raise ValidationError("lap", "Iso9 needs square cells")
        weights = {(x, y, 0): -20.0 if x == y == 0 else 4.0 if x == 0 or y == 0 else 1.0 for x in (-1, 0, 1) for y in (-1, 0, 1)}
        return combined(e, weights, 6 * mesh.d[0] ** 2)
    if scheme == "Iso27" and mesh.dim == 3:
        if max(mesh.d) - min(mesh.d) > 1e-12 * mesh.d[0]:
            raise ValidationError("lap", "Iso27 needs cubic cells")
        own = {0: -128.0, 1: 14.0, 2: 3.0, 3: 1.0}  # over 30
        weights = {(x, y, z): own[abs(x) + abs(y) + abs(z)] for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)}
        return combined(e, weights, 30 * mesh.d[0] ** 2)
    if scheme in ("Iso9", "Iso27"):
        scheme = "CD2"
    out = const(0)
    for axis in range(mesh.dim):
        out = out + second(e, axis, mesh, scheme)
    return out


def grad_squared(e: Expr, mesh: Mesh, scheme: str = "CD2") -> Expr:
    """Squared gradient; Iso9 mixes axial and diagonal differences two to one in 2D."""
    axial = const(0)
    for axis in range(mesh.dim):
        g = first(e, axis, mesh, "CD2" if scheme == "Iso9" else scheme)
        axial = axial + g * g
    if scheme != "Iso9" or mesh.dim != 2:
        return axial
    p = shift(e, (1, 1, 0)) - shift(e, (-1, -1, 0))
    q = shift(e, (-1, 1, 0)) - shift(e, (1, -1, 0))
    return (2.0 / 3.0) * axial + (1.0 / 3.0) * ((p * p + q * q) / (8 * mesh.d[0] ** 2))


def grad_dot(a: Expr, b: Expr, mesh: Mesh, scheme: str = "CD2") -> Expr:
    out = const(0)
    for axis in range(mesh.dim):
        out = out + first(a, axis, mesh, scheme) * first(b, axis, mesh, scheme)
    return out


def advection(velocity: tuple[Expr, ...], e: Expr, mesh: Mesh, scheme: str = "UW1") -> Expr:
    """velocity . grad(e), upwind: UW1, UW2 or WENO5."""
    if scheme not in ("UW1", "UW2", "WENO5"):
        raise ValidationError("adv", f"unknown scheme {scheme}", "UW1, UW2 or WENO5")
    out = const(0)
    for axis, u in enumerate(velocity[: mesh.dim]):
        n, d = (lambda by, axis=axis: shift(e, step(axis, by))), mesh.d[axis]
        if scheme == "UW1":
            back, forth = (n(0) - n(-1)) / d, (n(1) - n(0)) / d
        elif scheme == "UW2":
            back, forth = (3 * n(0) - 4 * n(-1) + n(-2)) / (2 * d), (-3 * n(0) + 4 * n(1) - n(2)) / (2 * d)
        else:
            slope = lambda by: (n(by + 1) - n(by)) / d  # noqa: B023, E731
            back, forth = _weno(*[slope(k) for k in (-3, -2, -1, 0, 1)]), _weno(*[slope(k) for k in (2, 1, 0, -1, -2)])
        out = out + u * where(u > 0, back, forth)
    return out


def _weno(a: Expr, b: Expr, c: Expr, d: Expr, e: Expr) -> Expr:
    """Fifth-order weighted one-sided slope from five differences, upwind to downwind."""
    p1, p2, p3 = a / 3 - b * (7 / 6) + c * (11 / 6), -(b / 6) + c * (5 / 6) + d / 3, c / 3 + d * (5 / 6) - e / 6
    square = lambda x: x * x
    s1 = (13 / 12) * square(a - 2 * b + c) + 0.25 * square(a - 4 * b + 3 * c)
    s2 = (13 / 12) * square(b - 2 * c + d) + 0.25 * square(b - d)
    s3 = (13 / 12) * square(c - 2 * d + e) + 0.25 * square(3 * c - 4 * d + e)
    w1, w2, w3 = (const(g) / square(s + 1e-6) for g, s in ((0.1, s1), (0.6, s2), (0.3, s3)))
    return (w1 * p1 + w2 * p2 + w3 * p3) / (w1 + w2 + w3)


#: Fourth-order gradients at the middle of an axial link (0,0)-(1,0) and of a diagonal link (0,0)-(1,1), by offset.
AXIAL_ALONG = {
    (1, 1): 35 / 48, (0, -1): -35 / 48, (0, 1): -35 / 48, (1, -1): 35 / 48, (2, 1): -1 / 48, (-1, -1): 1 / 48,
    (-1, 1): 1 / 48, (2, -1): -1 / 48, (1, 2): -1 / 6, (0, -2): 1 / 6, (0, 2): 1 / 6, (1, -2): -1 / 6,
}
AXIAL_ACROSS = {
    (1, 1): 35 / 96, (0, -1): -35 / 96, (0, 1): 35 / 96, (1, -1): -35 / 96, (2, 1): -1 / 32, (-1, -1): 1 / 32,
    (-1, 1): -1 / 32, (2, -1): 1 / 32, (1, 2): -1 / 24, (0, -2): 1 / 24, (0, 2): -1 / 24, (1, -2): 1 / 24,
}
DIAGONAL_X = {
    (1, 1): 5 / 8, (0, 0): -5 / 8, (0, 1): -5 / 8, (1, 0): 5 / 8, (2, 1): -1 / 48, (-1, 0): 1 / 48,
    (-1, 1): 1 / 48, (2, 0): -1 / 48, (1, 2): -1 / 16, (0, -1): 1 / 16, (0, 2): 1 / 16, (1, -1): -1 / 16,
}


def _reflected(weights: dict[tuple[int, int], float], swap: bool, sx: int, sy: int, factor: float = 1.0) -> dict[tuple[int, int], float]:
    """A stencil with its offsets swapped, then mirrored."""
    out = {}
    for (x, y), w in weights.items():
        x, y = (y, x) if swap else (x, y)
        out[sx * x, sy * y] = factor * w
    return out


def _link_table(scheme: str) -> list[dict]:
    """Links by half planes with their coefficient average and both gradient components; each is used from both of its ends."""
    wide = scheme in ("Iso21", "Iso21Vector")
    iso = scheme != "CD2"
    coefficient = {(0, 0): 3 / 8, (1, 0): 3 / 8, (0, 1): 1 / 16, (1, 1): 1 / 16, (0, -1): 1 / 16, (1, -1): 1 / 16} if iso else {(0, 0): 0.5, (1, 0): 0.5}
    along = AXIAL_ALONG if wide else {(0, 0): -1.0, (1, 0): 1.0}
    across = AXIAL_ACROSS if wide else {(0, 1): 0.25, (1, 1): 0.25, (0, -1): -0.25, (1, -1): -0.25}
    weight = 2 / 3 if iso else 1.0
    out = [
        {"to": (1, 0), "weight": weight, "a": coefficient, "x": along, "y": across},
        {"to": (0, 1), "weight": weight, "a": _reflected(coefficient, True, 1, 1), "x": _reflected(across, True, 1, 1), "y": _reflected(along, True, 1, 1)},
    ]
    if iso:
        corner = {(0, 0): 0.25, (1, 0): 0.25, (0, 1): 0.25, (1, 1): 0.25}
        x = DIAGONAL_X if wide else {(1, 1): 0.5, (0, 1): -0.5, (1, 0): 0.5, (0, 0): -0.5}
        y = _reflected(x, True, 1, 1)
        out.append({"to": (1, 1), "weight": 1 / 3, "a": corner, "x": x, "y": y})
        out.append({"to": (-1, 1), "weight": 1 / 3, "a": _reflected(corner, False, -1, 1), "x": _reflected(x, False, -1, 1, -1.0), "y": _reflected(y, False, -1, 1)})
    return out


def _flux_sum(a: Expr, b: Expr, mesh: Mesh, scheme: str, families: tuple[str, ...], floor: float | None) -> Expr:
    """Sum over links of weight / length^2 times the flux; floor: normalise by the gradient's size, at least this."""
    if mesh.dim != 2 or scheme not in families:
        raise ValidationError("links", f"no scheme {scheme} in {mesh.dim}D", f"one of {families}, in 2D")
    if scheme != "CD2" and abs(mesh.d[0] - mesh.d[1]) > 1e-12 * max(mesh.d[:2]):
        raise ValidationError("links", f"{scheme} needs square cells")
    reconstructed = scheme == "Iso21Vector"
    out = const(0)
    for link in _link_table(scheme):
        tx, ty = link["to"]
        length = (tx * mesh.d[0]) ** 2 + (ty * mesh.d[1]) ** 2
        for end in (0, 1):  # from this cell, and from the cell at the link's other end
            move = (-end * tx, -end * ty, 0)
            total = lambda e, w: combined(e, {(x, y, 0): v for (x, y), v in w.items()}, 1.0)
            amplitude = shift(total(a, link["a"]), move)
            difference = shift(shift(b, (tx, ty, 0)) - b, move)
            if floor is not None:
                gx, gy = shift(total(b, link["x"]), move) / mesh.d[0], shift(total(b, link["y"]), move) / mesh.d[1]
                along = tx * mesh.d[0] * gx + ty * mesh.d[1] * gy if reconstructed else difference
                norm = Expr("hypot", (gx, gy))
                flux = where((Expr("abs", (amplitude,)) > 0) & (norm > 0), amplitude * along / maximum(norm, max(floor, 1e-300)), 0.0)
            else:
                flux = amplitude * difference
            out = out + (-1.0 if end else 1.0) * (link["weight"] / length) * flux
    return out


def div_grad(a: Expr, b: Expr, mesh: Mesh, scheme: str = "CD2") -> Expr:
    """div(a grad b) as a sum over links to neighbours."""
    return _flux_sum(a, b, mesh, scheme, ("CD2", "Iso9"), None)


def div_normal(a: Expr, b: Expr, mesh: Mesh, scheme: str = "CD2", floor: float = 0.0) -> Expr:
    """div(a grad b / |grad b|) over links; where the gradient vanishes the flux does."""
    return _flux_sum(a, b, mesh, scheme, ("CD2", "Iso21", "Iso21Vector"), floor)


def weighted_sum(e: Expr, weights: dict[tuple[int, int, int], float]) -> Expr:
    """A linear stencil given by the user."""
    return combined(e, {tuple(k): float(v) for k, v in weights.items()}, 1.0)


def weighted_differences(e: Expr, weights: dict[tuple[int, int, int], float]) -> Expr:
    """A linear stencil whose weights must sum to zero."""
    total, size = sum(weights.values()), max(map(abs, weights.values()))
    if abs(total) > 1e-13 * size:
        raise ValidationError("weightedDifferences", f"weights sum to {total}, not zero")
    return weighted_sum(e, weights)
