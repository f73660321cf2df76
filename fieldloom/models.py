"""Models: rates of change (and definitions they need) as expressions, still without schemes."""

from __future__ import annotations

from itertools import permutations

from .functions.material import double_well_prime, h_quintic, h_quintic_prime
from .mesh import Mesh
from .operators.anisotropy import Anisotropy, aniso_div, aniso_factor
from .operators.stencils import grad_dot
from .plans.expr import Expr, call, const, field, grad_sq, lap
from .plans.schemes import Schemes
from .plans.system import System


def allen_cahn(phi: str = "phi", mobility: float = 1.0) -> dict[str, Expr]:
    p = field(phi)
    return {phi: mobility * (lap(p) + p - p * p * p)}


def cahn_hilliard(system: System, c: str = "c", rho: float = 5.0, low: float = 0.3, high: float = 0.7, kappa: float = 2.0, mobility: float = 5.0, potential: Expr | None = None) -> None:
    """Double-well mixture; potential: a further part of the chemical potential, for instance a charge's."""
    e = field(c)
    mu = 2 * rho * (e - low) * (e - high) * (2 * e - low - high) - kappa * lap(e)
    system.define("mu", mu if potential is None else mu + potential)
    system.evolve(c, mobility * lap(field("mu")))


def ostwald(system: System, grains: list[str], c: str = "c", rho2: float = 2.0, low: float = 0.3, high: float = 0.7, kappa: float = 3.0, kappa_grain: float = 3.0, mobility: float = 5.0, rate: float = 5.0, w: float = 1.0, alpha: float = 5.0) -> None:
    """A conserved composition with grains that share a frozen sum of squares."""
    e, eta = field(c), [field(g) for g in grains]
    order, squares = const(0), const(0)
    for g in eta:
        order, squares = order + h_quintic(g), squares + g * g
    system.define("squares", squares)
    system.define("mu", 2 * rho2 * (e - low) + 2 * rho2 * (low - high) * order - kappa * lap(e))
    system.evolve(c, mobility * lap(field("mu")))
    gain = rho2 * ((high - e) * (high - e) - (e - low) * (e - low))
    for name, g in zip(grains, eta, strict=True):
        push = gain * h_quintic_prime(g) + w * double_well_prime(g) + 2 * w * alpha * g * (field("squares") - g * g)
        system.evolve(name, rate * (kappa_grain * lap(g) - push))


def dendrite(mesh: Mesh, schemes: Schemes, phi: str = "phi", heat: str = "u", w0: float = 1.0, tau0: float = 1.0, diffusivity: float = 10.0, eps: float = 0.05, m: int = 4, theta0: float = 0.0) -> tuple[Expr, Expr]:
    """(rate of phi, rate of the temperature without its half of that rate): anisotropic solidification of a pure melt."""
    p, u = field(phi), field(heat)
    aniso, coupling = Anisotropy(w0, eps, m, theta0), diffusivity * tau0 / (0.6267 * w0**2)
    a, side = aniso_factor(p, mesh, aniso), 1 - p * p
    rate = (side * (p - coupling * u * side) + aniso_div(p, mesh, aniso)) / (tau0 * a * a)
    return rate, schemes.bind(diffusivity * lap(u), mesh)


def multiphase(mesh: Mesh, phases: list[str], barrier: dict[frozenset, float], width2: dict[frozenset, float], mobility: dict[frozenset, float]) -> tuple[dict[str, Expr], dict[str, Expr]]:
    """(driving forces to define as mu_<phase>, rates): pairwise obstacle-free multi-phase field."""
    mu: dict[str, Expr] = {p: const(0) for p in phases}
    for a, b in permutations(phases, 2):
        pa, pb, key = field(a), field(b), frozenset((a, b))
        capillary = 2 * pa * grad_sq(pb) - 2 * pb * grad_dot(pa, pb, mesh) + pa * pb * lap(pb) - pb * pb * lap(pa)
        mu[a] = mu[a] + 2 * barrier[key] * pa * pb * pb + width2[key] * capillary
    rates = {}
    for a in phases:
        rate = const(0)
        for b in phases:
            if a != b:
                rate = rate + mobility[frozenset((a, b))] * (field(f"mu_{b}") - field(f"mu_{a}"))
        rates[a] = rate
    return {f"mu_{p}": e for p, e in mu.items()}, rates


def charged_source(c: str, charge: float, permittivity: float, lift: Expr | None = None) -> Expr:
    """Right-hand side of the potential's equation."""
    e = charge * field(c) / permittivity
    return e if lift is None else e + lift


def precipitate(system: System, eta: str, eigen: float, c11: float, c12: float, w: float, coefficients: tuple[float, ...], kappa: float, mobility: float) -> None:
    """A misfitting precipitate; strains e11 and e22 are fields, solved by an external step (operators.elastic)."""
    e, slope = field(eta), const(0)
    for k, a in enumerate(coefficients):
        if k:
            slope = slope + (k * a) * (e if k == 2 else const(1) if k == 1 else e ** (k - 1))
    stress = (c11 + c12) * (field("e11") + field("e22") - 2 * eigen * h_quintic(e))
    system.define("mu", w * slope - eigen * h_quintic_prime(e) * stress - kappa * lap(e))
    system.evolve(eta, mobility * lap(field("mu")))


def gray_scott(u: str = "u", v: str = "v", du: float = 0.2, dv: float = 0.1, feed: float = 0.04, kill: float = 0.06) -> dict[str, Expr]:
    a, b = field(u), field(v)
    return {u: du * lap(a) - a * b * b + feed * (1 - a), v: dv * lap(b) + a * b * b - (feed + kill) * b}


def logistic(phi: str, rate: float) -> dict[str, Expr]:
    """A decay or growth without space, for checking integrators."""
    return {phi: rate * field(phi) * (1 - call("abs", field(phi)))}
