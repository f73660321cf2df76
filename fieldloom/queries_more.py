"""SQL for operators whose formulas take several stages, and queries for solvers, engines, files and the rest of the front end.

Solutions of linear systems are compared with a direct solve: the SQL takes
the right-hand side apart into all its modes and divides each by the
operator's eigenvalue.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import material
from .mesh import Mesh, Patch
from .operators import anisotropy, faces, index, lattice, noise, solvers, stencils
from .operators.boundary import NOFLUX, PERIODIC, Boundary, by_patch, custom, fixed, from_config, wall_value
from .oracle import BOX, chain, with_steps
from .plans import expr as ex
from .plans.blocks import Blocks
from .plans.expr import Expr, Vector, field, names
from .plans.schemes import Schemes
from .queries import _AX, _D, _F4, _FACE, _FEQ, _ISO, _L, _W4, ORACLES, P, Q, UX, UY, V, W, _aniso_sql, _axis, _noflux_grid, _populations, _rounded, grid_query, query
from .sources import files, ingest
from .sources.initial import make, spinodal
from .sources.scratch import folder
from .streaming import evolve as ev
from .streaming.frame import MovingFrame

__all__ = ["ORACLES"]


def _fields(digits: int, last: str, *columns: str) -> str:
    return " SELECT i, j, k, " + ", ".join(f"ROUND({c}, {digits}) + 0.0 AS {c}" for c in columns) + f" FROM {last}"


# anisotropy in three dimensions: a rotated crystal, angles in the order z, x, z


def _rotation(a: float, b: float, c: float) -> list[list[float]]:
    ca, sa, cb, sb, cc, sc = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(c), math.sin(c)
    return [[ca * cc - sa * sc * cb, sa * cc + ca * sc * cb, sc * sb], [-ca * sc - sa * cc * cb, -sa * sc + ca * cc * cb, cc * sb], [sa * sb, -ca * sb, cb]]


def _unit(axis: int, by: int = 1) -> tuple[int, ...]:
    return tuple(by if a == axis else 0 for a in range(3))


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _box_gradients() -> dict[str, Callable]:
    """g<a><b>: derivative along b on the high face of axis a."""
    out = {}
    for a in range(3):
        for b in range(3):
            if a == b:
                out[f"g{a}{b}"] = lambda n, a=a: f"{n('p', *_unit(a))}-t.p"
            else:
                out[f"g{a}{b}"] = lambda n, a=a, b=b: f"0.25::DOUBLE*({n('p', *_unit(b))}-{n('p', *_unit(b, -1))}+{n('p', *_plus(_unit(a), _unit(b)))}-{n('p', *_plus(_unit(a), _unit(b, -1)))})"
    return out


def _box_flux(axis: int, eps: float, r: list[list[float]]) -> Callable:
    g = [f"t.g{axis}{b}" for b in range(3)]
    own = ["(" + "+".join(f"({r[k][b]!r})*{g[b]}" for b in range(3)) + ")" for k in range(3)]
    size = "(" + "+".join(f"{x}*{x}" for x in g) + ")"
    fourth = "((" + "+".join(f"pow({q},4)" for q in own) + f")/({size}*{size}))"
    a = f"(1-3*{eps}::DOUBLE+4*{eps}::DOUBLE*{fourth})"
    turn = "(" + "+".join(f"({r[k][axis]!r})*{own[k]}*({own[k]}*{own[k]}/{size}-{fourth})" for k in range(3)) + ")"
    return lambda n: f"CASE WHEN {size}>1e-150 THEN {a}*({a}*{g[axis]}+16*{eps}::DOUBLE*{turn}) ELSE {g[axis]} END"


ORACLES["aniso_div_3d"] = chain(
    [(_box_gradients(), ()), ({f"f{a}": _box_flux(a, 0.02, _rotation(0.3, 0.2, 0.1)) for a in range(3)}, ()), ({"a": lambda n: "+".join(f"t.f{a}-{n(f'f{a}', *_unit(a, -1))}" for a in range(3))}, ())],
    _fields(6, "g3", "a"), base=BOX,
)

# normalised fluxes with wide link gradients: one flux for each link of a half plane
_SWAP = lambda w: {(y, x): v for (x, y), v in w.items()}
_FLIP = lambda w, s=1: {(-x, y): s * v for (x, y), v in w.items()}
_SIX = {(0, 0): 3 / 8, (1, 0): 3 / 8, (0, 1): 1 / 16, (1, 1): 1 / 16, (0, -1): 1 / 16, (1, -1): 1 / 16}
_FOUR = {(x, y): 1 / 4 for x in (0, 1) for y in (0, 1)}
#: link: (end, amplitude weights, gradient weights along x and y, weight by squared length)
_LINKS = {
    "e": ((1, 0), _SIX, stencils.AXIAL_ALONG, stencils.AXIAL_ACROSS, 2 / 3),
    "n": ((0, 1), _SWAP(_SIX), _SWAP(stencils.AXIAL_ACROSS), _SWAP(stencils.AXIAL_ALONG), 2 / 3),
    "ne": ((1, 1), _FOUR, stencils.DIAGONAL_X, _SWAP(stencils.DIAGONAL_X), 1 / 6),
    "nw": ((-1, 1), _FLIP(_FOUR), _FLIP(stencils.DIAGONAL_X, -1), _FLIP(_SWAP(stencils.DIAGONAL_X)), 1 / 6),
}


def _sum(n: Callable, f: str, weights: dict) -> str:
    return "(" + "+".join(f"({w!r})*{n(f, *o)}" for o, w in weights.items()) + ")"


def _link_flux(name: str, vector: bool) -> Callable:
    to, amplitude, gx, gy, _ = _LINKS[name]

    def out(n: Callable) -> str:
        x, y, amount = _sum(n, "q", gx), _sum(n, "q", gy), _sum(n, "p", amplitude)
        along = f"(({to[0]})*{x}+({to[1]})*{y})" if vector else f"({n('q', *to)}-t.q)"
        norm = f"sqrt({x}*{x}+{y}*{y})"
        return f"CASE WHEN abs({amount})>0 AND {norm}>0 THEN {amount}*{along}/greatest({norm},0.01::DOUBLE) ELSE 0.0::DOUBLE END"

    return out


def _link_sum(kind: str) -> Callable:
    return lambda n: "+".join(f"({w!r})*(t.{kind}{name}-{n(kind + name, -to[0], -to[1])})" for name, (to, _, _, _, w) in _LINKS.items())


ORACLES["divnormal_iso21"] = chain(
    [({f"{kind}{name}": _link_flux(name, kind == "v") for kind in "dv" for name in _LINKS}, ()), ({"a": _link_sum("d"), "b": _link_sum("v")}, ())], _fields(6, "g2", "a", "b"),
)


# several phases on a simplex
def _mu(a: str, others: str) -> Callable:
    def pair(n: Callable, b: str) -> str:
        ga, gb = [[f"({_D(x, axis)(n)})" for axis in (0, 1)] for x in (a, b)]
        return f"(2*t.{a}*t.{b}*t.{b}+2*t.{a}*({gb[0]}*{gb[0]}+{gb[1]}*{gb[1]})-2*t.{b}*({ga[0]}*{gb[0]}+{ga[1]}*{gb[1]})+t.{a}*t.{b}*{_L(b)(n)}-t.{b}*t.{b}*{_L(a)(n)})"

    return lambda n: "+".join(pair(n, b) for b in others)


def _simplex_sql(source: str, columns: str, passes: int) -> str:
    """CTEs s1, s2, ...: clip, and spread the excess over what is left."""
    out, at = "", source
    for k in range(1, passes + 1):
        counted = f"SELECT *, {'+'.join(f'greatest({c},0)' for c in columns)}-1 AS d, {'+'.join(f'({c}>=0)::INT' for c in columns)} AS m, ({' OR '.join(f'{c}<0' for c in columns)}) AS neg FROM {at}"
        moved = ", ".join(f"CASE WHEN neg THEN CASE WHEN {c}>0 THEN {c}-d/m ELSE 0 END ELSE {c} END AS {c}" for c in columns)
        out += f", s{k} AS (SELECT i, j, k, {moved} FROM ({counted}))"
        at = f"s{k}"
    return out + " SELECT i, j, k, " + ", ".join(f"ROUND(greatest({c}, 0), 7) + 0.0 AS {c}" for c in columns) + f" FROM {at}"


ORACLES["multiphase_step"] = chain([
    ({"a": lambda n: "0.5*t.p", "b": lambda n: "0.5*t.q", "c": lambda n: "1-0.5*t.p-0.5*t.q"}, ()),
    ({f"m{x}": _mu(x, "abc".replace(x, "")) for x in "abc"}, ("a", "b", "c")),
    ({x: (lambda n, x=x: f"t.{x}+0.001::DOUBLE*({'+'.join(f'(t.m{y}-t.m{x})' for y in 'abc'.replace(x, ''))})") for x in "abc"}, ()),
], _simplex_sql("g3", "abc", 3))

# solidification of a pure melt
_UPRIGHT = lambda n: _aniso_sql()(n).replace("0.3::DOUBLE", "0.0::DOUBLE")
_COUPLING = repr(10 / 0.6267)


def _solid_rate(n: Callable) -> str:
    x, y = _D("p", 0)(n), _D("p", 1)(n)
    a = f"(1+0.05::DOUBLE*CASE WHEN {x}*{x}+{y}*{y}<=1e-150 THEN 0.0::DOUBLE ELSE cos(4*atan2({y},{x})) END)"
    return f"((1-t.p*t.p)*(t.p-{_COUPLING}*t.q*(1-t.p*t.p))+{_UPRIGHT(n)})/({a}*{a})"


ORACLES["dendrite_step"] = chain(
    [({"dp": _solid_rate, "dq": lambda n: f"10*{_L('q')(n)}"}, ("p", "q")), ({"p": lambda n: "t.p+0.001::DOUBLE*t.dp", "q": lambda n: "t.q+0.001::DOUBLE*(t.dq+0.5*t.dp)"}, ())], _fields(9, "g2", "p", "q"), "noflux",
)


def _trapped(axis: int) -> Callable:
    o, s = ((1, 0), (0, 1)) if axis == 0 else ((0, 1), (1, 0))

    def out(n: Callable) -> str:
        along = f"({n('p', *o)}-t.p)"
        across = f"(0.25::DOUBLE*({n('p', *s)}-{n('p', -s[0], -s[1])}+{n('p', o[0] + s[0], o[1] + s[1])}-{n('p', o[0] - s[0], o[1] - s[1])}))"
        size = f"sqrt({along}*{along}+{across}*{across})"
        mean = lambda f: f"(0.5::DOUBLE*(t.{f}+{n(f, *o)}))"
        return f"CASE WHEN {size}>1e-12 THEN 0.35::DOUBLE*({mean('cl')}-{mean('cs')})*{mean('r')}*{along}/{size} ELSE 0.0::DOUBLE END"

    return out


_PHASE_MU = "((t.q-{h}*0.25::DOUBLE-(1-{h})*0.75::DOUBLE)/({h}/2+(1-{h})/3))".replace("{h}", "(t.p*t.p*(3-2*t.p))")
ORACLES["anti_trapping"] = chain([
    ({"cs": lambda n: f"0.25::DOUBLE+{_PHASE_MU}/2", "cl": lambda n: f"0.75::DOUBLE+{_PHASE_MU}/3", "r": _L("p")}, ("p",)),
    ({"fx": _trapped(0), "fy": _trapped(1)}, ()), ({"a": lambda n: f"t.fx-{n('fx', -1)}+t.fy-{n('fy', 0, -1)}"}, ()),
], _fields(9, "g3", "a"))

# flow: all stages of a channel, and walls with solid cells
_POPULATIONS = tuple(f"f{q}" for q in range(9))
_TOTAL = "(" + "+".join(f"t.{f}" for f in _POPULATIONS) + ")"
_FLOW = {"rho": lambda n: _TOTAL, "ux": lambda n: f"(t.f1+t.f5+t.f8-t.f3-t.f6-t.f7)/{_TOTAL}", "uy": lambda n: f"(t.f2+t.f5+t.f6-t.f4-t.f7-t.f8)/{_TOTAL}"}


def _relaxed(q: int, tau: float = 0.8) -> Callable:
    w, cu = ("4.0::DOUBLE/9", "1.0::DOUBLE/9", "1.0::DOUBLE/36")[0 if q == 0 else 1 if q < 5 else 2], f"(({lattice.CX[q]})*t.ux+({lattice.CY[q]})*t.uy)"
    return lambda n: f"t.f{q}-(t.f{q}-{w}*t.rho*(1+3*{cu}+4.5*{cu}*{cu}-1.5*(t.ux*t.ux+t.uy*t.uy)))/{tau}::DOUBLE"


def _bounced(q: int, solid: bool = False) -> Callable:
    """Pulled from upstream; the opposite one where that is beyond the walls along y, or solid."""
    cx, cy = lattice.CX[q], lattice.CY[q]

    def out(n: Callable) -> str:
        blocked = f"(t.j-({cy}) NOT BETWEEN 0 AND 23)" + (f" OR {n('s', -cx, -cy)}>0" if solid else "")
        moved = f"CASE WHEN {blocked} THEN t.f{lattice.OPPOSITE[q]} ELSE {n(f'f{q}', -cx, -cy)} END"
        return f"CASE WHEN t.s>0 THEN t.f{q} ELSE {moved} END" if solid else moved

    return out


_SHEAR = "0.5*(t.f2-t.f4)"
_INLET = f"(({'t.f0+t.f2+t.f4'}+2*(t.f3+t.f6+t.f7))/0.99::DOUBLE*0.01::DOUBLE)"
_OUTLET = "(1-(t.f0+t.f2+t.f4+2*(t.f1+t.f5+t.f8)))"
_OPEN = {f: (lambda n, f=f: f"t.{f}") for f in _POPULATIONS} | {
    "f1": lambda n: f"CASE WHEN t.i=0 THEN t.f3+2.0::DOUBLE/3*{_INLET} ELSE t.f1 END", "f5": lambda n: f"CASE WHEN t.i=0 THEN t.f7+{_INLET}/6-{_SHEAR} ELSE t.f5 END",
    "f8": lambda n: f"CASE WHEN t.i=0 THEN t.f6+{_INLET}/6+{_SHEAR} ELSE t.f8 END", "f3": lambda n: f"CASE WHEN t.i=31 THEN t.f1+2.0::DOUBLE/3*{_OUTLET} ELSE t.f3 END",
    "f6": lambda n: f"CASE WHEN t.i=31 THEN t.f8+{_OUTLET}/6-{_SHEAR} ELSE t.f6 END", "f7": lambda n: f"CASE WHEN t.i=31 THEN t.f5+{_OUTLET}/6+{_SHEAR} ELSE t.f7 END",
}
ORACLES["lattice_channel"] = chain([
    (_FEQ, ()), (_FLOW, _POPULATIONS), ({f"f{q}": _relaxed(q) for q in range(9)}, ()), ({f"f{q}": _bounced(q) for q in range(9)}, ()), (_OPEN, ()), (_FLOW, ()),
], _fields(9, "g6", "rho", "ux", "uy"))


@query("lattice_solids", chain([(_FEQ | {"s": lambda n: "CASE WHEN t.q>0.6 THEN 1 ELSE 0 END"}, ()), ({f"f{q}": _bounced(q, True) for q in range(9)}, ())], _fields(9, "g2", *_POPULATIONS)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming between walls along y and around solid cells."""
    g = ingest.lineitem_grid(spark, sf_dir)
    g = g.assign(lattice.Lattice.equilibrium(1 + 0.125 * P, 0.03125 * UX, 0.03125 * UY) | {"s": ex.where(Q > 0.6, 1.0, 0.0)})
    return _rounded(lattice.Lattice(0.8, walls=(False, True), solid="s").stream(g).df.select("i", "j", "k", *_POPULATIONS), 9)


@query("lattice_solid_flow", chain([(_FEQ | {"s": lambda n: "CASE WHEN t.q>0.6 THEN 1 ELSE 0 END"}, ()), ({k: (lambda n, e=e, k=k: f"CASE WHEN t.s>0 THEN {1 if k == 'rho' else 0} ELSE {e(n)} END") for k, e in _FLOW.items()}, ())], _fields(9, "g2", "rho", "ux", "uy")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _populations(spark, sf_dir).assign({"s": ex.where(Q > 0.6, 1.0, 0.0)})
    return _rounded(lattice.Lattice(0.8, solid="s").macroscopic(g), 9)


# direct solves over all modes of the 32 x 24 grid
_ANGLE = f"(2*{math.pi!r}*(m.a*c.i/32.0::DOUBLE+m.b*c.j/24.0::DOUBLE))"
_MODES = f"""
mode AS (SELECT m.a, m.b, SUM(c.p*cos({_ANGLE})) AS re, -SUM(c.p*sin({_ANGLE})) AS im FROM (SELECT CAST(x AS INT) a, CAST(y AS INT) b FROM range(32) x(x), range(24) y(y)) m, g c GROUP BY m.a, m.b),
eigen AS (SELECT *, 2-2*cos(2*{math.pi!r}*a/32)+2-2*cos(2*{math.pi!r}*b/24) AS lap FROM mode)"""


def _direct(symbol: str, name: str, digits: int, where: str = "true") -> str:
    """The field whose modes are those of p over the symbol, a function of lap (minus the Laplacian's eigenvalue)."""
    return with_steps(f",{_MODES} SELECT c.i, c.j, c.k, ROUND(SUM((m.re*cos({_ANGLE})-m.im*sin({_ANGLE}))/({symbol}))/768, {digits}) + 0.0 AS {name} FROM g c, eigen m WHERE {where} GROUP BY c.i, c.j, c.k")


def _right_hand_side(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    g = ingest.lineitem_grid(spark, sf_dir)
    return g.with_df(g.df.select("i", "j", "k", F.lit(0.0).alias("x"), F.col("p").alias("b")))


@query("cg_solution", _direct("1+0.25::DOUBLE*m.lap", "x", 6))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _right_hand_side(spark, sf_dir)
    got = solvers.conjugate_gradient(g, "x", "b", solvers.System(solvers.laplace(g.mesh), 1.0, 0.25), 1e-11, 60).grid
    return _rounded(got.df.select("i", "j", "k", "x"), 6)


@query("pcg_solution", _direct("1+2*m.lap", "x", 6))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a polynomial preconditioner."""
    g = _right_hand_side(spark, sf_dir)
    s = solvers.System(solvers.laplace(g.mesh), 1.0, 2.0)
    got = solvers.conjugate_gradient(g, "x", "b", s, 1e-11, 60, precondition=solvers.chebyshev(s, g.mesh, 3)).grid
    return _rounded(got.df.select("i", "j", "k", "x"), 6)


@query("poisson_solution", _direct("m.lap", "x", 5, "m.a + m.b > 0"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without means: all sides are periodic."""
    g = _right_hand_side(spark, sf_dir)
    return _rounded(solvers.poisson(g, "x", "b", project=True, tolerance=1e-11, precondition=solvers.chebyshev(solvers.System(solvers.laplace(g.mesh), 0.05, 1.0), g.mesh, 3)).grid.df.select("i", "j", "k", "x"), 5)


@query("imex_solution", _direct("1+0.25::DOUBLE*m.lap", "p", 6))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(ev.imex_step(g.with_df(g.df.select("i", "j", "k", "p")), "p", 1.0, 0.25, tolerance=1e-11).df.select("i", "j", "k", "p"), 6)


@query("imex_reaction", with_steps(f", gr AS (SELECT i, j, k, p+0.125::DOUBLE*(p-p*p*p) AS p FROM g),{_MODES.replace('g c', 'gr c')} SELECT c.i, c.j, c.k, ROUND(SUM((m.re*cos({_ANGLE})-m.im*sin({_ANGLE}))/(1+0.25::DOUBLE*m.lap))/768, 6) + 0.0 AS p FROM gr c, eigen m GROUP BY c.i, c.j, c.k"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An implicit step of diffusion with an explicit reaction."""
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(ev.imex_step(g.with_df(g.df.select("i", "j", "k", "p")), "p", 2.0, 0.125, P - P * P * P, tolerance=1e-11).df.select("i", "j", "k", "p"), 6)


def _chebyshev_sql(degree: int, low: float, high: float) -> tuple[list, str]:
    centre, half = (high + low) / 2, (high - low) / 2
    rho, steps = half / centre, [({"z": lambda n: f"t.p/{centre!r}::DOUBLE", "d": lambda n: f"t.p/{centre!r}::DOUBLE"}, ("p",))]
    for _ in range(degree - 1):
        new = 1 / (2 * centre / half - rho)
        d = lambda n, a=new * rho, b=2 * new / half: f"({a!r}::DOUBLE*t.d+{b!r}::DOUBLE*(t.p-(t.z-0.25::DOUBLE*{_L('z')(n)})))"
        steps.append(({"d": d, "z": lambda n, d=d: f"t.z+{d(n)}"}, ("p",)))
        rho = new
    return steps, f"g{degree}"


_CHEBYSHEV = _chebyshev_sql(3, 1.0, 3.0)


@query("chebyshev_polynomial", chain(_CHEBYSHEV[0], _fields(9, _CHEBYSHEV[1], "z")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(g.select({"z": solvers.chebyshev(solvers.System(solvers.laplace(g.mesh), 1.0, 0.25), g.mesh, 3)(P)}), 9)


@query("jacobi_sweeps", chain([({"x": lambda n: "0.0::DOUBLE"}, ("p",))] + [({"x": lambda n: f"t.x+0.4::DOUBLE*(t.p-(t.x-0.25::DOUBLE*{_L('x')(n)}))"}, ("p",))] * 3, _fields(9, "g4", "x")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _right_hand_side(spark, sf_dir)
    return _rounded(solvers.jacobi(g, "x", "b", solvers.System(solvers.laplace(g.mesh), 1.0, 0.25), 3).df.select("i", "j", "k", "x"), 9)


# elasticity: modes of the eigenstrain by the acoustic tensor of a cubic crystal
ORACLES["elastic_strain"] = with_steps(f""",{_MODES},
w AS (SELECT *, (CASE WHEN 2*a>32 THEN a-32 ELSE a END)*2*{math.pi!r}/32 AS x, (CASE WHEN 2*b>24 THEN b-24 ELSE b END)*2*{math.pi!r}/24 AS y FROM eigen),
t AS (SELECT *, 250*x*x+100*y*y AS xx, 250*x*y AS xy, 250*y*y+100*x*x AS yy FROM w),
u AS (SELECT *, CASE WHEN a+b=0 THEN 0 ELSE 400*(yy*x-xy*y)/(xx*yy-xy*xy) END AS ux, CASE WHEN a+b=0 THEN 0 ELSE 400*(xx*y-xy*x)/(xx*yy-xy*xy) END AS uy FROM t),
m AS (SELECT *, CASE WHEN a+b=0 THEN 1 ELSE x*ux END AS s11, CASE WHEN a+b=0 THEN 1 ELSE y*uy END AS s22, 0.5*(x*uy+y*ux) AS s12 FROM u)
SELECT c.i, c.j, c.k, {", ".join(f"ROUND(SUM(m.s{k}*(m.re*cos({_ANGLE})-m.im*sin({_ANGLE})))/768, 6) + 0.0 AS e{k}" for k in ("11", "22", "12"))} FROM g c, m GROUP BY c.i, c.j, c.k""")


# noise and random fields
def _draw(seed: int, draw: int = 0) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', i, j, k, {seed}, {draw})), 1, 12) AS BIGINT)+1)/281474976710656.0::DOUBLE)"


_NORMAL = f"(sqrt(-2*ln({_draw(7)}))*cos(2*{math.pi!r}*{_draw(7, 1)}))"
ORACLES["noise_fields"] = with_steps(f""" SELECT i, j, k, ROUND(0.5+{_NORMAL}, 6)+0.0 AS gaussian, ROUND(0.5+0.5*{_draw(7)}, 6)+0.0 AS uniform, ROUND(exp(0.5+{_NORMAL}), 6)+0.0 AS log_normal,
 ROUND(0.5+tan({math.pi!r}*({_draw(7)}-0.5)), 6)+0.0 AS cauchy, ROUND(0.5-ln({_draw(7)}), 6)+0.0 AS exponential, CASE WHEN {_draw(7)}<=0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS bernoulli FROM g""")


@query("noise_added", with_steps(f" SELECT i, j, k, ROUND(p-0.1+0.2::DOUBLE*{_draw(11)}, 9)+0.0 AS p FROM g"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(noise.add(ingest.lineitem_grid(spark, sf_dir).df.select("i", "j", "k", "p"), "p", "UNIFORM", 11, -0.1, 0.1), 9)


@query("init_random", with_steps(f" SELECT i, j, k, ROUND(-1+3*{_draw(sum(map(ord, 'u')))}, 9)+0.0 AS u FROM g"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(make(spark, g.mesh, {"u": "random:-1:2"}).df, 9)


# anisotropy: averaged face normals, and a convex hull of missing orientations
def _aniso_faces(iso: bool, eps: float, cone: tuple[float, float] | None) -> Callable:
    def flux(n: Callable, axis: int, at: tuple[int, int]) -> str:
        o = lambda x, y: n("p", at[0] + x, at[1] + y)
        ahead, side = ((1, 0), (0, 1)) if axis == 0 else ((0, 1), (1, 0))
        step = lambda s: f"({o(ahead[0] + s * side[0], ahead[1] + s * side[1])}-{o(s * side[0], s * side[1])})"
        pn = f"(5.0::DOUBLE/6*{step(0)}+({step(1)}+{step(-1)})/12.0::DOUBLE)" if iso else step(0)
        pt = f"(0.25::DOUBLE*({o(*side)}-{o(-side[0], -side[1])}+{o(ahead[0] + side[0], ahead[1] + side[1])}-{o(ahead[0] - side[0], ahead[1] - side[1])}))"
        px, py = (pn, pt) if axis == 0 else (pt, pn)
        still, angle = f"({px}*{px}+{py}*{py}<=1e-150)", f"(4*atan2({py},{px}))"
        c, s = f"(CASE WHEN {still} THEN 0.0::DOUBLE ELSE cos({angle}) END)", f"(CASE WHEN {still} THEN 0.0::DOUBLE ELSE sin({angle}) END)"
        a, slope = f"(1+{eps}::DOUBLE*{c})", f"({4 * eps!r}::DOUBLE*{s})"
        if cone:
            a, slope = f"(CASE WHEN {c}>{cone[0]!r} THEN {cone[1]!r}*cos(atan2({s},{c})/4) ELSE {a} END)", f"(CASE WHEN {c}>{cone[0]!r} THEN {cone[1]!r}*sin(atan2({s},{c})/4) ELSE {slope} END)"
        return f"({a}*({a}*{pn}{'+' if axis == 0 else '-'}{slope}*{pt}))"

    return lambda n: f"{flux(n, 0, (0, 0))}-{flux(n, 0, (-1, 0))}+{flux(n, 1, (0, 0))}-{flux(n, 1, (0, -1))}"


def _missing(eps: float, m: int = 4) -> tuple[float, float]:
    """Where the polar plot of 1 / a has a double tangent: Newton's method for (1 + e cos mt) sin t = e m sin mt cos t."""
    t = math.pi / m / 2
    for _ in range(60):
        value = (1 + eps * math.cos(m * t)) * math.sin(t) - eps * m * math.sin(m * t) * math.cos(t)
        slope = (1 + eps * math.cos(m * t)) * math.cos(t) - eps * m * m * math.cos(m * t) * math.cos(t)
        t -= value / slope
    return math.cos(m * t), (1 + eps * math.cos(m * t)) / math.cos(t)


grid_query("aniso_iso9", lambda m: {"a": anisotropy.aniso_div(P, m, anisotropy.Anisotropy(eps=0.05, scheme="Iso9"))}, {"a": _aniso_faces(True, 0.05, None)}, digits=6)
grid_query("aniso_regularized", lambda m: {"a": anisotropy.aniso_div(P, m, anisotropy.Anisotropy(eps=0.2, regularize=True))}, {"a": _aniso_faces(False, 0.2, _missing(0.2))}, digits=6)

# time
_COUPLED = {"p": lambda n, p="p", q="q": f"({_L(p)(n)}+t.{q})", "q": lambda n, p="p", q="q": f"(0.5*{_L(q)(n)}-t.{p})"}


def _rk4_sql(dt: float) -> str:
    steps, keep = [({f"k0{f}": e for f, e in _COUPLED.items()}, ("p", "q"))], ["p", "q", "k0p", "k0q"]
    for k, w in ((1, 0.5), (2, 0.5), (3, 1.0)):
        steps.append(({f"s{f}": (lambda n, f=f, k=k, w=w: f"t.{f}+{w * dt!r}::DOUBLE*t.k{k - 1}{f}") for f in "pq"}, tuple(keep)))
        steps.append(({f"k{k}{f}": (lambda n, e=e: e(n, "sp", "sq")) for f, e in _COUPLED.items()}, tuple(keep)))
        keep += [f"k{k}p", f"k{k}q"]
    return chain(steps, " SELECT i, j, k, " + ", ".join(f"ROUND({f}+{dt!r}/6*(k0{f}+2*k1{f}+2*k2{f}+k3{f}), 9)+0.0 AS {f}" for f in "pq") + " FROM g7")


@query("coupled_rk4", _rk4_sql(0.125))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(ev.rk4_step(g.with_df(g.df.select("i", "j", "k", "p", "q")), {"p": stencils.laplacian(P, g.mesh) + Q, "q": 0.5 * stencils.laplacian(Q, g.mesh) - P}, 0.125).df, 9)


@query("level_rotation", chain([({"new": lambda n: f"t.p+0.125::DOUBLE*{_L('p')(n)}"}, ("p",))], " SELECT i, j, k, ROUND(new, 9)+0.0 AS p, p AS p__prev FROM g1"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old level stays beside the new one."""
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(ev.euler_step(g.with_df(g.df.select("i", "j", "k", "p")), {"p": stencils.laplacian(P, g.mesh)}, 0.125, previous=True).df, 9)


@query("frame_tracking", with_steps(" SELECT i - 4 AS i, j, k, p, v FROM g WHERE i > 3 UNION ALL SELECT CAST(27 + m AS INT), j, k, p + 0.5 * m, -1.0::DOUBLE FROM g, range(1, 5) r(m) WHERE i = 31"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted until the last cell with v >= 0 is at 27."""
    g = ingest.lineitem_grid(spark, sf_dir)
    frame = MovingFrame(0, {"p": ("slope", 0.5), "v": ("constant", -1.0)})
    return frame.track(g.with_df(g.df.select("i", "j", "k", "p", "v")), lambda x: x.df.filter("v >= 0").agg(F.max("i")).first()[0], 27).df


grid_query("vector_step", lambda m: {n: field(f) + 0.125 * stencils.laplacian(field(f), m) for n, f in zip(names("u", 2), ("ux", "uy"), strict=True)}, {
    "u_0": lambda n: f"t.ux+0.125::DOUBLE*{_L('ux')(n)}", "u_1": lambda n: f"t.uy+0.125::DOUBLE*{_L('uy')(n)}",
}, digits=9)
grid_query("vector_pointwise", lambda m: dict(zip(("a", "b", "c", "d"), (*(Vector((UX, UY)) * P + Vector((P, Q))).parts, *(Vector((V, W)) - Vector((UX, UY)) * 2).parts), strict=True)), {
    "a": lambda n: "t.ux*t.p+t.p", "b": lambda n: "t.uy*t.p+t.q", "c": lambda n: "t.v-2*t.ux", "d": lambda n: "t.w-2*t.uy",
})
grid_query("vector_laplacian", lambda m: {f"l{k}": Schemes().bind(ex.lap(x), m) for k, x in enumerate((P, Q, V))}, {
    f"l{k}": (lambda n, f=f: "+".join(n(f, *_unit(a, s)) for a in range(3) for s in (-1, 1)) + f"-6*t.{f}") for k, f in enumerate("pqv")
}, base=BOX, digits=9)


# faces, ids, tables
@query("face_pointwise", with_steps(f", {_FACE} SELECT i, j, k, (lo + hi) / 2 * (hi - lo) + abs(hi - lo) AS flux FROM f"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, key = _noflux_grid(spark, sf_dir), ["i", "j", "k"]
    both = faces.interpolate(g, "v", 0).join(faces.face_gradient(g, "v", 0).withColumnRenamed("v", "grad"), key)
    return faces.face_pointwise(both, {"flux": F.col("v") * F.col("grad") + F.abs("grad")}).select(*key, "flux")


@query("gather_functor", with_steps(", n AS (SELECT s_nationkey % 5 AS id, CAST(COUNT(*) AS DOUBLE) AS value FROM supplier GROUP BY 1) SELECT i, j, k, CASE WHEN g.id < 0 THEN -p ELSE COALESCE(n.value, 0) * p + g.id END AS got FROM g LEFT JOIN n ON n.id = g.id"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ingest.table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("id")).agg(F.count("*").cast("double").alias("value"))
    got = index.gather_with(ingest.lineitem_grid(spark, sf_dir).df, "id", table, "got", lambda i, value, aux: F.when(i < 0, -aux).otherwise(value * aux + i), F.col("p"))
    return got.select("i", "j", "k", "got")


@query("energy_table_file", with_steps(", u AS (SELECT *, least(floor(p*2), 1) AS a, least(floor(q*2), 1) AS b FROM g), w AS (SELECT *, p*2-a AS x, q*2-b AS y FROM u) SELECT i, j, k, ROUND((1-x)*((1-y)*(a*a+b)+y*(a*a+b+1))+x*((1-y)*((a+1)*(a+1)+b)+y*((a+1)*(a+1)+b+1)), 9)+0.0 AS f FROM w"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table given as text: 3 compositions by 3 temperatures, f = a^2 + b at node (a, b)."""
    table = files.energy_table("# composition, temperature\n3 3 0 1 0 10\n0, 1, 2\n1 2 3 # middle\n4 5 6\n")
    return _rounded(ingest.lineitem_grid(spark, sf_dir).df.select("i", "j", "k", table.lookup(F.col("p"), F.col("q") * 10).alias("f")), 9)


# material scalars, as one row
_TAU = lambda t: f"CASE WHEN {t}<1 THEN 1-(79/(140*0.55*{t})+474.0/497*(1/0.55-1)*(pow({t},3)/6+pow({t},9)/135+pow({t},15)/600))/(518.0/1125+11692.0/15975*(1/0.55-1)) ELSE -(pow({t},-5)/10+pow({t},-15)/315+pow({t},-25)/1500)/(518.0/1125+11692.0/15975*(1/0.55-1)) END"


@query("thermo_functions", f"""WITH e AS (SELECT 0.25::DOUBLE-1/6.0::DOUBLE AS a, -0.5::DOUBLE AS b, 0.05::DOUBLE AS c), r AS (SELECT (-b-sqrt(b*b-4*a*c))/(2*a) AS lo, (-b+sqrt(b*b-4*a*c))/(2*a) AS hi FROM e),
 m AS (SELECT CASE WHEN abs(lo)<=abs(hi) THEN lo ELSE hi END AS mu FROM r)
 SELECT ROUND(mu, 9) AS mu, ROUND(0.2+mu/2, 9) AS cs, ROUND(0.7+mu/3, 9) AS cl, ROUND({_TAU('0.8::DOUBLE')}, 9) AS below, ROUND({_TAU('1.2::DOUBLE')}, 9) AS above,
 ROUND(8.314462618*900*ln(1.5)*({_TAU('(900.0::DOUBLE/700)')})/7e-6, 3) AS glass, 700.0::DOUBLE AS cooled, ROUND(300+700*exp(-0.5::DOUBLE), 9) AS quenched, 300.0::DOUBLE AS clamped FROM m""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common tangent, ordering function on both sides of its kink, glass, and cooling."""
    mu, cs, cl = material.KKS(2.0, 3.0, 0.2, 0.7, 0.1, 0.15).equilibrium()
    cool = material.Cooling(1000.0, 10.0, 300.0, 1200.0)
    row = (round(mu, 9), round(cs, 9), round(cl, 9), round(material.f_tau(0.8), 9), round(material.f_tau(1.2), 9), round(material.amorphous_to_liquid(900, 700, 0.5, 7e-6), 3),
           cool.temperature(30), round(material.Cooling(1000, 0.05, 300, 1200, "newton").temperature(10), 9), cool.temperature(1000))
    return spark.createDataFrame([row], ", ".join(f"{c} double" for c in ("mu", "cs", "cl", "below", "above", "glass", "cooled", "quenched", "clamped")))


@query("parabola_fit", """WITH n AS (SELECT x AS a, pow(x/8.0::DOUBLE-0.4,4)+0.3*pow(x/8.0::DOUBLE-0.4,2) AS f FROM range(9) t(x)), c AS (SELECT a FROM n WHERE a BETWEEN 1 AND 7 AND a/8.0 BETWEEN 0.25 AND 0.75 ORDER BY f, a LIMIT 1),
 w AS (SELECT c.a, MAX(f) FILTER (WHERE n.a=c.a-1) AS lo, MAX(f) FILTER (WHERE n.a=c.a) AS mid, MAX(f) FILTER (WHERE n.a=c.a+1) AS hi FROM n, c GROUP BY c.a),
 k AS (SELECT *, (lo-2*mid+hi)*64 AS k, (hi-lo)*4 AS s FROM w)
 SELECT ROUND(k, 9) AS curvature, ROUND(a/8.0-s/k, 9) AS composition, ROUND(mid-s*s/(2*k), 9) AS energy, ROUND(1.5*pow(0.1,4)+0.45*pow(0.1,2), 9) AS at_half, 2.5::DOUBLE AS fallback FROM k""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parabola through the lowest node of a window; a mobility read from a table, or its fallback."""
    f = lambda a: (a / 8 - 0.4) ** 4 + 0.3 * (a / 8 - 0.4) ** 2
    table = material.EnergyTable(tuple((f(a), 2 * f(a)) for a in range(9)), (0.0, 1.0), (0.0, 1.0))
    row = (*(round(x, 9) for x in table.parabola(0.0, (0.25, 0.75))), round(material.mobility(table, 0.5, 1.0), 9), material.mobility(None, 0.5, 2.5))
    return spark.createDataFrame([row], "curvature double, composition double, energy double, at_half double, fallback double")


# schemes by name for the other families
grid_query("sym_more_schemes", lambda m: (lambda s: {"a": s.bind(ex.grad_sq(P), m), "b": s.bind(ex.derivative(V, 0, 2), m), "c": s.bind(ex.div_grad(P, Q), m), "d": s.bind(ex.lap(V), m)})(
    Schemes({"gradSq": {"default": "CD2"}, "secondDerivative": {"d2(v,x,x)": "CD4", "default": "CD4"}, "divGrad": {"default": "CD2"}}, {"laplacian": "Iso9"})), {
    "a": lambda n: f"pow({_D('p', 0)(n)},2)+pow({_D('p', 1)(n)},2)", "b": _axis("v", *_W4, 0), "c": lambda n: "+".join(f"0.5::DOUBLE*(t.p+{n('p', *o)})*({n('q', *o)}-t.q)" for o in _AX), "d": _ISO("v"),
}, digits=6)
grid_query("gradient_cd4_reflect", lambda m: {"g": Schemes({"gradient": {"grad(v)": "CD4"}}).bind(ex.derivative(V, 1), m)}, {"g": _axis("v", *_F4, 1)}, "reflect", digits=6)

# boundaries from settings, and rules that are functions
grid_query("boundary_from_settings", lambda m: {"lap": stencils.laplacian(V, m)}, {
    "lap": lambda n: "CASE WHEN t.i=31 THEN 5.0::DOUBLE ELSE (SELECT x.v FROM g x WHERE x.i=t.i+1 AND x.j=t.j) END+CASE WHEN t.i=0 THEN t.v ELSE (SELECT x.v FROM g x WHERE x.i=t.i-1 AND x.j=t.j) END+(SELECT x.v FROM g x WHERE x.i=t.i AND x.j=(t.j+1)%24)+(SELECT x.v FROM g x WHERE x.i=t.i AND x.j=(t.j+23)%24)-4*t.v",
}, boundary=from_config({"x_min": {"type": "noflux"}, "x_max": {"type": "fixed", "value": 5}, "y_min": "periodic", "y_max": "periodic"}, Mesh.uniform(32, 24)))


_edge = lambda i, j: f"(SELECT x.v FROM g x WHERE x.i={i} AND x.j={j})"
_IN = f"{_edge('t.i', '(t.j+1)%24')}+{_edge('t.i', '(t.j+23)%24')}-4*t.v"
grid_query("boundary_function", lambda m: {"lap": stencils.laplacian(V, m)}, {
    "lap": lambda n: f"CASE WHEN t.i=31 THEN 6-t.v ELSE {_edge('t.i+1', 't.j')} END+CASE WHEN t.i=0 THEN 2*t.v-{_edge('1', 't.j')} ELSE {_edge('t.i-1', 't.j')} END+{_IN}",
}, boundary=Boundary((custom(lambda cell, d: cell(0) + d * (cell(0) - cell(1))), wall_value(3.0)), (PERIODIC, PERIODIC)))
_PARTED = Mesh((32, 24, 1), patches=(Patch("inlet", 0, 1, (31, 0, 0), (32, 10, 1)), Patch("wall", 0, 1, (31, 10, 0), (32, 24, 1))))
grid_query("boundary_by_patch", lambda m: {"lap": stencils.laplacian(V, m), "c": ex.at("v", (1, 1, 0))}, {
    "lap": lambda n: f"CASE WHEN t.i=31 THEN CASE WHEN t.j<10 THEN 7.0::DOUBLE ELSE t.v END ELSE {_edge('t.i+1', 't.j')} END+CASE WHEN t.i=0 THEN t.v ELSE {_edge('t.i-1', 't.j')} END+{_edge('t.i', 'least(t.j+1, 23)')}+{_edge('t.i', 'greatest(t.j-1, 0)')}-4*t.v",
    "c": lambda n: f"CASE WHEN t.i=31 AND least(t.j+1, 23)<10 THEN 7.0::DOUBLE ELSE {_edge('least(t.i+1, 31)', 'least(t.j+1, 23)')} END",
}, boundary=Boundary((NOFLUX, by_patch({"inlet": fixed(7.0), "wall": NOFLUX}, _PARTED)), (NOFLUX, NOFLUX)))


# files
def _case(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/cases/{name}-{uuid.uuid4().hex}"


def _file_query(name: str, kind: str, columns: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = ingest.lineitem_grid(spark, sf_dir)
        g = g.with_df(g.df.select("i", "j", "k", *[F.col(c).alias(f"a_{n}" if len(columns) > 1 else "a") for n, c in enumerate(columns)]))
        path = f"{_case(spark, name)}/a.{'dat' if kind == 'DAT' else 'field'}"
        files.write(g.df, g.mesh, path, "a", kind, [c for c in g.df.columns if c.startswith("a")])
        return files.read(spark, path, g.mesh, "a", len(columns)).drop("file")

    listed = ", ".join(f"{c} AS a_{n}" if len(columns) > 1 else f"{c} AS a" for n, c in enumerate(columns))
    query(name, with_steps(f" SELECT i, j, k, {listed} FROM g"))(run)


_file_query("file_binary", "BINARY", ("p",))
_file_query("file_text", "DAT", ("p",))
_file_query("file_vector", "BINARY", ("ux", "uy"))


# long runs on packed tiles
C, MU = field("c"), field("mu")


def spinodal_parts(mesh: Mesh, c: Expr = C) -> tuple[dict[str, Expr], dict[str, Expr], dict[str, Expr]]:
    """(definitions, rates, energy density and amount) of the spinodal benchmark."""
    define = {"mu": 10 * (c - 0.3) * (c - 0.7) * (2 * c - 1) - 2 * stencils.laplacian(c, mesh)}
    sums = {"free_energy": mesh.volume * (5 * (c - 0.3) * (c - 0.3) * (0.7 - c) * (0.7 - c) + stencils.grad_squared(c, mesh)), "total_c": mesh.volume * c}
    return define, {"c": 5 * stencils.laplacian(MU, mesh)}, sums


def spinodal_start(spark: SparkSession, n: int, tile: tuple[int, int]) -> Blocks:
    """The benchmark's composition, sampled at cell corners as in its published runs."""
    mesh = Mesh.uniform(n, n, origin=(-0.5, -0.5))
    return Blocks.of(make(spark, mesh, {"c": spinodal()}, Boundary.all(PERIODIC)), tile)


_CH = [({"mu": lambda n: f"2*(t.c-0.25::DOUBLE)*(t.c-0.75::DOUBLE)*(2*t.c-1)-0.5*{_L('c')(n)}"}, ("c",)), ({"c": lambda n: f"t.c+0.03125::DOUBLE*{_L('mu')(n)}"}, ())]


@query("spinodal_blocks", chain([({"c": lambda n: "t.p"}, ()), *_CH * 4], _fields(9, "g9", "c")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps on four tiles, three of them between two exchanges."""
    g = ingest.lineitem_grid(spark, sf_dir)
    blocks = Blocks.of(g.with_df(g.df.select("i", "j", "k", F.col("p").alias("c"))), (16, 12))
    define = {"mu": 2 * (C - 0.25) * (C - 0.75) * (2 * C - 1) - 0.5 * stencils.laplacian(C, g.mesh)}
    return _rounded(blocks.advance({"c": stencils.laplacian(MU, g.mesh)}, 0.03125, 4, define, 3).grid().df, 9)


_WAVES = "0.5+0.01*(cos(0.105*{x})*cos(0.11*{y})+pow(cos(0.13*{x})*cos(0.087*{y}),2)+cos(0.025*{x}-0.15*{y})*cos(0.07*{x}-0.02*{y}))"
_WAVE = lambda x, y: "(" + _WAVES.replace("{x}", x).replace("{y}", y) + ")"


@query("spinodal_energy", f"""WITH s AS (SELECT x, y, {_WAVE('x', 'y')} AS c, {_WAVE('((x+1)%200)', 'y')}-{_WAVE('((x+199)%200)', 'y')} AS dx, {_WAVE('x', '((y+1)%200)')}-{_WAVE('x', '((y+199)%200)')} AS dy FROM range(200) a(x), range(200) b(y))
 SELECT ROUND(SUM(5*pow((c-0.3)*(0.7-c),2)+(dx*dx+dy*dy)/4), 6) AS free_energy, ROUND(SUM(c), 6) AS total_c FROM s""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's first energy, 319.093816, on 200 x 200 cells."""
    blocks = spinodal_start(spark, 200, (100, 50))
    return _rounded(blocks.sums(spinodal_parts(blocks.mesh)[2]), 6)
