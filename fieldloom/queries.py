"""Every grid operator as a query over the driver's tables, with DuckDB SQL beside it.

Fields come from integer sums, so most results are exact in both engines;
those that are not are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import models, oracle
from .functions import material
from .mesh import Mesh
from .operators import anisotropy, diagnostics, elastic, faces, index, lattice, mask, meshmap, noise, reduce, simplex, solvers, stencils
from .operators.boundary import NOFLUX, PERIODIC, REFLECT, Boundary, fixed
from .oracle import BOX, GRID, LINE, chain, sql, with_steps
from .plans import expr as ex
from .plans.arrays import evolve
from .plans.expr import Expr, Vector, coord, field
from .plans.lower import Grid
from .plans.schemes import Schemes
from .plans.system import System
from .sources import ingest
from .sources.initial import make, named
from .streaming import evolve as ev
from .streaming.frame import MovingFrame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
V, W, P, Q, UX, UY = (field(n) for n in ("v", "w", "p", "q", "ux", "uy"))
SIDES = {"periodic": PERIODIC, "noflux": NOFLUX, "reflect": REFLECT, "fixed": fixed(2.0)}


def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if text:
            ORACLES[name] = text
        return fn

    return put


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.select(*[F.round(c, digits) + F.lit(0.0) if t == "double" else F.col(c) for c, t in df.dtypes]).toDF(*df.columns)


def grid_query(name: str, outputs: Callable[[Mesh], dict[str, Expr]], formulas: dict, rule: str = "periodic", digits: int | None = None, base: str = GRID, d: tuple[float, float] = (1.0, 1.0), boundary: Boundary | None = None) -> None:
    """A query of expressions over the grid and its SQL formulas."""
    side = boundary or Boundary.all(SIDES[rule])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = {GRID: lambda: ingest.lineitem_grid(spark, sf_dir, side, d=d), BOX: lambda: ingest.lineitem_box(spark, sf_dir, side), LINE: lambda: replace(ingest.event_line(spark, sf_dir), default=side)}[base]()
        return _rounded(grid.select(outputs(grid.mesh)), digits)

    QUERIES[name] = run
    ORACLES[name] = sql(formulas, rule, 2.0, base, digits)


@query("grid_from_lineitem", with_steps(" SELECT i, j, k, v, w, p, q, ux, uy, id FROM g"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.lineitem_grid(spark, sf_dir).df


@query("init_analytic", """SELECT CAST(a AS INT) i, CAST(b AS INT) j, 0 k, ROUND(sin(0.5 * (a + 0.5)) * cos(0.25 * (1.0 + (b + 0.5) * 2.0)), 6) + 0.0 f, 0.25::DOUBLE u,
 (a + 0.5::DOUBLE) / 40 * 3 - 1 lin FROM range(40) x(a), range(30) y(b)""")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = Mesh.uniform(40, 30, d=(1.0, 2.0), origin=(0.0, 1.0))
    grid = make(spark, mesh, {"f": ex.call("sin", 0.5 * coord(0)) * ex.call("cos", 0.25 * coord(1)), "u": "uniform:0.25"})
    return grid.df.select("i", "j", "k", (F.round("f", 6) + F.lit(0.0)).alias("f"), "u", ((F.col("i") + F.lit(0.5)) / 40 * 3 - 1).alias("lin"))


@query("init_named", """SELECT CAST(a AS INT) i, 0 j, 0 k, ROUND((a + 0.5) / 64 * 8 - 4, 9) + 0.0 lin FROM range(64) x(a)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = Mesh.uniform(64)
    return mesh.frame(spark).withColumn("lin", F.round(named("linear:x:-4:4", mesh), 9) + F.lit(0.0))


# pointwise algebra
grid_query("pw_double_well", lambda m: {"f": material.double_well(P), "fp": material.double_well_prime(P), "h3": material.h_cubic(P), "h5": material.h_quintic(P), "h5p": material.h_quintic_prime(P)}, {
    "f": lambda n: "t.p*t.p*(1-t.p)*(1-t.p)", "fp": lambda n: "2*t.p*(1-t.p)*(1-2*t.p)", "h3": lambda n: "t.p*t.p*(3-2*t.p)",
    "h5": lambda n: "t.p*t.p*t.p*(t.p*(6*t.p-15)+10)", "h5p": lambda n: "30*t.p*t.p*(1-t.p)*(1-t.p)",
})
grid_query("pw_arithmetic", lambda m: {"a": P + Q, "b": P - 2 * Q, "c": -P * Q, "d": V / (W + 1), "dot": Vector((UX, UY)).dot(Vector((P, Q)))}, {
    "a": lambda n: "t.p+t.q", "b": lambda n: "t.p-2*t.q", "c": lambda n: "-t.p*t.q", "d": lambda n: "t.v/(t.w+1)", "dot": lambda n: "t.ux*t.p+t.uy*t.q",
})
grid_query("pw_functions", lambda m: {
    "a": ex.call("sin", P), "b": ex.call("cos", P), "c": ex.call("tanh", P - Q), "d": ex.call("exp", -P), "e": ex.call("log", 1 + P), "f": ex.call("sqrt", P), "g": ex.call("abs", UX),
    "h": P**3, "o": ex.atan2(UY, UX + 0.5), "r": ex.hypot(UX, UY),
}, {
    "a": lambda n: "sin(t.p)", "b": lambda n: "cos(t.p)", "c": lambda n: "tanh(t.p-t.q)", "d": lambda n: "exp(-t.p)", "e": lambda n: "ln(1+t.p)", "f": lambda n: "sqrt(t.p)", "g": lambda n: "abs(t.ux)",
    "h": lambda n: "pow(t.p,3)", "o": lambda n: "atan2(t.uy,t.ux+0.5::DOUBLE)", "r": lambda n: "sqrt(t.ux*t.ux+t.uy*t.uy)",
}, digits=6)
grid_query("pw_predicates", lambda m: {"a": ex.where((P > 0.5) & (Q <= 0.25), P, -Q), "b": ex.where((UX < 0) | (UY >= 1), 1.0, 0.0), "lo": ex.minimum(P, Q), "hi": ex.maximum(P, Q)}, {
    "a": lambda n: "CASE WHEN t.p > 0.5 AND t.q <= 0.25 THEN t.p ELSE -t.q END", "b": lambda n: "CASE WHEN t.ux < 0 OR t.uy >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "lo": lambda n: "least(t.p,t.q)", "hi": lambda n: "greatest(t.p,t.q)",
})

# Laplacians and boundary rules
LAP = {"lap": lambda n: f"{n('v', 1)}+{n('v', -1)}+{n('v', 0, 1)}+{n('v', 0, -1)}-4*t.v"}
for _rule in SIDES:
    grid_query(f"lap_cd2_{_rule}", lambda m: {"lap": stencils.laplacian(V, m)}, LAP, _rule)
    if _rule != "fixed":
        grid_query(f"corner_{_rule}", lambda m: {"c": ex.shift(V, (1, 1, 0)) - ex.shift(V, (-2, 3, 0))}, {"c": lambda n: f"{n('v', 1, 1)}-{n('v', -2, 3)}"}, _rule)
grid_query("corner_mixed", lambda m: {"c": ex.shift(V, (1, 1, 0)) + 2 * ex.shift(V, (-1, -1, 0))}, {
    "c": lambda n: "CASE WHEN t.i = 31 THEN 7.0::DOUBLE ELSE (SELECT x.v FROM g x WHERE x.i = t.i + 1 AND x.j = (t.j + 1) % 24) END + 2 * CASE WHEN t.i = 0 THEN 7.0::DOUBLE ELSE (SELECT x.v FROM g x WHERE x.i = t.i - 1 AND x.j = (t.j + 23) % 24) END",
}, boundary=Boundary((fixed(7.0), fixed(7.0)), (PERIODIC, PERIODIC)))


def _axis(f: str, weights: dict[int, int], scale: int, axis: int) -> Callable:
    return lambda n: "(" + "+".join(f"({w})*{n(f, *(o if a == axis else 0 for a in range(3)))}" for o, w in weights.items()) + f")/{scale}.0::DOUBLE"


_W4, _W6 = ({-2: -1, -1: 16, 0: -30, 1: 16, 2: -1}, 12), ({-3: 2, -2: -27, -1: 270, 0: -490, 1: 270, 2: -27, 3: 2}, 180)
for _scheme, (_w, _s) in {"cd4": _W4, "cd6": _W6}.items():
    for _rule in ("periodic", "reflect"):
        grid_query(f"lap_{_scheme}_{_rule}", lambda m, s=_scheme.upper(): {"lap": stencils.laplacian(V, m, s)}, {"lap": lambda n, w=_w, s=_s: f"{_axis('v', w, s, 0)(n)}+{_axis('v', w, s, 1)(n)}"}, _rule, digits=6)
_ISO = lambda f: lambda n: f"(4*({n(f, 1)}+{n(f, -1)}+{n(f, 0, 1)}+{n(f, 0, -1)})+{n(f, 1, 1)}+{n(f, 1, -1)}+{n(f, -1, 1)}+{n(f, -1, -1)}-20*t.{f})/6.0::DOUBLE"
for _rule in ("periodic", "noflux"):
    grid_query(f"lap_iso9_{_rule}", lambda m: {"lap": stencils.laplacian(V, m, "Iso9")}, {"lap": _ISO("v")}, _rule)
_F4, _F6 = ({-2: 1, -1: -8, 1: 8, 2: -1}, 12), ({-3: -1, -2: 9, -1: -45, 1: 45, 2: -9, 3: 1}, 60)
for _scheme, (_w, _s) in {"cd2": ({-1: -1, 1: 1}, 2), "cd4": _F4, "cd6": _F6}.items():
    grid_query(f"grad_{_scheme}", lambda m, s=_scheme.upper(): {"gx": stencils.first(V, 0, m, s), "gy": stencils.first(V, 1, m, s)}, {"gx": _axis("v", _w, _s, 0), "gy": _axis("v", _w, _s, 1)}, digits=6)
_GX = lambda f: lambda n: f"(4*({n(f, 1)}-{n(f, -1)})+({n(f, 1, 1)}-{n(f, -1, 1)})+({n(f, 1, -1)}-{n(f, -1, -1)}))/12.0::DOUBLE"
_GY = lambda f: lambda n: f"(4*({n(f, 0, 1)}-{n(f, 0, -1)})+({n(f, 1, 1)}-{n(f, 1, -1)})+({n(f, -1, 1)}-{n(f, -1, -1)}))/12.0::DOUBLE"
grid_query("grad_iso9", lambda m: {"gx": stencils.first(V, 0, m, "Iso9"), "gy": stencils.first(V, 1, m, "Iso9")}, {"gx": _GX("v"), "gy": _GY("v")}, digits=6)
_D = lambda f, a, h=2.0: (lambda n: f"(({n(f, *(1 if a == b else 0 for b in range(3)))}-{n(f, *(-1 if a == b else 0 for b in range(3)))})/{h}::DOUBLE)")
grid_query("grad_dot", lambda m: {"g": stencils.grad_dot(P, Q, m)}, {"g": lambda n: f"{_D('p', 0)(n)}*{_D('q', 0)(n)}+{_D('p', 1)(n)}*{_D('q', 1)(n)}"})
grid_query("gradsq_cd2", lambda m: {"g": stencils.grad_squared(V, m)}, {"g": lambda n: f"pow({_D('v', 0)(n)},2)+pow({_D('v', 1)(n)},2)"}, "noflux")
grid_query("gradsq_iso9", lambda m: {"g": stencils.grad_squared(P, m, "Iso9")}, {
    "g": lambda n: f"2.0::DOUBLE/3*(pow({_D('p', 0)(n)},2)+pow({_D('p', 1)(n)},2))+(pow({n('p', 1, 1)}-{n('p', -1, -1)},2)+pow({n('p', -1, 1)}-{n('p', 1, -1)},2))/24.0::DOUBLE",
}, digits=12)
grid_query("second_derivatives", lambda m: {"dxx": stencils.second(V, 0, m, "CD4"), "dyy": stencils.second(V, 1, m), "dxy": stencils.mixed(V, (0, 1), m), "dxy4": stencils.mixed(V, (0, 1), m, "CD4")}, {
    "dxx": _axis("v", *_W4, 0), "dyy": _axis("v", {-1: 1, 0: -2, 1: 1}, 1, 1), "dxy": lambda n: f"({n('v', 1, 1)}-{n('v', 1, -1)}-{n('v', -1, 1)}+{n('v', -1, -1)})/4.0::DOUBLE",
    "dxy4": lambda n: "(" + "+".join(f"({a * b})*{n('v', o, p)}" for o, a in _F4[0].items() for p, b in _F4[0].items()) + ")/144.0::DOUBLE",
}, digits=6)
grid_query("lap_of_expression", lambda m: {"a": stencils.laplacian(P * P - Q, m)}, {
    "a": lambda n: "+".join(f"({n('p', *o)}*{n('p', *o)}-{n('q', *o)})" for o in ((1, 0), (-1, 0), (0, 1), (0, -1))) + "-4*(t.p*t.p-t.q)",
})
grid_query("weighted_stencils", lambda m: {"a": stencils.weighted_sum(V, {(0, 0, 0): 0.5, (2, 0, 0): 0.25, (0, -2, 0): 0.25}), "b": stencils.weighted_differences(V, {(1, 1, 0): 1, (-1, -1, 0): -1}), "c": ex.shift(P * Q, (2, -1, 0))}, {
    "a": lambda n: f"0.5::DOUBLE*t.v+0.25::DOUBLE*{n('v', 2)}+0.25::DOUBLE*{n('v', 0, -2)}", "b": lambda n: f"{n('v', 1, 1)}-{n('v', -1, -1)}", "c": lambda n: f"{n('p', 2, -1)}*{n('q', 2, -1)}",
})
_UW1 = lambda f: lambda n: "+".join(f"t.{u}*CASE WHEN t.{u}>0 THEN t.{f}-{n(f, *b)} ELSE {n(f, *a)}-t.{f} END" for u, a, b in (("ux", (1, 0), (-1, 0)), ("uy", (0, 1), (0, -1))))
grid_query("adv_uw1", lambda m: {"a": stencils.advection((UX, UY), V, m)}, {"a": _UW1("v")})
grid_query("adv_uw2", lambda m: {"a": stencils.advection((UX, UY), V, m, "UW2")}, {
    "a": lambda n: "+".join(f"t.{u}*CASE WHEN t.{u}>0 THEN (3*t.v-4*{n('v', *b1)}+{n('v', *b2)})/2 ELSE (-3*t.v+4*{n('v', *a1)}-{n('v', *a2)})/2 END"
                            for u, a1, a2, b1, b2 in (("ux", (1, 0), (2, 0), (-1, 0), (-2, 0)), ("uy", (0, 1), (0, 2), (0, -1), (0, -2)))),
})


def _weno_sql(f: str) -> Callable:
    def slope(d: list[str]) -> str:
        a, b, c, e, g = d
        s = [f"(13.0::DOUBLE/12*pow({a}-2*{b}+{c},2)+0.25::DOUBLE*pow({a}-4*{b}+3*{c},2))", f"(13.0::DOUBLE/12*pow({b}-2*{c}+{e},2)+0.25::DOUBLE*pow({b}-{e},2))", f"(13.0::DOUBLE/12*pow({c}-2*{e}+{g},2)+0.25::DOUBLE*pow(3*{c}-4*{e}+{g},2))"]
        w = [f"({k}::DOUBLE/pow({x}+1e-6::DOUBLE,2))" for k, x in zip((0.1, 0.6, 0.3), s, strict=True)]
        p = [f"(2*{a}-7*{b}+11*{c})/6", f"(-{b}+5*{c}+2*{e})/6", f"(2*{c}+5*{e}-{g})/6"]
        return "(" + "+".join(f"{x}*{y}" for x, y in zip(w, p, strict=True)) + ")/(" + "+".join(w) + ")"

    def out(n: Callable) -> str:
        parts = []
        for u, axis in (("ux", 0), ("uy", 1)):
            at = lambda by, axis=axis: n(f, *(by if a == axis else 0 for a in range(3)))
            diff = lambda by, at=at: f"({at(by + 1)}-{at(by)})"
            parts.append(f"t.{u}*CASE WHEN t.{u}>0 THEN {slope([diff(k) for k in (-3, -2, -1, 0, 1)])} ELSE {slope([diff(k) for k in (2, 1, 0, -1, -2)])} END")
        return "+".join(parts)

    return out


grid_query("adv_weno5", lambda m: {"a": stencils.advection((UX, UY), P, m, "WENO5")}, {"a": _weno_sql("p")}, digits=6)

# links
_AX = ((1, 0), (-1, 0), (0, 1), (0, -1))
grid_query("divgrad_cd2", lambda m: {"a": stencils.div_grad(P, Q, m)}, {"a": lambda n: "+".join(f"0.5::DOUBLE*(t.p+{n('p', *o)})*({n('q', *o)}-t.q)" for o in _AX)}, digits=9)


def _mean6(n: Callable, f: str, o: tuple[int, int]) -> str:
    side = (0, 1) if o[0] else (1, 0)
    at = lambda x, y: n(f, x, y)
    ends = "+".join(at(x + s * side[0], y + s * side[1]) for x, y in ((0, 0), o) for s in (-1, 1))
    return f"(6*(t.{f}+{at(*o)})+{ends})/16.0::DOUBLE"


grid_query("divgrad_iso9", lambda m: {"a": stencils.div_grad(P, Q, m, "Iso9")}, {
    "a": lambda n: "2.0::DOUBLE/3*(" + "+".join(f"{_mean6(n, 'p', o)}*({n('q', *o)}-t.q)" for o in _AX) + ")+1.0::DOUBLE/6*("
    + "+".join(f"0.25::DOUBLE*(t.p+{n('p', x, y)}+{n('p', x, 0)}+{n('p', 0, y)})*({n('q', x, y)}-t.q)" for x in (-1, 1) for y in (-1, 1)) + ")",
}, digits=12)


def _normal_sql(n: Callable) -> str:
    parts = []
    for ox, oy in _AX:
        along = f"({n('q', ox, oy)}-t.q)"
        s = (0, 1) if ox else (1, 0)
        across = f"0.25::DOUBLE*({n('q', *s)}+{n('q', ox + s[0], oy + s[1])}-{n('q', -s[0], -s[1])}-{n('q', ox - s[0], oy - s[1])})"
        norm = f"sqrt(pow({along},2)+pow({across},2))"
        amount = f"(0.5::DOUBLE*(t.p+{n('p', ox, oy)}))"
        parts.append(f"CASE WHEN {amount}<>0 AND {norm}>0 THEN {amount}*{along}/greatest({norm},0.01::DOUBLE) ELSE 0.0::DOUBLE END")
    return "+".join(parts)


grid_query("divnormal_cd2", lambda m: {"a": stencils.div_normal(P, Q, m, "CD2", 0.01)}, {"a": _normal_sql}, digits=6)

# three dimensions
grid_query("lap_3d", lambda m: {"cd2": stencils.laplacian(V, m), "iso": stencils.laplacian(V, m, "Iso27")}, {
    "cd2": lambda n: "+".join(n("v", *o) for o in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))) + "-6*t.v",
    "iso": lambda n: "(" + "+".join(f"({(-128, 14, 3, 1)[abs(x) + abs(y) + abs(z)]})*{n('v', x, y, z)}" for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)) + ")/30.0::DOUBLE",
}, base=BOX, digits=6)
grid_query("curl_div_3d", lambda m: (lambda b: {"cx": b(Vector((P, Q, V)).curl().parts[0]), "cy": b(Vector((P, Q, V)).curl().parts[1]), "cz": b(Vector((P, Q, V)).curl().parts[2]), "div": b(Vector((P, Q, V)).divergence())})(lambda e: Schemes().bind(e, m)), {
    "cx": lambda n: f"{_D('v', 1)(n)}-{_D('q', 2)(n)}", "cy": lambda n: f"{_D('p', 2)(n)}-{_D('v', 0)(n)}", "cz": lambda n: f"{_D('q', 0)(n)}-{_D('p', 1)(n)}",
    "div": lambda n: f"{_D('p', 0)(n)}+{_D('q', 1)(n)}+{_D('v', 2)(n)}",
}, base=BOX)

# faces
_AVG = lambda n, f, o: f"(0.5::DOUBLE*(t.{f}+{n(f, *o)}))"
grid_query("divface_assembled", lambda m: {"a": faces.assembled(m, lambda f: f.interp(P) * f.gradient(Q)), "w": faces.assembled(m, lambda f: f.interp(P) * f.gradient(Q), P > 0.5)}, {
    "a": lambda n: "+".join(f"{_AVG(n, 'p', o)}*({n('q', *o)}-t.q)" for o in _AX), "w": lambda n: "CASE WHEN t.p>0.5 THEN " + "+".join(f"{_AVG(n, 'p', o)}*({n('q', *o)}-t.q)" for o in _AX) + " ELSE 0.0::DOUBLE END",
}, "noflux", digits=9)
_FACE = """f AS (SELECT a.f AS i, c.j, 0 AS k, l.v AS lo, h.v AS hi, l.q AS qlo, h.q AS qhi, a.f FROM (SELECT CAST(x AS INT) f FROM range(33) t(x)) a CROSS JOIN (SELECT DISTINCT j FROM g) c
 JOIN g l ON l.j = c.j AND l.i = greatest(a.f - 1, 0) JOIN g h ON h.j = c.j AND h.i = least(a.f, 31))"""


def _noflux_grid(spark: SparkSession, sf_dir: str) -> Grid:
    return ingest.lineitem_grid(spark, sf_dir, Boundary())


@query("face_values", with_steps(f", {_FACE} SELECT i, j, k, (lo + hi) / 2 AS lin, CASE WHEN f = 0 THEN hi WHEN f = 32 THEN lo ELSE (lo + hi) / 2 END AS near, hi - lo AS grad FROM f"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, key = _noflux_grid(spark, sf_dir), ["i", "j", "k"]
    lin = faces.interpolate(g, "v", 0).withColumnRenamed("v", "lin")
    near = faces.interpolate(g, "v", 0, "Nearest").withColumnRenamed("v", "near")
    return lin.join(near, key).join(faces.face_gradient(g, "v", 0).withColumnRenamed("v", "grad"), key)


@query("div_face", with_steps(f", {_FACE} SELECT g.i, g.j, g.k, h.lo * h.qhi - l.lo * l.qhi AS div FROM g JOIN f l ON l.i = g.i AND l.j = g.j JOIN f h ON h.i = g.i + 1 AND h.j = g.j"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _noflux_grid(spark, sf_dir)
    flux = faces.face_table(g, 0, {"f": lambda n: ex.shift(V, stencils.step(0, n(-1))) * ex.shift(Q, stencils.step(0, n(0)))})
    return faces.divergence(g.mesh, {0: flux}, "f")


@query("face_tangential", with_steps(""", e AS (SELECT g.*, u.v AS up, d.v AS down FROM g JOIN g u ON u.i = g.i AND u.j = least(g.j + 1, 23) JOIN g d ON d.i = g.i AND d.j = greatest(g.j - 1, 0))
 SELECT CAST(a.f AS INT) AS i, l.j, 0 AS k, 0.25::DOUBLE * (l.up - l.down + h.up - h.down) AS v FROM range(33) a(f) JOIN e l ON l.i = greatest(a.f - 1, 0) JOIN e h ON h.j = l.j AND h.i = least(a.f, 31)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.face_tangential(_noflux_grid(spark, sf_dir), "v", 0, 1)


_MASK = "m AS (SELECT *, CASE WHEN (i + 0.5 - 16) * (i + 0.5 - 16) + (j + 0.5 - 12) * (j + 0.5 - 12) < 81 THEN 1 ELSE 0 END AS mask FROM g)"


def _masked(spark: SparkSession, sf_dir: str) -> Grid:
    x, y = coord(0) - 16, coord(1) - 12
    return mask.build(_noflux_grid(spark, sf_dir), x * x + y * y < 81)


@query("mask_sum", with_steps(f", {_MASK} SELECT SUM(v) AS total FROM m WHERE mask = 1"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.masked_sum(_masked(spark, sf_dir).df, "v")


@query("mirror_closure", with_steps(f""", {_MASK} SELECT t.i, t.j, t.k, CASE WHEN t.mask = 1 OR COUNT(n.v) = 0 THEN t.v ELSE SUM(n.v) / COUNT(n.v) END AS v
 FROM m t LEFT JOIN m n ON n.mask = 1 AND abs(n.i - t.i) + abs(n.j - t.j) = 1 GROUP BY t.i, t.j, t.k, t.mask, t.v"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mirror_closure(_masked(spark, sf_dir), "v").df.select("i", "j", "k", "v")


@query("mask_faces", with_steps(f", {_MASK}, {_FACE} SELECT f.i, f.j, f.k, CASE WHEN l.mask = 1 AND h.mask = 1 THEN hi - lo ELSE 0.0::DOUBLE END AS v FROM f LEFT JOIN m l ON l.i = f.i - 1 AND l.j = f.j LEFT JOIN m h ON h.i = f.i AND h.j = f.j"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _masked(spark, sf_dir)
    return mask.mask_faces(g, faces.face_gradient(g, "v", 0), "v", 0)


# anisotropy
def _aniso_sql(theta: bool = False, cutoff: float = 0.0) -> Callable:
    def flux(n: Callable, axis: int, at: tuple[int, int]) -> str:
        o = lambda x, y: n("p", at[0] + x, at[1] + y)
        ahead, side = ((1, 0), (0, 1)) if axis == 0 else ((0, 1), (1, 0))
        pn = f"({o(*ahead)}-{o(0, 0)})"
        pt = f"(0.25::DOUBLE*({o(*side)}-{o(-side[0], -side[1])}+{o(ahead[0] + side[0], ahead[1] + side[1])}-{o(ahead[0] - side[0], ahead[1] - side[1])}))"
        px, py = (pn, pt) if axis == 0 else (pt, pn)
        t0 = f"(CASE WHEN {o(*ahead)}>{o(0, 0)} THEN {n('q', at[0] + ahead[0], at[1] + ahead[1])} ELSE {n('q', *at)} END)" if theta else "0.3::DOUBLE"
        still = f"({px}*{px}+{py}*{py}<=1e-150)"
        angle = f"(4*(atan2({py},{px})-{t0}))"
        a, s = f"(1+0.05::DOUBLE*CASE WHEN {still} THEN 0.0::DOUBLE ELSE cos({angle}) END)", f"(0.2::DOUBLE*CASE WHEN {still} THEN 0.0::DOUBLE ELSE sin({angle}) END)"
        return f"({a}*({a}*{pn}{'+' if axis == 0 else '-'}{s}*{pt}))"

    def out(n: Callable) -> str:
        own = f"({flux(n, 0, (0, 0))}-{flux(n, 0, (-1, 0))}+{flux(n, 1, (0, 0))}-{flux(n, 1, (0, -1))})"
        return own if not cutoff else f"CASE WHEN abs(1-t.p*t.p)<{cutoff} THEN {'+'.join(n('p', *o) for o in _AX)}-4*t.p ELSE {own} END"

    return out


grid_query("aniso_div", lambda m: {"a": anisotropy.aniso_div(P, m, anisotropy.Anisotropy(eps=0.05, theta0=0.3)), "c": anisotropy.aniso_div(P, m, anisotropy.Anisotropy(eps=0.05, theta0=0.3, cutoff=0.3))}, {"a": _aniso_sql(), "c": _aniso_sql(cutoff=0.3)}, digits=6)
grid_query("aniso_div_theta", lambda m: {"a": anisotropy.aniso_div(P, m, anisotropy.Anisotropy(eps=0.05), Q)}, {"a": _aniso_sql(True)}, digits=6)
grid_query("aniso_factor", lambda m: {"a": anisotropy.aniso_factor(P, m, anisotropy.Anisotropy(eps=0.05, theta0=0.3))}, {
    "a": lambda n: (lambda x, y: f"1+0.05::DOUBLE*CASE WHEN {x}*{x}+{y}*{y}<=1e-150 THEN 0.0::DOUBLE ELSE cos(4*(atan2({y},{x})-0.3::DOUBLE)) END")(_D("p", 0)(n), _D("p", 1)(n)),
}, digits=6)


def _cubic_sql(n: Callable) -> str:
    g = [_D("p", a)(n) for a in range(3)]
    size = "+".join(f"{x}*{x}" for x in g)
    return f"CASE WHEN {size}<=1e-150 THEN 1.0::DOUBLE ELSE 1-3*0.02::DOUBLE+4*0.02::DOUBLE*({'+'.join(f'pow({x},4)' for x in g)})/pow({size},2) END"


grid_query("aniso_factor_3d", lambda m: {"a": anisotropy.aniso_factor_3d(P, m, anisotropy.Anisotropy3D(eps=0.02))}, {"a": _cubic_sql}, base=BOX, digits=6)


@query("aniso_div_3d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_box(spark, sf_dir)
    return _rounded(g.select({"a": anisotropy.aniso_div_3d(P, g.mesh, anisotropy.Anisotropy3D.euler(0.3, 0.2, 0.1, eps=0.02))}), 6)


@query("divnormal_iso21")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(g.select({"a": stencils.div_normal(P, Q, g.mesh, "Iso21", 0.01), "b": stencils.div_normal(P, Q, g.mesh, "Iso21Vector", 0.01)}), 6)


# reductions
@query("reduce_all", with_steps(""" SELECT MAX(v) AS hi, MIN(v) AS lo, SUM(v) AS total, AVG(v) AS mean, MAX(abs(ux)) AS size, SUM(v*v) AS squares, sqrt(SUM(v*v)) AS l2,
 CAST(SUM(CASE WHEN isnan(v) OR isinf(v) THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM g"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"hi": "max", "lo": "min", "total": "sum", "mean": "mean", "squares": "sum_sq", "l2": "l2", "bad": "n_bad"}
    return reduce.reduced(ingest.lineitem_grid(spark, sf_dir).df, {k: (kind, "v") for k, kind in kinds.items()} | {"size": ("max_abs", "ux")})


@query("reduce_dot", with_steps(" SELECT SUM(p * v) AS dot FROM g"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.dot(ingest.lineitem_grid(spark, sf_dir).df, "p", "v")


@query("reduce_functional", with_steps(" SELECT SUM(p * (1 - q)) AS a, MAX(p + q) AS b, MIN(p - q) AS c FROM g"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.functional(ingest.lineitem_grid(spark, sf_dir), {"a": ("sum", P * (1 - Q)), "b": ("max", P + Q), "c": ("min", P - Q)})


@query("free_energy", chain([({"e": lambda n: f"4*(t.p*t.p*(1-t.p)*(1-t.p)+1.5*(pow({_D('p', 0)(n)}/2,2)+pow({_D('p', 1)(n)}/2,2)))"}, ())], " SELECT ROUND(SUM(e), 6) + 0.0 AS energy FROM g1"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir, d=(2.0, 2.0))
    return _rounded(reduce.free_energy(g, material.double_well(P), P, 3.0), 6)


@query("field_difference", with_steps(" SELECT MAX(abs(p - q)) AS max_diff, sqrt(SUM((p - q) * (p - q))) AS l2_diff FROM g"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ingest.lineitem_grid(spark, sf_dir).df
    return reduce.difference(df.select("i", "j", "k", F.col("p").alias("f")), df.select("i", "j", "k", F.col("q").alias("f")), "f")


@query("block_average", with_steps(" SELECT CAST(i // 4 AS INT) AS i, CAST(j // 3 AS INT) AS j, 0 AS k, AVG(v) AS v FROM g GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.block_average(ingest.lineitem_grid(spark, sf_dir).df, (4, 3, 1), ["v"])


# lookups and transfers
@query("gather_table", with_steps(", n AS (SELECT s_nationkey % 5 AS id, CAST(COUNT(*) AS DOUBLE) AS value FROM supplier GROUP BY 1) SELECT i, j, k, CASE WHEN g.id >= 0 THEN COALESCE(n.value, -1) ELSE -1 END AS got FROM g LEFT JOIN n USING (id)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ingest.table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("id")).agg(F.count("*").cast("double").alias("value"))
    return index.gather(ingest.lineitem_grid(spark, sf_dir).df, "id", table, "got", -1.0).select("i", "j", "k", "got")


@query("adopt_neighbour", with_steps(""", cand AS (SELECT t.i, t.j, n.id, row_number() OVER (PARTITION BY t.i, t.j ORDER BY n.v DESC, n.j - t.j, n.i - t.i) AS r FROM g t
 JOIN g n ON n.id >= 0 AND abs(n.i - t.i) <= 1 AND abs(n.j - t.j) <= 1 AND NOT (n.i = t.i AND n.j = t.j))
 SELECT g.i, g.j, g.k, CASE WHEN g.id < 0 AND g.p > 0.25 AND c.id IS NOT NULL THEN c.id ELSE g.id END AS id FROM g LEFT JOIN cand c ON c.i = g.i AND c.j = g.j AND c.r = 1"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return index.adopt(g.df, g.mesh, "id", "v", F.col("p") > 0.25).select("i", "j", "k", "id")


@query("meshmap_conserve", with_steps(""" SELECT CAST(x.t AS INT) AS i, CAST(y.t AS INT) AS j, 0 AS k, ROUND(SUM((least((g.i + 1) * 3, (x.t + 1) * 4) - greatest(g.i * 3, x.t * 4)) * (least((g.j + 1) * 2, (y.t + 1) * 3) - greatest(g.j * 2, y.t * 3)) * v) / 12, 6) + 0.0 AS v
 FROM g JOIN range(24) x(t) ON x.t * 4 < (g.i + 1) * 3 AND (x.t + 1) * 4 > g.i * 3 JOIN range(16) y(t) ON y.t * 3 < (g.j + 1) * 2 AND (y.t + 1) * 3 > g.j * 2 GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir, d=(3.0, 2.0))
    return _rounded(meshmap.conserve(g.df, g.mesh, Mesh.uniform(24, 16, d=(4.0, 3.0)), ["v"]), 6)


@query("meshmap_interpolate", with_steps(""", r AS (SELECT CAST(a AS INT) i, CAST(b AS INT) j, least(greatest(floor((a + 0.5) / 2 - 0.5), 0), 30) cx, least(greatest(floor((b + 0.5) / 2 - 0.5), 0), 22) cy, (a + 0.5) / 2 - 0.5 ux, (b + 0.5) / 2 - 0.5 uy FROM range(64) x(a), range(48) y(b)),
 z AS (SELECT *, least(greatest(ux - cx, 0), 1)::DOUBLE wx, least(greatest(uy - cy, 0), 1)::DOUBLE wy FROM r)
 SELECT z.i, z.j, 0 AS k, (1 - wx) * (1 - wy) * a.v + wx * (1 - wy) * b.v + (1 - wx) * wy * c.v + wx * wy * d.v AS v FROM z
 JOIN g a ON a.i = cx AND a.j = cy JOIN g b ON b.i = cx + 1 AND b.j = cy JOIN g c ON c.i = cx AND c.j = cy + 1 JOIN g d ON d.i = cx + 1 AND d.j = cy + 1"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return meshmap.interpolate(g.df, g.mesh, Mesh.uniform(64, 48, d=(0.5, 0.5)), ["v"])


_TABLE = material.EnergyTable(tuple(tuple(float((3 * a - b) ** 2) for b in range(4)) for a in range(5)), (0.0, 1.0), (0.0, 3.0))


@query("table_bilinear", with_steps(""", u AS (SELECT *, p * 4 AS fc, q * 3 AS ft, least(floor(p * 4), 3) AS ic, least(floor(q * 3), 2) AS it FROM g)
 SELECT i, j, k, ROUND((1 - (fc - ic)) * ((1 - (ft - it)) * pow(3 * ic - it, 2) + (ft - it) * pow(3 * ic - it - 1, 2)) + (fc - ic) * ((1 - (ft - it)) * pow(3 * ic + 3 - it, 2) + (ft - it) * pow(3 * ic + 2 - it, 2)), 6) + 0.0 AS f FROM u"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ingest.lineitem_grid(spark, sf_dir).df.select("i", "j", "k", _TABLE.lookup(F.col("p"), F.col("q") * 3).alias("f")), 6)


_BILINEAR = "(1 - ({c} * 4 - least(floor({c} * 4), 3))) * ((1 - ({t} - least(floor({t}), 2))) * pow(3 * least(floor({c} * 4), 3) - least(floor({t}), 2), 2) + ({t} - least(floor({t}), 2)) * pow(3 * least(floor({c} * 4), 3) - least(floor({t}), 2) - 1, 2)) + ({c} * 4 - least(floor({c} * 4), 3)) * ((1 - ({t} - least(floor({t}), 2))) * pow(3 * least(floor({c} * 4), 3) + 3 - least(floor({t}), 2), 2) + ({t} - least(floor({t}), 2)) * pow(3 * least(floor({c} * 4), 3) + 2 - least(floor({t}), 2), 2))"
_at = lambda c, t: "(" + _BILINEAR.replace("{c}", f"({c})").replace("{t}", f"({t})") + ")"


@query("table_slope", with_steps(f""" SELECT i, j, k, ROUND(({_at('least(p + 0.125, 1)', 'q * 3')} - {_at('greatest(p - 0.125, 0)', 'q * 3')}) / (least(p + 0.125, 1) - greatest(p - 0.125, 0)), 6) + 0.0 AS "dfdc",
 ROUND(({_at('p', 'least(q * 3 + 0.5, 3)')} - {_at('p', 'greatest(q * 3 - 0.5, 0)')}) / (least(q * 3 + 0.5, 3) - greatest(q * 3 - 0.5, 0)), 6) + 0.0 AS "dfdT" FROM g"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ingest.lineitem_grid(spark, sf_dir).df.select("i", "j", "k", _TABLE.slope(F.col("p"), F.col("q") * 3).alias("dfdc"), _TABLE.slope(F.col("p"), F.col("q") * 3, "t").alias("dfdT")), 6)


_KKS = material.KKS(2.0, 3.0, 0.25, 0.75)
_H, _MU = "(t.p*t.p*(3-2*t.p))", "((t.q-{h}*0.25::DOUBLE-(1-{h})*0.75::DOUBLE)/({h}/2+(1-{h})/3))".replace("{h}", "(t.p*t.p*(3-2*t.p))")
grid_query("kks_partition", lambda m: dict(zip(("mu", "cs", "cl"), _KKS.partition(Q, material.h_cubic(P)), strict=True)) | {"drive": _KKS.driving_force(Q, material.h_cubic(P)), "dmu": _KKS.dmu_dc(material.h_cubic(P))}, {
    "mu": lambda n: _MU, "cs": lambda n: f"0.25::DOUBLE+{_MU}/2", "cl": lambda n: f"0.75::DOUBLE+{_MU}/3",
    "drive": lambda n: f"1.5*pow({_MU}/3,2)-pow({_MU}/2,2)-{_MU}*(0.5::DOUBLE+{_MU}/3-{_MU}/2)", "dmu": lambda n: f"1/({_H}/2+(1-{_H})/3)",
}, digits=6)
_GP = material.GrandPotential(2.0, 3.0, 0.25, 0.75, 1.5)
grid_query("grand_potential", lambda m: {"bulk": _GP.bulk(P), "couple": _GP.coupling(P, Q), "c": _GP.composition(P, Q)}, {
    "bulk": lambda n: "1.5*2*t.p*(1-t.p)*(1-2*t.p)", "couple": lambda n: "30*t.p*t.p*(1-t.p)*(1-t.p)*((-t.q*t.q/4-t.q*0.25::DOUBLE)-(-t.q*t.q/6-t.q*0.75::DOUBLE))",
    "c": lambda n: (lambda h: f"{h}*(t.q/2+0.25::DOUBLE)+(1-{h})*(t.q/3+0.75::DOUBLE)")("(t.p*t.p*t.p*(t.p*(6*t.p-15)+10))"),
}, digits=6)


@query("gibbs_simplex", with_steps(""", a AS (SELECT i, j, k, p AS x, q - 0.25 AS y, 1.25 - p - q AS z FROM g), d AS (SELECT *, greatest(x,0)+greatest(y,0)+greatest(z,0)-1 AS d, (x>=0)::INT+(y>=0)::INT+(z>=0)::INT AS m, (x<0 OR y<0 OR z<0) AS neg FROM a),
 e AS (SELECT i, j, k, CASE WHEN neg THEN CASE WHEN x>0 THEN x-d/m ELSE 0 END ELSE x END x, CASE WHEN neg THEN CASE WHEN y>0 THEN y-d/m ELSE 0 END ELSE y END y, CASE WHEN neg THEN CASE WHEN z>0 THEN z-d/m ELSE 0 END ELSE z END z FROM d),
 d2 AS (SELECT *, greatest(x,0)+greatest(y,0)+greatest(z,0)-1 AS d, (x>=0)::INT+(y>=0)::INT+(z>=0)::INT AS m, (x<0 OR y<0 OR z<0) AS neg FROM e),
 e2 AS (SELECT i, j, k, CASE WHEN neg THEN CASE WHEN x>0 THEN x-d/m ELSE 0 END ELSE x END x, CASE WHEN neg THEN CASE WHEN y>0 THEN y-d/m ELSE 0 END ELSE y END y, CASE WHEN neg THEN CASE WHEN z>0 THEN z-d/m ELSE 0 END ELSE z END z FROM d2)
 SELECT i, j, k, ROUND(greatest(x,0),6)+0.0 x, ROUND(greatest(y,0),6)+0.0 y, ROUND(greatest(z,0),6)+0.0 z FROM e2"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ingest.lineitem_grid(spark, sf_dir).df.select("i", "j", "k", F.col("p").alias("x"), (F.col("q") - 0.25).alias("y"), (1.25 - F.col("p") - F.col("q")).alias("z"))
    return _rounded(simplex.project(df, ["x", "y", "z"]), 6)


# time
_AC = lambda n: f"t.p+0.125::DOUBLE*({n('p', 1)}+{n('p', -1)}+{n('p', 0, 1)}+{n('p', 0, -1)}-4*t.p+t.p-t.p*t.p*t.p)"
_ALLEN_CAHN = lambda m: {"p": stencils.laplacian(P, m) + P - P * P * P}


@query("allen_cahn_step", sql({"p": _AC}))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return ev.euler_step(g, _ALLEN_CAHN(g.mesh), 0.125).df.select("i", "j", "k", "p")


_HEAT = lambda n: f"t.p+0.125::DOUBLE*({n('p', 1)}+{n('p', -1)}+{n('p', 0, 1)}+{n('p', 0, -1)}-4*t.p)"
_HEAT3 = chain([({"p": _HEAT}, ())] * 3, " SELECT i, j, k, ROUND(p, 9) + 0.0 AS p FROM g3", "noflux")


@query("heat_euler_3", _HEAT3)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _noflux_grid(spark, sf_dir)
    return _rounded(ev.Run({"p": stencils.laplacian(P, g.mesh)}, 0.125, store_every=2).advance(g.with_df(g.df.select("i", "j", "k", "p")), 3).df, 9)


@query("heat_tiles_3", _HEAT3)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _noflux_grid(spark, sf_dir)
    return _rounded(evolve(g.with_df(g.df.select("i", "j", "k", "p")), {"p": stencils.laplacian(P, g.mesh)}, 0.125, 3, (13, 10), 2).df, 9)


_L = lambda f: lambda n: f"({n(f, 1)}+{n(f, -1)}+{n(f, 0, 1)}+{n(f, 0, -1)}-4*t.{f})"


@query("heat_rk4", chain([
    ({"k1": _L("p")}, ("p",)), ({"s": lambda n: "t.p+0.125::DOUBLE*t.k1"}, ("p", "k1")), ({"k2": _L("s")}, ("p", "k1")), ({"s": lambda n: "t.p+0.125::DOUBLE*t.k2"}, ("p", "k1", "k2")), ({"k3": _L("s")}, ("p", "k1", "k2")),
    ({"s": lambda n: "t.p+0.25::DOUBLE*t.k3"}, ("p", "k1", "k2", "k3")), ({"k4": _L("s")}, ("p", "k1", "k2", "k3")),
], " SELECT i, j, k, ROUND(p + 0.25 / 6 * (k1 + 2 * k2 + 2 * k3 + k4), 9) + 0.0 AS p FROM g7"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(ev.rk4_step(g, {"p": stencils.laplacian(P, g.mesh)}, 0.25).df.select("i", "j", "k", "p"), 9)


@query("cahn_hilliard_step", chain([({"mu": lambda n: f"2*(t.p-0.25)*(t.p-0.75)*(2*t.p-1)-0.5*{_L('p')(n)}"}, ("p",)), ({"p": lambda n: f"t.p+0.03125::DOUBLE*{_L('mu')(n)}"}, ())], " SELECT i, j, k, ROUND(p, 9) + 0.0 AS p FROM g2"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    s = System(g.with_df(g.df.select("i", "j", "k", "p")))
    s.define("mu", 2 * (P - 0.25) * (P - 0.75) * (2 * P - 1) - 0.5 * ex.lap(P))
    s.evolve("p", ex.lap(field("mu")))
    s.advance(0.03125)
    return _rounded(s.grid.df.select("i", "j", "k", "p"), 9)


_GS = {"p": lambda n: f"t.p+0.5::DOUBLE*(0.2*{_L('p')(n)}-t.p*t.q*t.q+0.04*(1-t.p))", "q": lambda n: f"t.q+0.5::DOUBLE*(0.1*{_L('q')(n)}+t.p*t.q*t.q-0.1*t.q)"}


@query("gray_scott_2", chain([(_GS, ())] * 2, " SELECT i, j, k, ROUND(p, 9) + 0.0 AS p, ROUND(q, 9) + 0.0 AS q FROM g2"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    g = g.with_df(g.df.select("i", "j", "k", "p", "q"))
    for _ in range(2):
        g = ev.euler_step(g, {"p": 0.2 * stencils.laplacian(P, g.mesh) - P * Q * Q + 0.04 * (1 - P), "q": 0.1 * stencils.laplacian(Q, g.mesh) + P * Q * Q - 0.1 * Q}, 0.5)
    return _rounded(g.df, 9)


@query("sequential_steps", chain([({"p": _HEAT}, ("q",)), ({"q": lambda n: "t.q+0.5::DOUBLE*(t.p-t.q)"}, ("p",)), ({"r": lambda n: "t.p*t.q"}, ("p", "q"))], " SELECT i, j, k, ROUND(p, 9)+0.0 AS p, ROUND(q, 9)+0.0 AS q, ROUND(r, 9)+0.0 AS r FROM g3"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    g = g.with_df(g.df.select("i", "j", "k", "p", "q"))
    return _rounded(ev.sequential_step(g, [("p", 0.25 * stencils.laplacian(P, g.mesh), True), ("q", P - Q, True), ("r", P * Q, False)], 0.5).df, 9)


_S2 = "(t.p*t.p+t.q*t.q)"
_HQ = lambda f: f"({f}*{f}*{f}*({f}*(6*{f}-15)+10))"


@query("ostwald_step", chain([
    ({"c": lambda n: "t.v/1024", "s": lambda n: _S2}, ("p", "q")),
    ({"mu": lambda n: f"4*(t.c-0.3)+4*(0.3-0.7)*({_HQ('t.p')}+{_HQ('t.q')})-3*{_L('c')(n)}",
      "dp": lambda n: f"5*(3*{_L('p')(n)}-(2*(pow(0.7-t.c,2)-pow(t.c-0.3,2))*30*t.p*t.p*(1-t.p)*(1-t.p)+2*t.p*(1-t.p)*(1-2*t.p)+10*t.p*(t.s-t.p*t.p)))",
      "dq": lambda n: f"5*(3*{_L('q')(n)}-(2*(pow(0.7-t.c,2)-pow(t.c-0.3,2))*30*t.q*t.q*(1-t.q)*(1-t.q)+2*t.q*(1-t.q)*(1-2*t.q)+10*t.q*(t.s-t.q*t.q)))"}, ("c", "p", "q")),
    ({"c": lambda n: f"t.c+0.000731234567::DOUBLE*5*{_L('mu')(n)}", "p": lambda n: "t.p+0.000731234567::DOUBLE*t.dp", "q": lambda n: "t.q+0.000731234567::DOUBLE*t.dq"}, ()),
], " SELECT i, j, k, ROUND(c, 9)+0.0 AS c, ROUND(p, 9)+0.0 AS p, ROUND(q, 9)+0.0 AS q FROM g3"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    s = System(g.with_df(g.df.select("i", "j", "k", "p", "q", (F.col("v") / 1024).alias("c"))))
    models.ostwald(s, ["p", "q"])
    s.advance(0.000731234567)
    return _rounded(s.grid.df.select("i", "j", "k", "c", "p", "q"), 9)


@query("multiphase_step")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    g = g.assign({"a": 0.5 * P, "b": 0.5 * Q, "c": 1 - 0.5 * P - 0.5 * Q})
    pairs = {frozenset(x): 1.0 for x in (("a", "b"), ("a", "c"), ("b", "c"))}
    mu, rates = models.multiphase(g.mesh, ["a", "b", "c"], pairs, pairs, pairs)
    s = System(g.with_df(g.df.select("i", "j", "k", "a", "b", "c")))
    s.define_many(mu)
    for name, rate in rates.items():
        s.evolve(name, rate)
    s.advance(0.001)
    return _rounded(simplex.project(s.grid.df.select("i", "j", "k", "a", "b", "c"), ["a", "b", "c"]), 7)


@query("dendrite_step")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir, Boundary())
    rate, heat = models.dendrite(g.mesh, Schemes(), "p", "q")
    g = g.assign({"dp": rate, "dq": heat})
    return _rounded(g.assign({"p": P + 0.001 * field("dp"), "q": Q + 0.001 * (field("dq") + 0.5 * field("dp"))}).df.select("i", "j", "k", "p", "q"), 9)


@query("anti_trapping")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    _, cs, cl = _KKS.partition(Q, material.h_cubic(P))
    g = g.assign({"cs": cs, "cl": cl, "rate": stencils.laplacian(P, g.mesh)})
    return _rounded(g.select({"a": faces.anti_trapping(g.mesh, field("cl"), field("cs"), P, field("rate"), 0.35, 1.0)}), 9)


@query("adaptive_rate", chain([({"r": _L("p")}, ())], " SELECT MAX(abs(r)) AS rate_p FROM g1"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return ev.rates(g, {"p": stencils.laplacian(P, g.mesh)})


@query("adaptive_step", chain([({"r": _L("p")}, ("p",))], " SELECT i, j, k, ROUND(p + greatest(least(0.9 * 0.5 / (SELECT MAX(abs(r)) FROM g1), 0.12, 1.0), 0.001) * r, 9) + 0.0 AS p FROM g1"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    run = ev.Run({"p": stencils.laplacian(P, g.mesh)}, 0.1, adaptive=ev.AdaptiveDt(0.5, 0.001, 1.0))
    return _rounded(run.advance(g.with_df(g.df.select("i", "j", "k", "p")), 1).df, 9)


@query("moving_frame_shift", with_steps(" SELECT i - 1 AS i, j, k, p, v FROM g WHERE i > 0 UNION ALL SELECT i, j, k, p + 0.5, 1.0::DOUBLE AS v FROM g WHERE i = 31"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return MovingFrame(0, {"p": ("slope", 0.5), "v": ("constant", 1.0)}).shift(g.with_df(g.df.select("i", "j", "k", "p", "v"))).df


@query("interface_position", """WITH """ + LINE.strip() + oracle.FIELDS + """, l AS (SELECT i, v AS a, LEAD(v) OVER (ORDER BY i) AS b FROM g), h AS (SELECT * FROM l WHERE b IS NOT NULL AND (a - 41.5) * (b - 41.5) <= 0 AND a <> b)
 SELECT i + 0.5::DOUBLE + (41.5 - a) / (b - a) AS position FROM h ORDER BY i DESC LIMIT 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.event_line(spark, sf_dir)
    return diagnostics.interface_position(g.df, g.mesh, "v", level=41.5)


grid_query("line_derivatives", lambda m: {"lap": stencils.laplacian(V, m), "adv": stencils.advection((UX,), V, m)}, {
    "lap": lambda n: f"{n('v', 1)}-2*t.v+{n('v', -1)}", "adv": lambda n: f"t.ux*CASE WHEN t.ux>0 THEN t.v-{n('v', -1)} ELSE {n('v', 1)}-t.v END",
}, "noflux", base=LINE)

# symbolic front end
grid_query("sym_chain_rule", lambda m: (lambda b: {"a": b(ex.expanded(ex.lap(P * P))), "b": b(ex.expanded(ex.derivative(P * Q, 0))), "c": ex.partial(P * P * Q + 3 * P, "p")})(lambda e: Schemes().bind(e, m)), {
    "a": lambda n: f"2*t.p*{_L('p')(n)}+2*(pow({_D('p', 0)(n)},2)+pow({_D('p', 1)(n)},2))", "b": lambda n: f"{_D('p', 0)(n)}*t.q+t.p*{_D('q', 0)(n)}", "c": lambda n: "2*t.p*t.q+3",
})
grid_query("sym_bound_schemes", lambda m: (lambda s: {"a": s.bind(ex.lap(V), m), "b": s.bind(ex.derivative(P, 0), m), "c": s.bind(ex.advect((UX, UY), V), m)})(Schemes.preset("Ji2022S21", {"gradient": {"grad(p,x)": "CD4"}})), {
    "a": _ISO("v"), "b": _axis("p", *_F4, 0), "c": _UW1("v"),
}, digits=9)
grid_query("sym_div_coeff_grad", lambda m: (lambda s: {"a": s.bind(ex.div_grad(0.5 + P, Q), m), "g": s.bind(ex.grad_sq(P), m)})(Schemes()), {
    "a": lambda n: "+".join(f"0.5::DOUBLE*(1+t.p+{n('p', *o)})*({n('q', *o)}-t.q)" for o in _AX), "g": lambda n: f"pow({_D('p', 0)(n)},2)+pow({_D('p', 1)(n)},2)",
}, digits=9)

# solvers
grid_query("jacobi_sweep", lambda m: {"p": P + (0.8 / 5.0) * (Q - (P - stencils.laplacian(P, m)))}, {"p": lambda n: f"t.p+0.16::DOUBLE*(t.q-(t.p-{_L('p')(n)}))"}, digits=9)


@query("mg_restrict", chain([({"p": lambda n: "(" + "+".join(f"{a * b}*{n('p', x, y)}" for x, a in zip((-1, 0, 1, 2), (1, 3, 3, 1), strict=True) for y, b in zip((-1, 0, 1, 2), (1, 3, 3, 1), strict=True)) + ")/64.0::DOUBLE"}, ())], " SELECT CAST(i // 2 AS INT) AS i, CAST(j // 2 AS INT) AS j, k, p FROM g1 WHERE i % 2 = 0 AND j % 2 = 0"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.restrict(ingest.lineitem_grid(spark, sf_dir), "p").df


@query("mg_prolong", chain([({f"c{a}{b}": (lambda n, a=a, b=b: f"(9*t.p+3*{n('p', 2 * a - 1)}+3*{n('p', 0, 2 * b - 1)}+{n('p', 2 * a - 1, 2 * b - 1)})/16.0::DOUBLE") for a in (0, 1) for b in (0, 1)}, ())],
 " " + " UNION ALL ".join(f"SELECT 2*i+{a} AS i, 2*j+{b} AS j, k, c{a}{b} AS p FROM g1" for a in (0, 1) for b in (0, 1))))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return solvers.prolong(g, "p", Mesh.uniform(64, 48, d=(0.5, 0.5))).df


grid_query("linear_operators", lambda m: {"lap": solvers.laplace(m, 2.0, 0.5)(P), "vari": solvers.variable_laplace(m, Q)(P), "bi": solvers.biharmonic(m, 0.25)(V), "diag": solvers.diagonal(m, 1.0, 0.5)(P)}, {
    "lap": lambda n: f"2*{_L('p')(n)}-0.5*t.p", "vari": lambda n: "+".join(f"{_AVG(n, 'q', o)}*({n('p', *o)}-t.p)" for o in _AX),
    "bi": lambda n: "-0.25::DOUBLE*(" + "+".join(f"({w})*{n('v', *o)}" for o, w in {(0, 0): 20, **{o: -8 for o in _AX}, **{(x, y): 2 for x in (-1, 1) for y in (-1, 1)}, **{(2 * x, 2 * y): 1 for x, y in _AX}}.items()) + ")", "diag": lambda n: "t.p/3.0::DOUBLE",
}, digits=9)


# engines
_LB = lattice.Lattice(0.8, (0.001, 0.0))


def _populations(spark: SparkSession, sf_dir: str) -> Grid:
    g = ingest.lineitem_grid(spark, sf_dir)
    return g.assign(lattice.Lattice.equilibrium(1 + 0.125 * P, 0.03125 * UX, 0.03125 * UY))


_FEQ = {f"f{q}": (lambda n, q=q: f"{('4.0::DOUBLE/9', '1.0::DOUBLE/9', '1.0::DOUBLE/36')[0 if q == 0 else 1 if q < 5 else 2]}*(1+0.125*t.p)*(1+3*({lattice.CX[q]}*0.03125*t.ux+{lattice.CY[q]}*0.03125*t.uy)+4.5*pow({lattice.CX[q]}*0.03125*t.ux+{lattice.CY[q]}*0.03125*t.uy,2)-1.5*(pow(0.03125*t.ux,2)+pow(0.03125*t.uy,2)))") for q in range(9)}
_ALLF = ", ".join(f"ROUND(f{q}, 9) + 0.0 AS f{q}" for q in range(9))


@query("lattice_stream", chain([(_FEQ, ()), ({f"f{q}": (lambda n, q=q: n(f"f{q}", -lattice.CX[q], -lattice.CY[q])) for q in range(9)}, ())], f" SELECT i, j, k, {_ALLF} FROM g2"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_LB.stream(_populations(spark, sf_dir)).df.select("i", "j", "k", *lattice.NAMES), 9)


@query("lattice_macroscopic", chain([(_FEQ, ()), ({"rho": lambda n: "(" + "+".join(f"t.f{q}" for q in range(9)) + ")", "mx": lambda n: "+".join(f"({lattice.CX[q]})*t.f{q}" for q in range(9)) + "+0.0005", "my": lambda n: "+".join(f"({lattice.CY[q]})*t.f{q}" for q in range(9))}, ())],
 " SELECT i, j, k, ROUND(rho, 9) + 0.0 AS rho, ROUND(mx / rho, 9) + 0.0 AS ux, ROUND(my / rho, 9) + 0.0 AS uy FROM g2"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_LB.macroscopic(_populations(spark, sf_dir)), 9)


def _collide_sql(q: int) -> Callable:
    w, cx, cy = ("4.0::DOUBLE/9", "1.0::DOUBLE/9", "1.0::DOUBLE/36")[0 if q == 0 else 1 if q < 5 else 2], lattice.CX[q], lattice.CY[q]
    cu = f"({cx}*t.ux+{cy}*t.uy)"
    relaxed = f"t.f{q}-(t.f{q}-{w}*t.rho*(1+3*{cu}+4.5*{cu}*{cu}-1.5*(t.ux*t.ux+t.uy*t.uy)))/0.8::DOUBLE"
    return lambda n: f"{relaxed}+0.375::DOUBLE*{w}*(3*({cx}-t.ux)*0.001::DOUBLE+9*{cu}*{cx}*0.001::DOUBLE)"


_MOMENTS = {
    "rho": lambda n: "(" + "+".join(f"t.f{q}" for q in range(9)) + ")",
    "ux": lambda n: "(" + "+".join(f"({lattice.CX[q]})*t.f{q}" for q in range(9)) + "+0.0005::DOUBLE)/(" + "+".join(f"t.f{q}" for q in range(9)) + ")",
    "uy": lambda n: "(" + "+".join(f"({lattice.CY[q]})*t.f{q}" for q in range(9)) + ")/(" + "+".join(f"t.f{q}" for q in range(9)) + ")",
}


@query("lattice_collide", chain([(_FEQ, ()), (_MOMENTS, tuple(f"f{q}" for q in range(9))), ({f"f{q}": _collide_sql(q) for q in range(9)}, ())], f" SELECT i, j, k, {_ALLF} FROM g3"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_LB.collide(_populations(spark, sf_dir)).df.select("i", "j", "k", *lattice.NAMES), 9)


@query("lattice_channel")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _populations(spark, sf_dir)
    walls = lattice.Lattice(0.8, walls=(False, True))
    profile = spark.range(24).select(F.col("id").cast("int").alias("j"), F.lit(0.01).alias("un"), F.lit(0.0).alias("ut"))
    g = walls.stream(walls.collide(g))
    g = lattice.open_side(lattice.open_side(g, 0, -1, velocity=profile), 0, 1, density=1.0)
    return _rounded(walls.macroscopic(g), 9)


@query("elastic_strain")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.lineitem_grid(spark, sf_dir)
    return _rounded(elastic.Elasticity(250.0, 150.0, 100.0).strains(g.df, g.mesh, "p"), 6)


@query("noise_fields")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ingest.lineitem_grid(spark, sf_dir).df
    return _rounded(df.select("i", "j", "k", *[noise.sample(kind, 7, 0.5, 1.0).alias(kind.lower()) for kind in noise.KINDS]), 6)


@query("ranked_cells", with_steps(" SELECT i, j, k, v, CAST(row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS INT) AS r FROM g QUALIFY r <= 3"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest three cells of each grid line."""
    df = ingest.lineitem_grid(spark, sf_dir).df
    return df.select("i", "j", "k", "v", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("v"), "i")).alias("r")).filter("r <= 3")
