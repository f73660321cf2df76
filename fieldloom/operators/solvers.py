"""Linear solvers on fields: conjugate gradients, preconditioners and a multigrid cycle.

They solve (alpha I - sigma L) x = b for an operator L given as an
expression. Vectors are columns of one table that is written to the shared
folder every iteration, scalars are observed while it is written; nothing
but scalars reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..errors import NumericsError, ValidationError
from ..mesh import KEYS, Mesh
from ..plans.expr import Expr, const, field, shift
from ..plans.lower import Grid
from ..sources.scratch import remove, stored
from .faces import assembled
from .stencils import laplacian, step

Operator = Callable[[Expr], Expr]


def laplace(mesh: Mesh, diffusivity: float = 1.0, shift_by: float = 0.0) -> Operator:
    """D lap(x) - shift x."""
    if shift_by < 0:
        raise ValidationError("LaplacianOp", "the shift must not be negative")
    return lambda x: diffusivity * laplacian(x, mesh) - shift_by * x


def variable_laplace(mesh: Mesh, coefficient: Expr) -> Operator:
    """div(a grad x) with a averaged on faces."""
    return lambda x: assembled(mesh, lambda f: f.interp(coefficient) * f.gradient(x))


def biharmonic(mesh: Mesh, strength: float = 1.0) -> Operator:
    return lambda x: -strength * laplacian(laplacian(x, mesh), mesh)


@dataclass(frozen=True)
class System:
    """(alpha I - sigma L) x = b."""

    operator: Operator
    alpha: float
    sigma: float

    def apply(self, x: Expr) -> Expr:
        return self.alpha * x - self.sigma * self.operator(x)


def diagonal(mesh: Mesh, alpha: float, sigma: float, diffusivity: float = 1.0, shift_by: float = 0.0) -> Callable[[Expr], Expr]:
    """z = r / diagonal."""
    own = alpha + sigma * (shift_by + 2 * diffusivity * sum(1 / mesh.d[a] ** 2 for a in range(mesh.dim)))
    return lambda r: r / own


def chebyshev(system: System, mesh: Mesh, degree: int, diffusivity: float = 1.0, shift_by: float = 0.0) -> Callable[[Expr], Expr]:
    """Polynomial of the operator on its eigenvalue range, by the three-term recurrence."""
    low = system.alpha if system.alpha > 0 else 1e-3
    high = system.alpha + system.sigma * (4 * diffusivity * sum(1 / mesh.d[a] ** 2 for a in range(mesh.dim)) + shift_by)
    centre, half = 0.5 * (high + low), 0.5 * (high - low)

    def run(r: Expr) -> Expr:
        rate = half / centre
        rho, z = rate, r / centre
        d = z
        for _ in range(degree - 1):
            new = 1 / (2 / rate - rho)
            d = (new * rho) * d + (2 * new / half) * (r - system.apply(z))
            z, rho = z + d, new
        return z

    return run


@dataclass(frozen=True)
class Result:
    grid: Grid
    iterations: int
    residual: float
    converged: bool


def conjugate_gradient(
    grid: Grid, x: str, b: str, system: System, tolerance: float = 1e-8, most: int = 500, check_every: int = 4,
    precondition: Callable[[Expr], Expr] | None = None, strict: bool = True,
) -> Result:
    """Solve for the field x, starting from its values.

    Converges on the true residual |b - A x| / |b|, looked at every
    check_every iterations; b = 0 gives x = 0. The recurrence needs both of
    its scalars at one place, so an iteration is one job: it writes x, r, p
    and s = A p with u = M r and w = A u, and observes r.u and w.u while it
    writes. Fields that the solve doesn't touch are joined at its end.
    """
    rule, spark = grid.boundary(x), grid.df.sparkSession
    inner = {"__u": rule.homogeneous(), "__r": rule.homogeneous(), x: rule}
    size = grid.df.agg(F.sum(F.col(b) * F.col(b))).first()[0] or 0.0
    if size == 0:
        return Result(grid.assign({x: const(0)}), 0, 0.0, True)
    z_of = precondition or (lambda r: r)
    own = replace(grid, df=grid.df.select(*KEYS, *dict.fromkeys((x, b))), boundaries={**grid.boundaries, **inner})
    own = own.assign({"__r": field(b) - system.apply(field(x)), "__p": const(0), "__s": const(0)})

    def looked(state: Grid) -> tuple[Grid, str, float, float]:
        """The state with u and w, stored, and the products r.u and w.u."""
        state = state.assign({"__u": z_of(field("__r"))}) if precondition else state.with_df(state.df.withColumn("__u", F.col("__r")))
        state = state.assign({"__w": system.apply(field("__u"))})
        seen = Observation()
        df, path = stored(state.df.observe(seen, F.sum(F.col("__r") * F.col("__u")).alias("ru"), F.sum(F.col("__w") * F.col("__u")).alias("wu")))
        got = seen.get
        return state.with_df(df), path, got["ru"], got["wu"]

    state, path, ru, wu = looked(own)
    old_ru, a, residual, done = None, 0.0, 1.0, 0
    for iteration in range(1, most + 1):
        if ru == 0:
            break
        c = 0.0 if old_ru is None else ru / old_ru
        pq = wu - (c * ru / a if a else 0.0)
        if pq is None or pq != pq or pq <= 0:
            raise NumericsError("CG", f"the operator is not positive definite or not finite (p.q = {pq})")
        a = ru / pq
        ahead = state.df.withColumns({"__p": F.col("__u") + F.lit(c) * F.col("__p"), "__s": F.col("__w") + F.lit(c) * F.col("__s")})
        ahead = ahead.withColumns({x: F.col(x) + F.lit(a) * F.col("__p"), "__r": F.col("__r") - F.lit(a) * F.col("__s")}).drop("__u", "__w")
        old_ru, before = ru, path
        state, path, ru, wu = looked(state.with_df(ahead))
        remove(spark, before)
        done = iteration
        if iteration % check_every == 0 or iteration == most or ru == 0:
            true = state.select({"e": field(b) - system.apply(field(x))}).agg(F.sum(F.col("e") * F.col("e"))).first()[0]
            residual = (true / size) ** 0.5
            if residual != residual:
                raise NumericsError("CG", "the residual is not finite")
            if residual <= tolerance:
                break
    if residual > tolerance and ru == 0:
        true = state.select({"e": field(b) - system.apply(field(x))}).agg(F.sum(F.col("e") * F.col("e"))).first()[0]
        residual = (true / size) ** 0.5
    solved = state.df.select(*KEYS, x)
    others = [c for c in grid.fields if c != x]
    df = grid.df.drop(x).join(solved, list(KEYS)).select(*KEYS, *grid.fields) if others else solved
    out = Result(grid.with_df(df), done, residual, residual <= tolerance)
    if strict and not out.converged:
        raise NumericsError("CG", f"no convergence after {done} iterations: relative residual {residual:.3g}")
    return out


def poisson(grid: Grid, x: str, rhs: str, diffusivity: float = 1.0, project: bool = False, **how: object) -> Result:
    """-div(D grad x) = rhs; project: remove the mean of rhs and of the solution (periodic or all-Neumann problems)."""
    own = grid
    if project:
        mean = grid.df.agg(F.avg(rhs)).first()[0]
        own = grid.with_df(grid.df.withColumn(rhs, F.col(rhs) - F.lit(mean)))
    got = conjugate_gradient(own, x, rhs, System(laplace(grid.mesh, diffusivity), 0.0, 1.0), **how)
    if not project:
        return got
    mean = got.grid.df.agg(F.avg(x)).first()[0]
    return replace(got, grid=got.grid.with_df(got.grid.df.withColumn(x, F.col(x) - F.lit(mean))))


def jacobi(grid: Grid, x: str, b: str, system: System, sweeps: int, omega: float = 0.8, diagonal_value: float | Expr | None = None) -> Grid:
    """Damped Jacobi sweeps."""
    own = diagonal_value if diagonal_value is not None else system.alpha + system.sigma * 2 * sum(1 / grid.mesh.d[a] ** 2 for a in range(grid.mesh.dim))
    for _ in range(sweeps):
        grid = grid.assign({x: field(x) + (omega / own) * (field(b) - system.apply(field(x)))})
    return grid


def restrict(grid: Grid, name: str) -> Grid:
    """Coarse values by the weights [1 3 3 1] x [1 3 3 1] / 64 around each 2 x 2 block."""
    e, total, weights = field(name), const(0), (1.0, 3.0, 3.0, 1.0)
    for a, wx in enumerate(weights):
        for b, wy in enumerate(weights):
            total = total + (wx * wy) * shift(e, (a - 1, b - 1, 0))
    fine = grid.assign({name: total / 64})
    df = fine.df.filter((F.col("i") % 2 == 0) & (F.col("j") % 2 == 0))
    coarse = Mesh.uniform(grid.mesh.n[0] // 2, grid.mesh.n[1] // 2, d=(2 * grid.mesh.d[0], 2 * grid.mesh.d[1]), origin=grid.mesh.origin[:2])
    return Grid(df.select((F.col("i") / 2).cast("int").alias("i"), (F.col("j") / 2).cast("int").alias("j"), "k", name), coarse, grid.boundaries, grid.default, grid.line)


def prolong(coarse: Grid, name: str, fine: Mesh) -> Grid:
    """Fine values by the weights {9, 3, 3, 1} / 16 of the four nearest coarse cells."""
    e, out = field(name), {}
    for sx in (-1, 1):
        for sy in (-1, 1):
            out[f"__{sx > 0:d}{sy > 0:d}"] = (9 * e + 3 * shift(e, step(0, sx)) + 3 * shift(e, step(1, sy)) + shift(e, (sx, sy, 0))) / 16
    df = coarse.select(out)
    four = F.array(*[F.struct((2 * F.col("i") + a).cast("int").alias("i"), (2 * F.col("j") + b).cast("int").alias("j"), F.col(f"__{a}{b}").alias("v")) for a in (0, 1) for b in (0, 1)])
    return Grid(df.select(F.explode(four).alias("c"), "k").select("c.i", "c.j", "k", F.col("c.v").alias(name)), fine, coarse.boundaries, coarse.default, coarse.line)


def face_means(grid: Grid, along: tuple[str, str]) -> tuple[dict[str, Expr], tuple[str, str]]:
    """Coarse coefficients of high faces, in the cells with even indices: means of the two fine faces that lie on each."""
    x, y = (field(n) for n in along)
    return {along[0]: 0.5 * (shift(x, (1, 0, 0)) + shift(x, (1, 1, 0))), along[1]: 0.5 * (shift(y, (0, 1, 0)) + shift(y, (1, 1, 0)))}, along


def high_faces(coefficient: Expr) -> tuple[Expr, Expr]:
    """Arithmetic means on the high face of each cell along x and y."""
    return tuple(0.5 * (coefficient + shift(coefficient, step(a, 1))) for a in (0, 1))


def face_operator(mesh: Mesh, along: tuple[str, str]) -> Operator:
    """div(a grad x) with a given on high faces, as fields."""

    def run(x: Expr) -> Expr:
        out = const(0)
        for axis, name in enumerate(along):
            flux = field(name) * (shift(x, step(axis, 1)) - x)
            out = out + (flux - shift(flux, step(axis, -1))) / mesh.d[axis] ** 2
        return out

    return run


def v_cycle(grid: Grid, x: str, b: str, alpha: float, sigma: float, diffusivity: float = 1.0, sweeps: int = 2, coarse_sweeps: int = 50, along: tuple[str, str] | None = None) -> Grid:
    """One multigrid cycle for (alpha - sigma D lap) x = b in 2D; stops at odd or at most four cells along an axis.

    along: fields with the coefficients of high faces along x and y, for
    (alpha - sigma div a grad) x = b; coarser levels get means over faces.
    """
    mesh = grid.mesh
    if mesh.dim != 2:
        raise ValidationError("multigrid", "needs a 2D mesh")
    system = System(face_operator(mesh, along) if along else laplace(mesh, diffusivity), alpha, sigma)
    own: float | Expr = alpha + sigma * diffusivity * 2 * (1 / mesh.d[0] ** 2 + 1 / mesh.d[1] ** 2)
    if along:
        own = const(alpha)
        for axis, name in enumerate(along):
            own = own + (sigma / mesh.d[axis] ** 2) * (field(name) + shift(field(name), step(axis, -1)))

    def fresh(g: Grid) -> Grid:
        return g.with_df(stored(g.df)[0])

    if min(mesh.n[:2]) <= 4 or mesh.n[0] % 2 or mesh.n[1] % 2:
        for _ in range(max(1, coarse_sweeps // 5)):
            grid = fresh(jacobi(grid, x, b, system, min(5, coarse_sweeps), diagonal_value=own))
        return grid
    grid = fresh(jacobi(grid, x, b, system, sweeps, diagonal_value=own))
    residual = grid.assign({"__b": field(b) - system.apply(field(x))})
    rules = {**grid.boundaries, "__b": grid.boundary(x), "__x": grid.boundary(x)}
    rules = {k: (v.homogeneous() if k in ("__b", "__x") else v) for k, v in rules.items()}
    residual = replace(residual, boundaries=rules)
    down = restrict(residual, "__b")
    if along:
        coarse = residual.assign(face_means(residual, along)[0]).df.filter((F.col("i") % 2 == 0) & (F.col("j") % 2 == 0))
        coarse = coarse.select((F.col("i") / 2).cast("int").alias("i"), (F.col("j") / 2).cast("int").alias("j"), "k", *along)
        down = down.with_df(down.df.join(coarse, ["i", "j", "k"]))
    down = v_cycle(fresh(down.assign({"__x": const(0)})), "__x", "__b", alpha, sigma, diffusivity, sweeps, coarse_sweeps, along)
    up = prolong(down, "__x", mesh)
    joined = grid.with_df(grid.df.join(up.df.select("i", "j", "k", F.col("__x").alias("__up")), ["i", "j", "k"]))
    joined = joined.with_df(joined.df.withColumn(x, F.col(x) + F.col("__up")).drop("__up"))
    return fresh(jacobi(joined, x, b, system, sweeps, diagonal_value=own))


def multigrid(grid: Grid, x: str, b: str, alpha: float, sigma: float, diffusivity: float = 1.0, tolerance: float = 1e-8, most: int = 30, along: tuple[str, str] | None = None, strict: bool = True) -> Result:
    """Cycles until the residual is small enough."""
    system = System(face_operator(grid.mesh, along) if along else laplace(grid.mesh, diffusivity), alpha, sigma)
    size = grid.df.agg(F.sum(F.col(b) * F.col(b))).first()[0] or 0.0
    if size == 0:
        return Result(grid.assign({x: const(0)}), 0, 0.0, True)
    residual, done = 1.0, 0
    while residual > tolerance and done < most:
        grid, done = v_cycle(grid, x, b, alpha, sigma, diffusivity, along=along), done + 1
        true = grid.select({"e": field(b) - system.apply(field(x))}).agg(F.sum(F.col("e") * F.col("e"))).first()[0]
        residual = (true / size) ** 0.5
        if residual != residual:
            raise NumericsError("multigrid", "the residual is not finite")
    if strict and residual > tolerance:
        raise NumericsError("multigrid", f"no convergence after {done} cycles: relative residual {residual:.3g}")
    return Result(grid, done, residual, residual <= tolerance)
