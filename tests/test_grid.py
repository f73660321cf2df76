"""Operators against NumPy, exact polynomials and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.errors import ConfigError, NumericsError, ValidationError
from fieldloom.functions import material
from fieldloom.mesh import Mesh, Patch
from fieldloom.operators import anisotropy, elastic, faces, lattice, mask, meshmap, reduce, simplex, solvers, stencils
from fieldloom.operators.boundary import NOFLUX, PERIODIC, REFLECT, Boundary, fixed, from_config
from fieldloom.plans import expr as ex
from fieldloom.plans.arrays import evolve
from fieldloom.plans.expr import coord, field
from fieldloom.plans.lower import Grid
from fieldloom.plans.schemes import Schemes, template
from fieldloom.plans.system import System
from fieldloom.sources import config, files
from fieldloom.sources.initial import make, spinodal
from fieldloom.streaming import evolve as ev
from fieldloom.streaming.frame import Log, MovingFrame

P = field("p")


def array(df, name, mesh):
    out = np.full(mesh.n[::-1], np.nan)
    for r in df.select("i", "j", "k", name).collect():
        out[r["k"], r["j"], r["i"]] = r[name]
    assert not np.isnan(out).any()
    return out


def ghosts(values, rule, width):
    mode = {"periodic": "wrap", "noflux": "edge", "reflect": "symmetric"}[rule]
    return np.pad(values, [(0, 0), (width, width), (width, width)], mode=mode)


@pytest.fixture(scope="module")
def noisy(spark):
    mesh = Mesh.uniform(12, 9, d=(1.0, 1.0))
    return make(spark, mesh, {"p": "random:0:1"}, Boundary.all(PERIODIC))


@pytest.mark.parametrize("rule", ["periodic", "noflux", "reflect"])
@pytest.mark.parametrize("line", [1 << 20, 5])
def test_neighbours_are_numpy_padding(noisy, rule, line):
    side = {"periodic": PERIODIC, "noflux": NOFLUX, "reflect": REFLECT}[rule]
    grid = Grid(noisy.df, noisy.mesh, {}, Boundary.all(side), line)
    offsets = [(1, 0, 0), (-2, 0, 0), (0, 2, 0), (1, -1, 0), (-2, 2, 0)]
    got = grid.select({f"o{n}": ex.at("p", o) for n, o in enumerate(offsets)})
    full = ghosts(array(noisy.df, "p", noisy.mesh), rule, 2)
    for n, (x, y, _) in enumerate(offsets):
        assert np.array_equal(array(got, f"o{n}", noisy.mesh), full[:, 2 + y : 11 + y, 2 + x : 14 + x])


def test_fixed_sides_and_corner_order(noisy):
    grid = Grid(noisy.df, noisy.mesh, {}, Boundary((fixed(5.0), fixed(6.0)), (fixed(7.0), fixed(8.0))))
    got = array(grid.select({"c": ex.at("p", (1, 1, 0))}), "c", noisy.mesh)[0]
    assert got[8, 11] == 6.0  # x outermost
    assert (got[8, :11] == 8.0).all() and (got[:, 11] == 6.0).all()


@pytest.mark.parametrize(("scheme", "order"), [("CD2", 2), ("CD4", 4), ("CD6", 6), ("Iso9", 2)])
def test_laplacian_order(spark, scheme, order):
    errors = []
    for n in (16, 32):
        mesh = Mesh.uniform(n, n, d=2 * np.pi / n)
        f = ex.call("sin", coord(0)) * ex.call("cos", coord(1))
        grid = make(spark, mesh, {"p": f}, Boundary.all(PERIODIC))
        got = grid.select({"e": ex.call("abs", stencils.laplacian(P, mesh, scheme) + 2 * f)})
        errors.append(got.agg(F.max("e")).first()[0])
    assert abs(np.log2(errors[0] / errors[1]) - order) < 0.3


def test_polynomials_are_exact(spark):
    mesh = Mesh.uniform(8, 8)
    grid = make(spark, mesh, {"p": 2 * coord(0) + 3 * coord(1), "q": coord(0) * coord(0) - coord(1) * coord(1)})
    got = grid.select({"a": stencils.grad_squared(P, mesh), "b": stencils.grad_squared(field("q"), mesh) - 4 * (coord(0) ** 2 + coord(1) ** 2), "c": stencils.laplacian(field("q"), mesh)})
    inner = got.filter("i between 1 and 6 and j between 1 and 6")
    assert inner.agg(F.max(F.abs(F.col("a") - 13)), F.max(F.abs("b")), F.max(F.abs("c"))).first()[0:3] == pytest.approx((0, 0, 0), abs=1e-11)


@pytest.mark.parametrize(("scheme", "order"), [("UW1", 1), ("UW2", 2), ("WENO5", 5)])
def test_advection_order(spark, scheme, order):
    errors = []
    for n in (64, 128):
        mesh = Mesh.uniform(n, d=2 * np.pi / n)
        grid = make(spark, mesh, {"p": ex.call("sin", coord(0))}, Boundary.all(PERIODIC))
        e = stencils.advection((ex.const(1.0),), P, mesh, scheme) - ex.call("cos", coord(0))
        errors.append(grid.select({"e": e * e}).agg(F.sqrt(F.avg("e"))).first()[0])
    assert abs(np.log2(errors[0] / errors[1]) - order) < 0.5


def test_isotropic_limit_and_dimension(spark, noisy):
    mesh = noisy.mesh
    got = noisy.select({"a": anisotropy.aniso_div(P, mesh, anisotropy.Anisotropy()), "b": stencils.laplacian(P, mesh), "c": anisotropy.aniso_div(P, mesh, anisotropy.Anisotropy(scheme="Iso9")), "d": stencils.laplacian(P, mesh, "Iso9")})
    assert got.agg(F.max(F.abs(F.col("a") - F.col("b"))), F.max(F.abs(F.col("c") - F.col("d")))).first()[0:2] == pytest.approx((0, 0), abs=1e-12)
    flat = Mesh.uniform(6, 5, 4)
    grid = make(spark, flat, {"p": ex.call("sin", coord(0)) * coord(1)}, Boundary.all(PERIODIC))
    three = anisotropy.aniso_div_3d(P, flat, anisotropy.Anisotropy3D(eps=0.05))
    two_mesh = Mesh.uniform(6, 5)
    plane = make(spark, two_mesh, {"p": ex.call("sin", coord(0)) * coord(1)}, Boundary.all(PERIODIC))
    # in the plane the cubic form is 1 - 3e + e (3 + cos 4t) = 1 + e cos 4t
    two = anisotropy.aniso_div(P, two_mesh, anisotropy.Anisotropy(eps=0.05))
    joined = grid.select({"a": three}).join(plane.select({"b": two}).drop("k"), ["i", "j"])
    assert joined.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


def test_regularised_cone():
    c, size = anisotropy.Anisotropy(eps=0.08, regularize=True).cone()
    assert c < 1 and size > 0
    assert anisotropy.Anisotropy(eps=0.05, regularize=True).cone()[0] > 1


def test_chained_faces_equal_assembled(noisy):
    q = noisy.assign({"q": P * P})
    e = faces.assembled(q.mesh, lambda f: f.interp(P) * f.gradient(field("q")))
    tables = {a: faces.face_table(q, a, {"f": lambda n, a=a: 0.5 * (ex.shift(P, stencils.step(a, n(-1))) + ex.shift(P, stencils.step(a, n(0)))) * (ex.shift(field("q"), stencils.step(a, n(0))) - ex.shift(field("q"), stencils.step(a, n(-1))))}) for a in (0, 1)}
    both = q.select({"a": e}).join(faces.divergence(q.mesh, tables, "f"), ["i", "j", "k"])
    assert both.agg(F.max(F.abs(F.col("a") - F.col("div"))), F.abs(F.sum("a"))).first()[0:2] == pytest.approx((0, 0), abs=1e-12)


def test_interpolation_at_rims(spark):
    grid = make(spark, Mesh.uniform(3), {"p": coord(0)})
    got = [r["p"] for r in faces.interpolate(grid, "p", 0, "Nearest").orderBy("i").collect()]
    assert got == [0.5, 1.0, 2.0, 2.5]


def test_time_orders_and_tiles(spark, noisy):
    decay = make(spark, Mesh.uniform(2), {"p": "uniform:1"})
    for scheme, order in (("euler", 1), ("rk4", 4)):
        errors = []
        for n in (4, 8):
            got = ev.Run({"p": -P}, 1 / n, scheme).advance(decay, n).df.first()["p"]
            errors.append(abs(got - np.exp(-1)))
        assert abs(np.log2(errors[0] / errors[1]) - order) < 0.3
    rhs = {"p": stencils.laplacian(P, noisy.mesh) * P}
    for rule in (PERIODIC, NOFLUX, fixed(0.5)):
        grid = Grid(noisy.df, noisy.mesh, {}, Boundary((rule, rule), (REFLECT, REFLECT)))
        steps = grid
        for _ in range(4):
            steps = ev.euler_step(steps, rhs, 0.01)
        tiles = evolve(grid, rhs, 0.01, 4, (5, 4), 3)
        assert reduce.difference(steps.df, tiles.df, "p").first()["max_diff"] < 1e-14


def test_adaptive_steps(spark):
    grid = make(spark, Mesh.uniform(2), {"p": "uniform:1"})
    run = ev.Run({"p": -2.0 * P}, 0.01, adaptive=ev.AdaptiveDt(0.1, 1e-4, 0.05))
    got = run.advance(grid, 3).df.first()["p"]
    assert got == pytest.approx(np.prod([1 - 2 * dt for dt in run.history]), abs=1e-14)
    with pytest.raises(ValidationError):
        ev.Run({"p": P}, 0.1, "rk4", adaptive=ev.AdaptiveDt(1, 0, 1))


def test_transfer(spark, noisy):
    coarse = Mesh.uniform(6, 3, d=(2.0, 3.0))
    down = meshmap.conserve(noisy.df, noisy.mesh, coarse, ["p"])
    assert reduce.difference(down, reduce.block_average(noisy.df, (2, 3, 1), ["p"]).withColumn("k", F.lit(0)), "p").first()["max_diff"] < 1e-13
    odd = Mesh.uniform(7, 4, d=(12 / 7, 9 / 4))
    moved = meshmap.conserve(noisy.df, noisy.mesh, odd, ["p"])
    assert moved.agg(F.sum("p")).first()[0] * odd.volume == pytest.approx(noisy.df.agg(F.sum("p")).first()[0])
    linear = make(spark, coarse, {"p": 2 * coord(0) - coord(1)})
    fine = meshmap.interpolate(linear.df, coarse, noisy.mesh, ["p"])
    inner = fine.filter("i between 2 and 9 and j between 2 and 6").select(F.abs(F.col("p") - (2 * (F.col("i") + 0.5) - F.col("j") - 0.5)).alias("e"))
    assert inner.agg(F.max("e")).first()[0] < 1e-12
    with pytest.raises(ValidationError):
        meshmap.conserve(noisy.df, noisy.mesh, Mesh.uniform(6, 3), ["p"])


def test_solvers(spark, noisy):
    mesh = Mesh.uniform(16, 8)
    grid = make(spark, mesh, {"x": "uniform:0", "b": "random:-1:1"}, Boundary.all(PERIODIC))
    s = solvers.System(solvers.laplace(mesh), 1.0, 1.0)
    plain = solvers.conjugate_gradient(grid, "x", "b", s, 1e-8, 60)
    better = solvers.conjugate_gradient(grid, "x", "b", s, 1e-8, 60, precondition=solvers.chebyshev(s, mesh, 2))
    assert plain.converged and better.converged and better.iterations <= plain.iterations
    assert reduce.difference(plain.grid.df, better.grid.df, "x").first()["max_diff"] < 1e-6
    once = solvers.v_cycle(grid, "x", "b", 1.0, 1.0, sweeps=2, coarse_sweeps=10)
    left = once.select({"r": field("b") - s.apply(field("x"))}).agg(F.sqrt(F.sum(F.col("r") ** 2))).first()[0]
    assert left < 0.3 * grid.df.agg(F.sqrt(F.sum(F.col("b") ** 2))).first()[0]
    zero = grid.assign({"b": ex.const(0)})
    assert solvers.conjugate_gradient(zero, "x", "b", s).iterations == 0
    with pytest.raises(NumericsError):
        solvers.conjugate_gradient(grid, "x", "b", s, 1e-12, 1)


def test_single_mode_elasticity(spark):
    n, e = 16, elastic.Elasticity(250.0, 150.0, 100.0)
    mesh = Mesh.uniform(n, 8)
    grid = make(spark, mesh, {"s": 0.01 * ex.call("cos", (2 * np.pi / n) * coord(0))}, Boundary.all(PERIODIC))
    got = e.strains(grid.df, mesh, "s").join(grid.df, ["i", "j", "k"])
    assert got.agg(F.max(F.abs(F.col("e11") - F.lit(400 / 250) * F.col("s"))), F.max(F.abs("e22")), F.max(F.abs("e12"))).first()[0:3] == pytest.approx((0, 0, 0), abs=1e-12)


def test_lattice_conserves(spark):
    mesh = Mesh.uniform(8, 6)
    grid = make(spark, mesh, lattice.Lattice.equilibrium(1 + 0.01 * coord(0), ex.const(0.02), ex.const(0.0)), Boundary.all(PERIODIC))
    flow = lattice.Lattice(0.8, walls=(False, True))
    total = lambda g: flow.macroscopic(g).agg(F.sum("rho")).first()[0]
    assert total(flow.stream(flow.collide(grid))) == pytest.approx(total(grid), abs=1e-12)


def test_simplex_and_mask(spark):
    df = spark.createDataFrame([(1.2, -0.1, -0.1), (0.7, 0.6, -0.2), (-1.0, -1.0, -1.0), (0.2, 0.3, 0.5)], "a double, b double, c double")
    got = [tuple(r) for r in simplex.project(df, ["a", "b", "c"]).collect()]
    assert got[0] == pytest.approx((1, 0, 0)) and got[1] == pytest.approx((0.55, 0.45, 0)) and got[2] == pytest.approx((1, 0, 0)) and got[3] == pytest.approx((0.2, 0.3, 0.5))
    with pytest.raises(ValidationError):
        mask.build(make(spark, Mesh.uniform(4), {}), coord(0) > 100)


def test_system_order_versions_and_checks(noisy):
    s = System(noisy)
    s.define("b", field("a") * 2)
    s.define("a", P + 1)
    s.evolve("p", ex.lap(field("b")))
    assert s.order() == ["a", "b"]
    assert s.refresh() == ["a", "b"] and s.refresh() == []
    s.advance(0.1)
    assert s.refresh() == ["a", "b"]
    assert '"halo": 1' in s.report()
    with pytest.raises(ValidationError):
        s.define("a", P)
    cyclic = System(noisy)
    cyclic.define("x", field("y"))
    cyclic.define("y", field("x"))
    with pytest.raises(ValidationError):
        cyclic.order()
    wide = System(Grid(noisy.df, noisy.mesh, {}, Boundary()), Schemes({"laplacian": {"default": "CD4"}}))
    with pytest.raises(ValidationError):
        wide.evolve("p", ex.lap(P))


def test_schemes():
    s = Schemes({"gradient": {"default": "none", "grad(p)": "CD4"}, "advection": {"adv(p)": "WENO5"}})
    assert s.resolve("gradient", "p,x") == "CD4" and s.resolve("advection", "u,p") == "WENO5" and s.resolve("laplacian", "p") == "CD2"
    with pytest.raises(ConfigError):
        s.resolve("gradient", "q,x")
    with pytest.raises(ConfigError):
        Schemes({"laplacian": {"default": "CD8"}})
    assert ex.operators(ex.lap(P) + ex.derivative(P, 0)) == ["d(p,x)", "lap(p)"]
    assert "lap(p)" in template(["lap(p)"])


def test_expressions():
    assert ex.sub(P, P) is ex.const(0) and P * 0 is ex.const(0) and -(-P) is P and (P + 1) is (P + 1)
    assert 2 * (3 * P) is 6 * P
    with pytest.raises(NumericsError):
        P / 0
    with pytest.raises(ValidationError):
        ex.derivative(P, 0, 3)


def test_files_and_restart(spark, noisy, tmp_path):
    path = tmp_path / "p_5.field"
    path.write_bytes(files.binary(noisy.df, noisy.mesh, "p"))
    back = files.read(spark, f"file://{path}", noisy.mesh, "p")
    assert reduce.difference(noisy.df, back, "p").first()["max_diff"] == 0
    text = tmp_path / "p.dat"
    text.write_text(files.dat(noisy.df, noisy.mesh, "p"))
    assert reduce.difference(noisy.df, files.read(spark, f"file://{text}", noisy.mesh, "p"), "p").first()["max_diff"] < 1e-12
    image = files.vti(noisy.df, noisy.mesh, "p", double=True)
    at = image.index(b"_") + 1
    at = image.index(b'encoding="raw">\n_') + len(b'encoding="raw">\n_')
    assert np.frombuffer(image, "<u8", 1, at)[0] == 8 * noisy.mesh.cells
    assert b"STRUCTURED_POINTS" in files.vtk_legacy(noisy.df, noisy.mesh, "p") and "StructuredGrid" in files.vts(noisy.df, noisy.mesh, "p")
    files.save(noisy.df, f"file://{tmp_path}/state", 10)
    assert files.steps(spark, f"file://{tmp_path}/state") == [10] and files.load(spark, f"file://{tmp_path}/state", 10).count() == noisy.mesh.cells
    assert files.resolve([0, 10, 20], 15) == (10, False) and files.resolve([], "initial_field") == (0, True)
    run = ev.Run({"p": stencils.laplacian(P, noisy.mesh)}, 0.1)
    whole = run.advance(noisy, 2)
    half = ev.Run({"p": stencils.laplacian(P, noisy.mesh)}, 0.1).advance(noisy, 1)
    files.save(half.df, f"file://{tmp_path}/half", 1)
    again = ev.Run({"p": stencils.laplacian(P, noisy.mesh)}, 0.1).advance(noisy.with_df(files.load(spark, f"file://{tmp_path}/half", 1)), 1)
    assert reduce.difference(whole.df, again.df, "p").first()["max_diff"] == 0
    assert files.formats("BINARY+VTI") == {"BINARY", "VTI"}
    with pytest.raises(ConfigError):
        files.formats("PNG")


def test_config_and_boundaries():
    c = config.parse('{"mesh": {"nx": 4 // cells\n}, "name": "a//b"}')
    assert c["mesh"].get("nx", int) == 4 and c.get("name", str) == "a//b"
    with pytest.raises(ConfigError):
        c["mesh"]["ny"]
    with pytest.raises(ConfigError):
        from_config({"x_min": "periodic", "x_max": "noflux"}, Mesh.uniform(4))
    with pytest.raises(ConfigError):
        from_config({"x_min": "noflux"}, Mesh.uniform(4))
    assert from_config({"x_min": {"type": "fixed", "value": 2}, "x_max": "noflux"}, Mesh.uniform(4)).x[0] == fixed(2.0)


def test_mesh():
    mesh = Mesh.from_text("dim 2 # plane\ncoordSys CARTESIAN\nnx 4 dx 0.5 x0 1\nny 3 dy 2 y0 0")
    assert mesh.n == (4, 3, 1) and Mesh.from_text(mesh.to_text()) == mesh and mesh.patch("xmin").cells == 3
    with pytest.raises(ValidationError):
        Mesh((4, 3, 1), patches=(Patch("a", 0, -1, (0, 0, 0), (1, 2, 1)),))
    with pytest.raises(ValidationError):
        stencils.laplacian(P, Mesh.uniform(4, coordinates="SPHERICAL"))


def test_material():
    k = material.KKS(2.0, 3.0, 0.2, 0.7, 0.1, 0.15)
    mu, cs, cl = k.partition(0.5, 0.3)
    assert 0.3 * cs + 0.7 * cl == pytest.approx(0.5) and 2 * (cs - 0.2) == pytest.approx(mu) and 3 * (cl - 0.7) == pytest.approx(mu)
    mu, cs, cl = k.equilibrium()
    fs, fl = (cs - 0.2) ** 2 + 0.1, 1.5 * (cl - 0.7) ** 2 + 0.15
    assert fs - mu * cs == pytest.approx(fl - mu * cl)
    table = files.energy_table("# c T\n3 2 0 1 0 10\n0 1\n1, 2\n4 5")
    assert table.at(0.25, 5) == pytest.approx(1.0) and table.at(9, 99) == 5
    assert material.Cooling(1000, 10, 300, 1200).temperature(1000) == 300


def test_frame_log_and_health(spark, noisy):
    frame = MovingFrame(0, {"p": ("constant", 9.0)}, record=True)
    moved = frame.shift(noisy)
    assert moved.df.count() == noisy.mesh.cells and moved.df.filter("i = 11 and p = 9").count() == 9 and frame.conveyor.count() == 9
    log = Log(["time", "energy"])
    log.add(0, 1)
    with pytest.raises(ValidationError):
        log.add(1)
    assert log.csv() == "time,energy\n0.0,1.0\n"
    bad = noisy.assign({"p": ex.where(coord(0) < 1, float("nan"), P)})
    with pytest.raises(NumericsError):
        reduce.check_health(bad.df, ["p"])


def test_benchmark_energy(spark):
    """First energy of the spinodal benchmark on 200 x 200 cells."""
    mesh = Mesh.uniform(200, 200)
    grid = make(spark, mesh, {"p": spinodal()}, Boundary.all(PERIODIC))
    bulk = 5.0 * (P - 0.3) * (P - 0.3) * (0.7 - P) * (0.7 - P)
    got = reduce.functional(grid, {"f": ("sum", bulk + 1.0 * stencils.grad_squared(P, mesh)), "c": ("sum", P)}).first()
    assert got["c"] == pytest.approx(20100.915, abs=0.01)
    assert got["f"] == pytest.approx(319.0969, abs=0.05)
