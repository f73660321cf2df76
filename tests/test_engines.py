"""Loops whose plans stay small, boundaries that are functions, solvers on other problems, guards and output."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_grid import array

from fieldloom.errors import ConfigError, NumericsError, ValidationError
from fieldloom.mesh import Mesh, Patch
from fieldloom.operators import anisotropy, reduce, solvers, stencils
from fieldloom.operators.boundary import NOFLUX, PERIODIC, REFLECT, Boundary, Rule, by_patch, custom, fixed, from_config, register, wall_value
from fieldloom.plans import expr as ex
from fieldloom.plans.arrays import evolve
from fieldloom.plans.blocks import Blocks
from fieldloom.plans.expr import coord, field
from fieldloom.plans.lower import Grid
from fieldloom.plans.schemes import Schemes
from fieldloom.plans.system import System
from fieldloom.sources import files, initial
from fieldloom.sources.initial import make
from fieldloom.queries_more import spinodal_parts, spinodal_start
from fieldloom.sources.output import OutputWriter, by_settings
from fieldloom.sources.scratch import stored
from fieldloom.streaming import evolve as ev
from fieldloom.streaming.frame import Log, MovingFrame
from fieldloom.timers import Timers

P = field("p")


def plan_lines(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_plans_stay_small_over_a_hundred_steps(spark):
    grid = make(spark, Mesh.uniform(6, 4), {"p": "random:0:1"}, Boundary.all(PERIODIC))
    s = System(grid)
    s.define("mu", P * P - ex.lap(P))
    s.evolve("p", 0.01 * ex.lap(field("mu")))
    total, sizes = grid.df.agg(F.sum("p")).first()[0], []
    for _ in range(100):
        s.advance(0.01)
        sizes.append(plan_lines(s.grid.df))
    assert max(sizes[8:]) <= max(sizes[:8]) and s.step == 100
    assert s.grid.df.agg(F.sum("p")).first()[0] == pytest.approx(total)


def test_plans_stay_small_over_a_hundred_shifts(spark):
    grid = make(spark, Mesh.uniform(5, 3), {"p": coord(0)}, Boundary.all(NOFLUX))
    frame, sizes = MovingFrame(0, {"p": ("slope", 1.0)}, record=True), []
    for _ in range(100):
        grid = frame.shift(grid)
        sizes.append(plan_lines(grid.df))
    assert max(sizes[8:]) <= max(sizes[:8])
    assert np.allclose(array(grid.df, "p", grid.mesh)[0], np.arange(5) + 100.5)
    assert frame.conveyor.count() == 300 and sorted(r[0] for r in frame.conveyor.filter("j = 0").select("p").collect()) == [k + 0.5 for k in range(100)]


@pytest.mark.parametrize("towards", ["high", "low"])
def test_one_cell_frames_and_tracking(spark, towards):
    grid = make(spark, Mesh.uniform(6), {"p": coord(0), "q": coord(0)})
    frame = MovingFrame(0, {"p": ("constant", 9.0)}, towards)
    assert [r["p"] for r in frame.shift(grid).df.orderBy("i").collect()] == ([1.5, 2.5, 3.5, 4.5, 5.5, 9.0] if towards == "high" else [9.0, 0.5, 1.5, 2.5, 3.5, 4.5])
    one = make(spark, Mesh.uniform(1), {"p": "uniform:2", "q": "uniform:3"})
    assert [tuple(r) for r in frame.shift(one).df.select("p", "q").collect()] == [(9.0, 3.0)]
    with pytest.raises(NumericsError):
        frame.track(grid, lambda g: 1.0, 0.0)


def test_tiles_are_stored_between_rounds(spark):
    grid = make(spark, Mesh.uniform(10, 8), {"p": "random:0:1", "q": coord(0)}, Boundary.all(PERIODIC))
    rhs = {"p": stencils.laplacian(P, grid.mesh) * field("q")}
    got = evolve(grid, rhs, 0.001, 12, (5, 4), 2)
    plain = ev.Run(rhs, 0.001).advance(grid, 12)
    assert reduce.difference(got.df, plain.df, "p").first()["max_diff"] < 1e-14
    assert plan_lines(got.df) < 40
    with pytest.raises(ValidationError):
        evolve(Grid(grid.df, grid.mesh, {}, Boundary.all(wall_value(1.0))), rhs, 0.1, 1)


@pytest.mark.parametrize("sides", [(PERIODIC, PERIODIC), (NOFLUX, fixed(0.5)), (REFLECT, NOFLUX)])
def test_blocks_equal_steps(spark, sides):
    """Any tiles, any number of steps between exchanges, auxiliary fields with their own ghosts."""
    boundary = Boundary(sides if sides[0] is not PERIODIC else (PERIODIC, PERIODIC), (NOFLUX, NOFLUX) if sides[0] is NOFLUX else (PERIODIC, PERIODIC))
    mesh = Mesh.uniform(24, 16)
    grid = make(spark, mesh, {"p": "random:0:1", "q": 0.01 * coord(0)}, boundary)
    grid = grid.with_df(stored(grid.df)[0])
    define = {"m": P * P - stencils.laplacian(P, mesh)}
    rhs = {"p": stencils.laplacian(field("m"), mesh) + 0.1 * field("q"), "q": stencils.laplacian(field("q"), mesh) * P + 0.01 * coord(1)}
    steps = grid
    for _ in range(5):
        steps = ev.euler_step(steps.assign(define), rhs, 0.01)
        steps = steps.with_df(stored(steps.df.drop("m"))[0])
    for tile, depth in (((24, 16), 9), ((8, 8), 2), ((12, 16), 2), ((24, 4), 1)):
        got = Blocks.of(grid, tile).advance(rhs, 0.01, 5, define, depth)
        back = got.grid().df
        assert max(reduce.difference(steps.df, back, f).first()["max_diff"] for f in "pq") < 1e-14
    assert got.sums({"s": P}).first()["s"] == pytest.approx(steps.df.agg(F.sum("p")).first()[0])
    with pytest.raises(ValidationError):
        Blocks.of(grid, (7, 8))
    with pytest.raises(ValidationError):
        Blocks.of(grid, (1, 16)).advance(rhs, 0.01, 1, define)


@pytest.mark.parametrize("tile", [(24, 16), (8, 8)])
def test_operators_on_blocks_equal_columns(spark, tile):
    mesh = Mesh.uniform(24, 16)
    grid = make(spark, mesh, {"p": "random:0:1", "u": "random:-1:1"}, Boundary.all(PERIODIC))
    outputs = {"w": stencils.advection((field("u"), -field("u")), P, mesh, "WENO5"), "a": anisotropy.aniso_div(P, mesh, anisotropy.Anisotropy(eps=0.05, theta0=0.3)), "l": stencils.laplacian(P * coord(0), mesh, "Iso9")}
    got, expected = Blocks.of(grid, tile).select(outputs).grid(), grid.select(outputs)
    for f in outputs:
        assert reduce.difference(got.df, expected, f).first()["max_diff"] < 1e-11


def test_golden_energies(spark):
    """The published energies of the spinodal benchmark: first ones of three meshes, and that after 10,000 steps on 200 x 200 cells."""
    for n, energy, total in ((200, 319.093815835, 20101.904734), (1024, 8363.67875796, 526932.751492), (2048, 33454.8030, None)):
        blocks = spinodal_start(spark, n, (n // 2, n // 2))
        got = blocks.sums(spinodal_parts(blocks.mesh)[2]).first()
        assert got["free_energy"] == pytest.approx(energy, rel=1e-9 if total else 1e-8) and (total is None or got["total_c"] == pytest.approx(total, rel=1e-11))
    start = spinodal_start(spark, 200, (200, 200))
    define, rhs, sums = spinodal_parts(start.mesh)
    end = start.advance(rhs, 1e-3, 10_000, define).sums(sums).first()
    assert end["free_energy"] == pytest.approx(297.774416207, rel=1e-10) and end["total_c"] == pytest.approx(20101.904734, rel=1e-11)


# boundaries


@pytest.mark.parametrize("line", [1 << 20, 5])
def test_rules_that_are_functions(spark, line):
    base = make(spark, Mesh.uniform(12, 7), {"p": "random:0:1"})
    extrapolated = custom(lambda cell, d: cell(0) + d * (cell(0) - cell(1)), 2)
    grid = Grid(base.df, base.mesh, {}, Boundary((extrapolated, wall_value(3.0)), (NOFLUX, wall_value(-1.0))), line)
    got = grid.select({f"o{k}": ex.at("p", o) for k, o in enumerate(((-1, 0, 0), (-2, 0, 0), (2, 0, 0), (0, 1, 0), (1, 1, 0)))})
    p = array(base.df, "p", base.mesh)[0]
    o = [array(got, f"o{k}", base.mesh)[0] for k in range(5)]
    assert np.allclose(o[0][:, 0], 2 * p[:, 0] - p[:, 1]) and np.allclose(o[1][:, 0], 3 * p[:, 0] - 2 * p[:, 1]) and np.allclose(o[1][:, 1], 2 * p[:, 0] - p[:, 1])
    assert np.allclose(o[2][:, 11], 6 - p[:, 10]) and np.allclose(o[2][:, 10], 6 - p[:, 11]) and np.allclose(o[2][:, :10], p[:, 2:])
    assert np.allclose(o[3][6], -2 - p[6]) and np.allclose(o[4][6, :11], -2 - p[6, 1:]) and np.allclose(o[4][6, 11], 6 - (-2 - p[6, 11]))
    grid.default.certify(1, 2)
    with pytest.raises(ValidationError):
        grid.default.certify(3, 2)


def test_rules_by_patch_and_by_name(spark):
    mesh = Mesh((6, 5, 1), patches=(Patch("in", 0, -1, (0, 0, 0), (1, 2, 1)), Patch("out", 0, -1, (0, 2, 0), (1, 5, 1))))
    rule = by_patch({"in": fixed(4.0), "out": wall_value(1.0)}, mesh)
    base = make(spark, mesh, {"p": "random:0:1"}, Boundary((rule, NOFLUX)))
    p, got = array(base.df, "p", mesh)[0], array(base.select({"a": ex.at("p", (-1, 0, 0))}), "a", mesh)[0]
    assert (got[:2, 0] == 4).all() and np.allclose(got[2:, 0], 2 - p[2:, 0]) and np.array_equal(got[:, 1:], p[:, :-1])
    with pytest.raises(ConfigError):
        by_patch({"in": fixed(4.0)}, mesh)
    with pytest.raises(ConfigError):
        Rule("custom")
    register("mirror", lambda spec: custom(lambda cell, d: spec["sign"] * cell(d - 1), 9))
    made = from_config({"x_min": {"type": "mirror", "sign": -1}, "x_max": {"type": "wall", "value": 2}}, Mesh.uniform(4))
    assert made.x[0].kind == made.x[1].kind == "custom"
    with pytest.raises(ConfigError):
        register("fixed", lambda spec: fixed(0.0))


# solvers


def dense(mesh, rule, coefficient=None):
    """-div(a grad x) as a matrix, for zero walls (value 0 between cells) or periodic sides."""
    n = mesh.n[0] * mesh.n[1]
    out, at = np.zeros((n, n)), lambda x, y: y * mesh.n[0] + x
    for y in range(mesh.n[1]):
        for x in range(mesh.n[0]):
            for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                u, v = x + dx, y + dy
                inside = 0 <= u < mesh.n[0] and 0 <= v < mesh.n[1]
                if rule == "periodic":
                    u, v, inside = u % mesh.n[0], v % mesh.n[1], True
                a = 1.0 if coefficient is None else 0.5 * (coefficient[y, x] + (coefficient[v, u] if inside else coefficient[y, x]))
                out[at(x, y), at(x, y)] += a if inside else 2 * a if rule in ("wall", "value") else a
                if inside:
                    out[at(x, y), at(u, v)] -= a
    return out


@pytest.mark.parametrize("rule", ["periodic", "wall", "value", "fixed"])
def test_conjugate_gradients_with_boundary_values(spark, rule):
    """Values on the boundary enter the right-hand side once, not the search directions."""
    mesh = Mesh.uniform(6, 5)
    side = {"periodic": PERIODIC, "wall": wall_value(0.0), "value": wall_value(1.0), "fixed": fixed(2.0)}[rule]
    grid = make(spark, mesh, {"x": "uniform:0", "b": "random:-1:1", "other": coord(0)}, boundaries={"x": Boundary.all(side)})
    got = solvers.conjugate_gradient(grid, "x", "b", solvers.System(solvers.laplace(mesh), 1.0, 1.0), 1e-10, 80)
    matrix, b = np.eye(30) + dense(mesh, rule), array(grid.df, "b", mesh)[0].ravel()
    if rule in ("fixed", "value"):  # both add 2 at each side
        edge = np.zeros((5, 6))
        edge[0] += 2
        edge[-1] += 2
        edge[:, 0] += 2
        edge[:, -1] += 2
        b = b + edge.ravel()
    assert np.allclose(array(got.grid.df, "x", mesh)[0].ravel(), np.linalg.solve(matrix, b), atol=1e-8)
    assert got.grid.fields == grid.fields and got.converged


def test_multigrid_with_variable_coefficients(spark):
    mesh = Mesh.uniform(16, 8)
    grid = make(spark, mesh, {"x": "uniform:0", "b": "random:-1:1", "a": 1 + 0.5 * ex.call("sin", 0.4 * coord(0))}, Boundary.all(NOFLUX))
    ax, ay = solvers.high_faces(field("a"))
    grid = grid.assign({"ax": ax, "ay": ay})
    got = solvers.multigrid(grid, "x", "b", 1.0, 1.0, tolerance=1e-5, along=("ax", "ay"))
    matrix = np.eye(128) + dense(mesh, "noflux", array(grid.df, "a", mesh)[0])
    matrix -= np.diag(np.diag(matrix) - (1 - (matrix - np.diag(np.diag(matrix))).sum(1)))  # no flux: rows sum to one
    assert np.allclose(array(got.grid.df, "x", mesh)[0].ravel(), np.linalg.solve(matrix, array(grid.df, "b", mesh)[0].ravel()), atol=1e-4)
    assert got.converged and got.iterations < 10


# guards, logs, timers, schemes


def test_health_guard(spark):
    grid = make(spark, Mesh.uniform(8), {"p": coord(0), "q": "uniform:0.5"})
    guard = reduce.HealthGuard(every=10).watch("p", "q").require("q is a fraction", (field("q") >= 0) & (field("q") <= 1))
    assert guard.check(grid, 10) and not guard.check(grid, 5) and not reduce.HealthGuard(every=0).check(grid, 0)
    with pytest.raises(NumericsError, match="q is a fraction fails in 3 cells, step 20"):
        guard.check(grid.assign({"q": ex.where(coord(0) < 3, 2.0, 0.5)}), 20)
    with pytest.raises(NumericsError, match="field p.*not finite"):
        guard.check(grid.assign({"p": ex.where(coord(0) < 1, float("nan"), P)}), 0)
    with pytest.raises(NumericsError, match="exceeds 2"):
        reduce.HealthGuard(["p"], 2.0, 1).check(grid, 1)
    with pytest.raises(NumericsError):  # a condition that is not a number fails
        reduce.HealthGuard(every=1).require("p", field("p") > 0).check(grid.assign({"p": ex.where(coord(0) < 1, -1.0, P)}), 1)


def test_logs_in_files(tmp_path):
    path = tmp_path / "a" / "log.csv"
    log = Log(["t", "e"], str(path))
    assert path.read_text() == "t,e\n"
    log.add(0, 1)
    assert path.read_text() == "t,e\n0.0,1.0\n"
    Log(["t", "e"], str(path), append=True).add(1, 2)
    assert path.read_text() == "t,e\n0.0,1.0\n1.0,2.0\n"
    with pytest.raises(ValidationError):
        Log(["t"], str(path), append=True)
    log.publish(str(tmp_path / "out"), "energy", {"case": "1a"})
    assert (tmp_path / "out" / "energy.csv").read_text() == log.csv() and "case: 1a" in (tmp_path / "out" / "meta.yaml").read_text()


def test_timers():
    timers = Timers()
    for _ in range(2):
        with timers.part("a"):
            pass
    assert timers.runs == {"a": 2} and timers.rate("a", 100) > 0 and "a: 0.0" in timers.report()


def test_schemes_beside_settings(tmp_path):
    settings = tmp_path / "settings.jsonc"
    assert Schemes.beside(str(settings), {"laplacian": "Iso9"}).resolve("laplacian", "p") == "Iso9"
    (tmp_path / "schemes.jsonc").write_text('{"laplacian": {"lap(p)": "CD4"} // one\n}')
    assert Schemes.beside(str(settings)).resolve("laplacian", "p") == "CD4"


# files


def test_streamed_files_equal_those_in_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE_ROWS", 7)
    grid = make(spark, Mesh.uniform(6, 5, 3, d=0.5), {"p": "random:-1:1", "q": coord(0)})
    df, mesh = grid.df.repartition(4), grid.mesh
    made = {"BINARY": files.binary(df, mesh, "p"), "VTI": files.vti(df, mesh, "p"), "VTI_F64": files.vti(df, mesh, "p", double=True), "VTK_BIN": files.vtk_legacy(df, mesh, "p"), "VTS": files.vts(df, mesh, "p").encode()}
    for kind, expected in made.items():
        files.write(df, mesh, f"file://{tmp_path}/{kind}", "p", kind)
        assert (tmp_path / kind).read_bytes() == expected, kind
    files.write(df, mesh, f"file://{tmp_path}/v.field", "v", columns=["p", "q"])
    assert (tmp_path / "v.field").read_bytes() == files.binary(df, mesh, "v", ["p", "q"])
    files.write(df, mesh, f"file://{tmp_path}/p.dat", "p", "DAT")
    assert reduce.difference(df, files.read(spark, f"file://{tmp_path}/p.dat", mesh, "p"), "p").first()["max_diff"] == 0
    assert not list(tmp_path.glob("*.part"))
    monkeypatch.setattr(files, "MOST_CELLS", 10)
    with pytest.raises(files.IOFailure):
        files.binary(df, mesh, "p")


def test_output_by_interval(spark, tmp_path):
    grid = make(spark, Mesh.uniform(6, 4), {"p": "random:0:1"}, Boundary.all(PERIODIC))
    out = OutputWriter(f"file://{tmp_path}", {"p": ["p"]}, 2, "BINARY+VTI")
    run = ev.Run({"p": stencils.laplacian(P, grid.mesh)}, 0.1, callbacks=[(1, out)])
    end = run.advance(grid, 4)
    assert out.written == ["p_2.field", "p_2.vti", "p_4.field", "p_4.vti"] and {x.name for x in tmp_path.glob("p*") } == {*out.written, "p.pvd"}
    assert reduce.difference(end.df, files.read(spark, f"file://{tmp_path}/p_4.field", grid.mesh, "p"), "p").first()["max_diff"] == 0
    assert (tmp_path / "p.pvd").read_text().count("<DataSet") == 2
    out.restart(0.3)
    out(4, 0.35, end)
    assert 'timestep="0.35"' in (tmp_path / "p.pvd").read_text() and (tmp_path / "p.pvd").read_text().count("<DataSet") == 2
    assert by_settings({"interval": 5, "format": "ALL"}, "x", {}).kinds == ["BINARY", "DAT", "PARQUET", "VTI_F64", "VTK_BIN", "VTS"]
    with pytest.raises(ConfigError):
        by_settings({"interval": 0}, "x", {})


# initial conditions


def test_initial_conditions(spark):
    mesh = Mesh.uniform(20, 20)
    got = make(spark, mesh, {**initial.ripening(2), "e": initial.charged(), "r": initial.precipitate(10.0, 10.0, 5.0), **initial.dendrite_seed()}).df.filter("i = 3 and j = 7").first()
    x, y, cos = 3.5, 7.5, np.cos
    waves = lambda first: cos(first * x) * cos(0.11 * y) + (cos(0.13 * x) * cos(0.087 * y)) ** 2 + cos(0.025 * x - 0.15 * y) * cos(0.07 * x - 0.02 * y)
    eta = lambda k: 0.1 * (cos(0.01 * k * x - 4) * cos((0.007 + 0.01 * k) * y) + cos((0.11 + 0.01 * k) * x) * cos((0.11 + 0.01 * k) * y) + 1.5 * (cos((0.046 + 0.001 * k) * x + (0.0405 + 0.001 * k) * y) * cos((0.031 + 0.001 * k) * x - (0.004 + 0.001 * k) * y)) ** 2) ** 2
    assert got["c"] == pytest.approx(0.5 + 0.05 * waves(0.105)) and got["e"] == pytest.approx(0.5 + 0.04 * waves(0.2)) and got["eta1"] == pytest.approx(eta(1)) and got["eta2"] == pytest.approx(eta(2))
    delta = 5 / (2 * np.arctanh(0.9))
    assert got["r"] == pytest.approx(0.0065 + 0.9935 * 0.5 * (1 - np.tanh((np.hypot(x - 10, y - 10) - 5) / delta)))
    assert got["phi"] == pytest.approx(-np.tanh((np.hypot(x, y) - 8) / np.sqrt(2))) and got["u"] == -0.3
