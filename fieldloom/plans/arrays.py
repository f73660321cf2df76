"""Expressions on arrays, and long time loops on halo tiles.

For many steps a stage of windows a step costs too much. A tile is sent
with a halo as wide as all steps of a round together and advances them in
one task; only then are tiles exchanged again. Boundary rules are applied
inside the tile in every step. This works for local expressions alone:
anything that needs a global scalar in a step (adaptive dt, solvers) uses
the column lowering.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import Mesh
from ..operators.boundary import Boundary
from ..sources.scratch import remove, stored
from .expr import Expr, halo, samples
from .lower import Grid

_UNARY = {"sin": np.sin, "cos": np.cos, "tanh": np.tanh, "exp": np.exp, "log": np.log, "sqrt": np.sqrt, "abs": np.abs, "neg": np.negative}
_BINARY = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide, "atan2": np.arctan2, "hypot": np.hypot, "min": np.minimum, "max": np.maximum,
    "lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal,
}


def evaluate(e: Expr, sample: Callable[[str, tuple[int, int, int]], np.ndarray], place: Callable[[int, int], np.ndarray], params: dict[str, float], seen: dict | None = None) -> np.ndarray:
    """The expression on arrays; place(axis, by): coordinates of cell centres so many cells on."""
    seen = {} if seen is None else seen
    if e in seen:
        return seen[e]
    go = lambda a: evaluate(a, sample, place, params, seen)
    with np.errstate(all="ignore"):
        if e.op == "const":
            out = np.float64(e.payload)
        elif e.op == "param":
            out = np.float64(params[e.payload])
        elif e.op == "coord":
            out = place(*e.payload)
        elif e.op == "sample":
            out = sample(*e.payload)
        elif e.op in _UNARY:
            out = _UNARY[e.op](go(e.args[0]))
        elif e.op in _BINARY:
            out = _BINARY[e.op](go(e.args[0]), go(e.args[1]))
        elif e.op == "pow":
            base = go(e.args[0])
            out = base * base if e.payload == 2 else np.power(base, e.payload)
        elif e.op == "where":
            out = np.where(go(e.args[0]) != 0, go(e.args[1]), go(e.args[2]))
        elif e.op in ("and", "or"):
            out = (np.logical_and if e.op == "and" else np.logical_or)(go(e.args[0]) != 0, go(e.args[1]) != 0)
        else:
            raise ValidationError("arrays", f"{e.op} has no scheme yet")
    seen[e] = out
    return out


def positions(mesh: Mesh, axis: int, lo: int, hi: int, by: int = 0) -> np.ndarray:
    """Coordinates of cells lo to hi, moved by so many cells; cells beyond the mesh have those of the cells that they repeat."""
    return (mesh.origin[axis] + (np.arange(lo, hi) % mesh.n[axis] + 0.5 + by) * mesh.d[axis]).reshape((1, -1) if axis == 0 else (-1, 1))


def _padded(values: np.ndarray, lo: tuple[int, int], n: tuple[int, int], rules: Boundary) -> np.ndarray:
    """Cells beyond the domain set by the rules, y first and then x; values[y, x] begins at cell lo = (x, y)."""
    for axis in (1, 0):
        at = np.arange(values.shape[1 - axis]) + lo[axis]
        for k in np.flatnonzero((at < 0) | (at >= n[axis])):
            rule = rules.axis(axis)[int(at[k] >= n[axis])]
            if rule.kind == "periodic":
                continue  # the halo already holds the wrapped cells
            to = rule.index(int(at[k]), n[axis])
            where = (slice(None), k) if axis == 0 else (k, slice(None))
            if to is None:
                values[where] = rule.value
            elif 0 <= to - lo[axis] < values.shape[1 - axis]:
                source = to - lo[axis]
                values[where] = values[:, source] if axis == 0 else values[source, :]
    return values


def evolve(grid: Grid, rhs: dict[str, Expr], dt: float, steps: int, tile: tuple[int, int] = (256, 256), depth: int = 8, params: dict[str, float] | None = None) -> Grid:
    """Euler steps of all fields at once on a 2D mesh, `depth` of them between exchanges."""
    mesh, params = grid.mesh, params or {}
    if mesh.dim > 2:
        raise ValidationError("evolve", "needs a 1D or 2D mesh")
    if not all(r.mapped for f in rhs for a in range(mesh.dim) for r in grid.boundary(f).axis(a)):
        raise ValidationError("evolve", "tiles take no custom rules and no rules by patch", "use Run or System")
    reach = max(1, *(halo(e)[0] for e in rhs.values()))
    read = sorted({f for e in rhs.values() for f, _ in samples(e)} | set(rhs))
    others = [c for c in grid.fields if c not in read]
    done, path = 0, None
    while done < steps:
        now = min(depth, steps - done)
        df = _round(grid, mesh, rhs, read, dt, now, reach * now, reach, tile, params)
        rest = grid.df.select("i", "j", "k", *others) if others else None
        df = df.join(rest, ["i", "j", "k"]) if rest is not None else df
        done += now
        if done < steps:  # the next exchange begins from a table
            (df, new), old = stored(df), path
            if old:
                remove(df.sparkSession, old)
            path = new
        grid = grid.with_df(df)
    return grid


def _round(grid: Grid, mesh: Mesh, rhs: dict[str, Expr], read: list[str], dt: float, steps: int, width: int, reach: int, tile: tuple[int, int], params: dict[str, float]):  # noqa: ANN202
    n, keys = mesh.n[:2], ("i", "j")

    def copies(axis: int):  # noqa: ANN202
        """Tiles that need a cell, with its place in their numbering (outside the domain where it wraps)."""
        key, size, count = F.col(keys[axis]), tile[axis], n[axis]
        last = (count - 1) // size
        wraps = any(grid.boundary(f).axis(axis)[0].kind == "periodic" for f in read)
        around = -(-width // count)
        places = [key] + ([key + s * count for s in range(-around, around + 1) if s] if wraps else [])
        out = []
        for p in places:
            first = F.greatest(F.floor((p - width) / size), F.lit(0)).cast("int")
            end = F.least(F.floor((p + width) / size), F.lit(last)).cast("int")
            tiles = F.when(first <= end, F.sequence(first, F.greatest(first, end))).otherwise(F.array().cast("array<int>"))
            each = F.transform(tiles, lambda t: F.struct(t.alias("t"), p.cast("int").alias("p")))  # noqa: B023
            ends = lambda s: F.least((s["t"] + 1) * size, F.lit(count))  # noqa: B023, E731
            out.append(F.filter(each, lambda s: (s["p"] >= s["t"] * size - width) & (s["p"] < ends(s) + width)))  # noqa: B023
        return F.explode(F.concat(*out))

    spread = grid.df.select(copies(0).alias("x"), "j", *read).select("x", copies(1).alias("y"), *read)
    rules = {f: grid.boundary(f) for f in read}
    schema = "i int, j int, k int, " + ", ".join(f"`{f}` double" for f in read)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = key
        x0, x1, y0, y1 = tx * tile[0], min((tx + 1) * tile[0], n[0]), ty * tile[1], min((ty + 1) * tile[1], n[1])
        lo = (x0 - width, y0 - width if n[1] > 1 else 0)
        hi = (x1 + width, y1 + width if n[1] > 1 else 1)
        shape = (hi[1] - lo[1], hi[0] - lo[0])
        px, py = rows["px"].to_numpy() - lo[0], rows["py"].to_numpy() - lo[1]
        good = (py >= 0) & (py < shape[0])
        state = {}
        for f in read:
            state[f] = np.zeros(shape)
            state[f][py[good], px[good]] = rows[f].to_numpy()[good]
        place = lambda axis, by: positions(mesh, axis, lo[axis], hi[axis], by)
        for _ in range(steps):
            for f in read:
                _padded(state[f], lo, n, rules[f])
            sample = lambda f, o: np.roll(state[f], (-o[1], -o[0]), (0, 1)) if o != (0, 0, 0) else state[f]
            seen: dict = {}
            new = {f: state[f] + dt * evaluate(e, sample, place, params, seen) for f, e in rhs.items()}
            state.update(new)  # cells within reach of the array's rim are wrong now, and are never used
        at = (slice(y0 - lo[1], y1 - lo[1]), slice(x0 - lo[0], x1 - lo[0]))
        jj, ii = np.meshgrid(np.arange(y0, y1), np.arange(x0, x1), indexing="ij")
        out = {"i": ii.ravel().astype(np.int32), "j": jj.ravel().astype(np.int32), "k": np.zeros(ii.size, np.int32)}
        return pd.DataFrame({**out, **{f: state[f][at].ravel() for f in read}})

    flat = spread.select(F.col("x.t").alias("tx"), F.col("y.t").alias("ty"), F.col("x.p").alias("px"), F.col("y.p").alias("py"), *read)
    return flat.groupBy("tx", "ty").applyInPandas(run, schema)
