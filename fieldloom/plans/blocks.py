"""Long explicit runs on blocks: a row is a tile of cells, packed.

`plans.arrays` keeps a row a cell and sends each tile its halo in rows; that
costs more than the steps themselves. Here the state is a table with one row
a tile and its values as bytes. A round sends strips of neighbours, wide
enough for all its steps, and advances each tile in one task; between rounds
the table is stored. Along an axis with one tile no strips are needed: its
ghosts are filled again in every step. Auxiliary fields are computed from
the state in every step, before the rates that read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import Mesh
from ..operators.boundary import Boundary
from ..sources.scratch import remove, stored
from .arrays import _padded, evaluate, positions
from .expr import Expr, halo, samples
from .lower import Grid

#: Cells of a tile's side.
MOST_SIDE = 1 << 14
#: Cells that an expression is evaluated for at once, so that its intermediate arrays stay in a core's cache.
CHUNK = 1 << 15


@dataclass(frozen=True)
class Blocks:
    """df: tx, ty and a binary column for each field (float64, y slowest)."""

    df: DataFrame
    mesh: Mesh
    tile: tuple[int, int]
    fields: tuple[str, ...]
    boundaries: dict[str, Boundary]
    default: Boundary
    path: str | None = None

    @property
    def count(self) -> tuple[int, int]:
        return self.mesh.n[0] // self.tile[0], self.mesh.n[1] // self.tile[1]

    def boundary(self, name: str) -> Boundary:
        return self.boundaries.get(name, self.default)

    @classmethod
    def of(cls, grid: Grid, tile: tuple[int, int], fields: list[str] | None = None) -> Blocks:
        """The grid's fields in tiles that divide the mesh."""
        mesh, names = grid.mesh, tuple(fields or grid.fields)
        if mesh.dim != 2 or any(n % t or t > MOST_SIDE for n, t in zip(mesh.n, tile, strict=False)):
            raise ValidationError("Blocks", f"tiles of {tile} don't divide a mesh of {mesh.n[:2]}", "needs a 2D mesh")
        if not all(r.mapped for f in names for a in (0, 1) for r in grid.boundary(f).axis(a)):
            raise ValidationError("Blocks", "tiles take no custom rules and no rules by patch", "use Run or System")

        def pack(rows: pa.Table) -> pa.Table:
            i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
            at = (j % tile[1]) * tile[0] + i % tile[0]
            out = {"tx": pa.array([int(i[0]) // tile[0]], pa.int32()), "ty": pa.array([int(j[0]) // tile[1]], pa.int32())}
            for f in names:
                flat = np.full(tile[0] * tile[1], np.nan)
                flat[at] = rows.column(f).to_numpy()
                out[f] = pa.array([flat.tobytes()], pa.binary())
            return pa.table(out)

        keyed = grid.df.select((F.col("i") / tile[0]).cast("int").alias("tx"), (F.col("j") / tile[1]).cast("int").alias("ty"), "i", "j", *[F.col(f).cast("double").alias(f) for f in names])
        df, path = stored(keyed.groupBy("tx", "ty").applyInArrow(pack, "tx int, ty int, " + ", ".join(f"`{f}` binary" for f in names)))
        return cls(df, mesh, tile, names, grid.boundaries, grid.default, path)

    def grid(self) -> Grid:
        """Back to a row a cell."""
        tile, names = self.tile, self.fields

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.arange(tile[0] * tile[1])
            for batch in batches:
                for k in range(batch.num_rows):
                    i, j = (batch.column(c)[k].as_py() * s + p for c, s, p in (("tx", tile[0], at % tile[0]), ("ty", tile[1], at // tile[0])))
                    values = [pa.array(np.frombuffer(batch.column(f)[k].as_py(), "<f8")) for f in names]
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), *values], ["i", "j", "k", *names])

        df = self.df.mapInArrow(unpack, "i int, j int, k int, " + ", ".join(f"`{f}` double" for f in names))
        return Grid(df, self.mesh, self.boundaries, self.default)

    def _exchanged(self, width: tuple[int, int], run: Callable[[tuple[int, int], dict[str, np.ndarray]], dict], schema: str) -> DataFrame:
        """run(tile, padded arrays) for every tile; width: cells of neighbours along x and y (0: none are sent)."""
        names, tile, count = self.fields, self.tile, self.count
        wraps = [[self.boundary(f).axis(a)[0].kind == "periodic" for f in names] for a in (0, 1)]
        part = lambda d, w, n: slice(0, n) if d == 0 else slice(n - w, n) if d > 0 else slice(0, w)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (not dx or width[0]) and (not dy or width[1])]
            for batch in batches:
                for k in range(batch.num_rows):
                    tx, ty = batch.column("tx")[k].as_py(), batch.column("ty")[k].as_py()
                    own = {f: np.frombuffer(batch.column(f)[k].as_py(), "<f8").reshape(tile[1], tile[0]) for f in names}
                    rows = []
                    for dx, dy in moves:  # to the neighbour at (dx, dy), which has this tile at (-dx, -dy)
                        to = (tx + dx, ty + dy)
                        outside = [not 0 <= to[a] < count[a] for a in (0, 1)]
                        if any(outside[a] and not any(wraps[a]) for a in (0, 1)):
                            continue
                        strips = [own[f][part(dy, width[1], tile[1]), part(dx, width[0], tile[0])].tobytes() for f in names]
                        rows.append((to[0] % count[0], to[1] % count[1], -dx, -dy, *strips))
                    kinds = [pa.int32()] * 4 + [pa.binary()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["tx", "ty", "dx", "dy", *names])

        def step(rows: pa.Table) -> pa.Table:
            where = (rows.column("tx")[0].as_py(), rows.column("ty")[0].as_py())
            out = {f: np.zeros((tile[1] + 2 * width[1], tile[0] + 2 * width[0])) for f in names}
            span = lambda d, w, n: slice(w, w + n) if d == 0 else slice(w + n, n + 2 * w) if d > 0 else slice(0, w)
            for k in range(rows.num_rows):
                dx, dy = rows.column("dx")[k].as_py(), rows.column("dy")[k].as_py()
                for f in names:
                    target = out[f][span(dy, width[1], tile[1]), span(dx, width[0], tile[0])]
                    target[...] = np.frombuffer(rows.column(f)[k].as_py(), "<f8").reshape(target.shape)
            made = run(where, out)
            return pa.table({"tx": pa.array([where[0]], pa.int32()), "ty": pa.array([where[1]], pa.int32()), **made})

        sent = self.df.mapInArrow(send, "tx int, ty int, dx int, dy int, " + ", ".join(f"`{f}` binary" for f in names))
        return sent.groupBy("tx", "ty").applyInArrow(step, f"tx int, ty int, {schema}")

    def _stage(self, define: dict[str, Expr], last: dict[str, Expr], params: dict[str, float], width: tuple[int, int], reach: int) -> Callable:
        """A function (tile, padded state, arrays to write to) -> values of `last` on the whole arrays, right where enough of the halo is left."""
        mesh, tile, count = self.mesh, self.tile, self.count
        rules = {f: self.boundary(f) for f in (*self.fields, *define)}
        ghost = [0 if width[a] else reach for a in (0, 1)]  # ghosts along axes with one tile

        def filled(values: np.ndarray, name: str, lo: tuple[int, int]) -> None:
            for a in (1, 0):
                g = ghost[a]
                if g and rules[name].axis(a)[0].kind == "periodic":
                    turned = values if a == 1 else values.T
                    turned[:g], turned[-g:] = turned[-2 * g : -g].copy(), turned[g : 2 * g].copy()
            _padded(values, lo, mesh.n[:2], rules[name])

        def run(where: tuple[int, int], state: dict[str, np.ndarray], made: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            lo = tuple(where[a] * tile[a] - (width[a] or ghost[a]) for a in (0, 1))
            known = dict(state)
            shape = next(iter(state.values())).shape
            for f in state:
                filled(state[f], f, lo)

            def value(name: str, e: Expr) -> np.ndarray:
                r = halo(e)[0]
                if name not in made:
                    made[name] = np.zeros(shape)
                out, width = made[name], shape[1] - 2 * r
                for y in range(r, shape[0] - r, rows := max(1, CHUNK // width)):
                    n = min(rows, shape[0] - r - y)
                    at = lambda o: (slice(y + o[1], y + n + o[1]), slice(r + o[0], r + width + o[0]))  # noqa: B023, E731
                    place = lambda axis, by: positions(mesh, axis, lo[0] + r, lo[0] + r + width, by) if axis == 0 else positions(mesh, axis, lo[1] + y, lo[1] + y + n, by)  # noqa: B023, E731
                    out[at((0, 0))] = evaluate(e, lambda f, o: known[f][at(o)], place, params, {})  # noqa: B023
                return out

            for f, e in define.items():
                known[f] = value(f, e)
                filled(known[f], f, lo)
            return {f: value(f"rate of {f}", e) for f, e in last.items()}

        return run

    def _plan(self, define: dict[str, Expr], last: dict[str, Expr]) -> int:
        """Cells that one step reads beyond its own."""
        widths: dict[str, int] = {}
        for f, e in define.items():
            if unknown := {g for g, _ in samples(e)} - {*self.fields, *widths}:
                raise ValidationError("Blocks", f"{f} reads {sorted(unknown)} before they are defined")
            widths[f] = halo(e)[0] + max([0, *(widths.get(g, 0) for g, _ in samples(e))])
        return max([1, *(halo(e)[0] + max([0, *(widths.get(g, 0) for g, _ in samples(e))]) for e in last.values())])

    def advance(self, rhs: dict[str, Expr], dt: float, steps: int, define: dict[str, Expr] | None = None, depth: int = 64, params: dict[str, float] | None = None) -> Blocks:
        """Euler steps of all fields at once; depth: most steps between exchanges (all of them with one tile)."""
        define, reach, out = define or {}, self._plan(define or {}, rhs), self
        several = [c > 1 for c in self.count]
        depth = min(depth, min(t // reach for t, s in zip(self.tile, several, strict=True) if s)) if any(several) else steps
        if depth < 1 and steps:
            raise ValidationError("Blocks", f"tiles of {self.tile} are smaller than the {reach} cells that a step reads")
        done = 0
        while done < steps:
            now = min(depth, steps - done)
            width = tuple(reach * now if s else 0 for s in several)
            rates, tile = out._stage(define, rhs, params or {}, width, reach), out.tile
            ghost = tuple(0 if s else reach for s in several)

            def run(where: tuple[int, int], state: dict[str, np.ndarray], now=now, rates=rates, ghost=ghost, width=width) -> dict:  # noqa: ANN001
                state, made = {f: np.pad(x, ((ghost[1],) * 2, (ghost[0],) * 2)) for f, x in state.items()}, {}
                for _ in range(now):
                    for f, rate in rates(where, state, made).items():
                        rate *= dt
                        state[f] += rate
                at = tuple(slice((width[a] or ghost[a]), (width[a] or ghost[a]) + tile[a]) for a in (1, 0))
                return {f: pa.array([np.ascontiguousarray(x[at]).tobytes()], pa.binary()) for f, x in state.items()}

            df, path = stored(out._exchanged(width, run, ", ".join(f"`{f}` binary" for f in self.fields)))
            if out.path and out is not self:
                remove(df.sparkSession, out.path)
            out = replace(out, df=df, path=path)
            done += now
        return out

    def _once(self, outputs: dict[str, Expr], define: dict[str, Expr] | None, params: dict[str, float] | None, made: Callable[[np.ndarray], pa.Array], kind: str) -> DataFrame:
        """One exchange; made(a tile's values) for each output."""
        reach = self._plan(define or {}, outputs)
        several = [c > 1 for c in self.count]
        width, ghost = tuple(reach if s else 0 for s in several), tuple(0 if s else reach for s in several)
        if any(w > t for w, t in zip(width, self.tile, strict=True)):
            raise ValidationError("Blocks", f"tiles of {self.tile} are smaller than the {reach} cells that are read")
        values, tile = self._stage(define or {}, outputs, params or {}, width, reach), self.tile

        def run(where: tuple[int, int], state: dict[str, np.ndarray]) -> dict:
            state = {f: np.pad(x, ((ghost[1],) * 2, (ghost[0],) * 2)) for f, x in state.items()}
            at = tuple(slice((width[a] or ghost[a]), (width[a] or ghost[a]) + tile[a]) for a in (1, 0))
            return {f: made(x[at]) for f, x in values(where, state, {}).items()}

        return self._exchanged(width, run, ", ".join(f"`{f}` {kind}" for f in outputs))

    def select(self, outputs: dict[str, Expr], define: dict[str, Expr] | None = None, params: dict[str, float] | None = None) -> Blocks:
        """Expressions of the fields, in the same tiles."""
        df = self._once(outputs, define, params, lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), "binary")
        return replace(self, df=df, fields=tuple(outputs), path=None)

    def sums(self, outputs: dict[str, Expr], define: dict[str, Expr] | None = None, params: dict[str, float] | None = None) -> DataFrame:
        """One row with the sum of each expression over all cells."""
        parts = self._once(outputs, define, params, lambda x: pa.array([float(x.sum())], pa.float64()), "double")
        return parts.agg(*[F.sum(f).alias(f) for f in outputs])
