"""A window that moves with the front, and time series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attribute
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NumericsError, ValidationError
from ..mesh import KEYS
from ..plans.lower import Grid
from ..sources.scratch import remove, stored


@dataclass
class MovingFrame:
    """Shift content one cell towards the low (towards="high") or high end; the leading slice is a constant, or its old value plus a slope.

    fill: {field: ("constant", v) | ("slope", dv)}. conveyor: keeps exiting
    slices in a table with the shift's number. A shift is one projection:
    keys move, and cells of the leading slice become two rows. The state is
    stored every store_every shifts.
    """

    axis: int
    fill: dict[str, tuple[str, float]]
    towards: str = "high"
    record: bool = False
    shifts: int = 0
    conveyor: DataFrame | None = None
    store_every: int = 8
    paths: list[str] = attribute(default_factory=list)

    def shift(self, grid: Grid) -> Grid:
        if grid.mesh.dim > 2 or self.towards not in ("high", "low"):
            raise ValidationError("MovingFrame", "needs a 1D or 2D mesh and towards high or low")
        key, n = KEYS[self.axis], grid.mesh.n[self.axis]
        move, lead, leave = (-1, n - 1, 0) if self.towards == "high" else (1, 0, n - 1)
        if self.record:
            out = grid.df.filter(F.col(key) == leave).withColumn("shift", F.lit(self.shifts))
            self.conveyor = out if self.conveyor is None else self.conveyor.unionByName(out)
        values = {}
        for name in grid.fields:
            kind, v = self.fill.get(name, ("slope", 0.0))
            if kind not in ("constant", "slope"):
                raise ValidationError("MovingFrame", f"unknown fill {kind}")
            values[name] = F.lit(float(v)) if kind == "constant" else F.col(name) + F.lit(float(v))
        columns = grid.df.columns
        moved = F.struct(*[(F.col(c) + move if c == key else F.col(c)).alias(c) for c in columns])
        fresh = F.struct(*[values.get(c, F.col(c)).alias(c) for c in columns])
        rows = F.array_compact(F.array(F.when(F.col(key) != leave, moved), F.when(F.col(key) == lead, fresh)))
        df = grid.df.select(F.explode(rows).alias("__r")).select("__r.*")
        self.shifts += 1
        if self.shifts % self.store_every == 0:
            df = self._stored(df)
        return grid.with_df(df)

    def _stored(self, df: DataFrame) -> DataFrame:
        old = list(self.paths)
        df, path = stored(df)
        self.paths = [path]
        if self.conveyor is not None:
            self.conveyor, path = stored(self.conveyor)
            self.paths.append(path)
        remove(df.sparkSession, *old)
        return df

    def track(self, grid: Grid, position: Callable[[Grid], float], anchor: float) -> Grid:
        """Shift until the position is back at the anchor."""
        for _ in range(grid.mesh.n[self.axis] + 1):
            if position(grid) <= anchor:
                return grid
            grid = self.shift(grid)
        raise NumericsError("MovingFrame", "the front doesn't come back to the anchor")


class Log:
    """A time series of doubles with fixed columns; rows are few (one a diagnosed step) and go out as CSV or a table.

    path: a file on the driver that gets the head at once and every row as
    it comes. append: go on with a file that is there; its columns must be
    the same.
    """

    def __init__(self, columns: list[str], path: str | None = None, append: bool = False):
        self.columns, self.rows, self.path = columns, [], Path(path) if path else None
        if self.path and append and self.path.exists():
            head = self.path.read_text(encoding="utf-8").split("\n", 1)[0]
            if head != ",".join(columns):
                raise ValidationError("Log", f"{path} has the columns {head}")
        elif self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(",".join(columns) + "\n", encoding="utf-8")

    def add(self, *row: float) -> None:
        if len(row) != len(self.columns):
            raise ValidationError("Log", f"{len(row)} values for {len(self.columns)} columns")
        self.rows.append(tuple(map(float, row)))
        if self.path:
            with self.path.open("a", encoding="utf-8") as file:  # closed, so flushed, with every row
                file.write(",".join(map(repr, self.rows[-1])) + "\n")

    def publish(self, folder: str, name: str, notes: dict[str, str]) -> None:
        """The whole series and its description, name.csv and meta.yaml, in a folder on the driver."""
        where = Path(folder)
        where.mkdir(parents=True, exist_ok=True)
        (where / f"{name}.csv").write_text(self.csv(), encoding="utf-8")
        (where / "meta.yaml").write_text(self.metadata(name, notes), encoding="utf-8")

    def frame(self, spark):  # noqa: ANN001, ANN201
        return spark.createDataFrame(self.rows, ", ".join(f"`{c}` double" for c in self.columns))

    def csv(self, head: bool = True) -> str:
        return "".join([",".join(self.columns) + "\n"] * head + [",".join(map(repr, r)) + "\n" for r in self.rows])

    def metadata(self, name: str, notes: dict[str, str]) -> str:
        """A small description beside the CSV."""
        return "\n".join(["---", f"name: {name}", "columns:", *(f"  - {c}" for c in self.columns), *(f"{k}: {v}" for k, v in sorted(notes.items()))]) + "\n"
