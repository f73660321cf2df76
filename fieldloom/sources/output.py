"""Output by interval: field files, and the time index of image files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attribute

from ..errors import ConfigError
from ..plans.lower import Grid
from .files import FORMATS, formats, streamed, write

#: File name endings by format.
ENDINGS = {"BINARY": "field", "DAT": "dat", "VTK": "vts", "VTS": "vts", "VTK_BIN": "vtk", "VTI": "vti", "VTI_F64": "vti", "PARQUET": "parquet"}


@dataclass
class OutputWriter:
    """Writes fields when step % interval == 0; it is a callback of Run. fields: {name: columns}.

    Image files (VTI) are listed by physical time in <name>.pvd; on a
    restart entries from before its time stay.
    """

    folder: str
    fields: dict[str, list[str]]
    interval: int
    tokens: str = "BINARY"
    before: list[tuple[float, str]] = attribute(default_factory=list)
    written: list[str] = attribute(default_factory=list)

    def __post_init__(self) -> None:
        if self.interval <= 0:
            raise ConfigError("output", "intervals must be positive")
        self.kinds = sorted(formats(self.tokens))
        if len({ENDINGS[k] for k in self.kinds}) < len(self.kinds):  # of two formats with one ending the more exact one
            self.kinds = [k for k in self.kinds if not any(ENDINGS[o] == ENDINGS[k] and o > k for o in self.kinds)]

    def due(self, step: int) -> bool:
        return step % self.interval == 0

    def restart(self, time: float) -> None:
        self.before = [(t, f) for t, f in self.before if t < time]

    def __call__(self, step: int, time: float, grid: Grid) -> bool:
        if not self.due(step):
            return False
        spark = grid.df.sparkSession
        for name, columns in self.fields.items():
            for kind in self.kinds:
                file = f"{name}_{step}.{ENDINGS[kind]}"
                write(grid.df, grid.mesh, f"{self.folder}/{file}", name, kind, columns)
                self.written.append(file)
                if kind.startswith("VTI"):
                    self.before.append((time, file))
        for name in self.fields:
            rows = "\n".join(f'<DataSet timestep="{t!r}" file="{f}"/>' for t, f in sorted(self.before) if f.startswith(f"{name}_"))
            if rows:
                streamed(spark, f"{self.folder}/{name}.pvd", [f'<?xml version="1.0"?>\n<VTKFile type="Collection" version="0.1">\n<Collection>\n{rows}\n</Collection>\n</VTKFile>\n'.encode()])
        return True


def by_settings(config: dict, folder: str, fields: dict[str, list[str]]) -> OutputWriter:
    """From settings: {interval, format}."""
    return OutputWriter(folder, fields, int(config.get("interval", 0)), config.get("format", "BINARY"))


Callback = Callable[[int, float, Grid], bool]
assert set(ENDINGS) == FORMATS
