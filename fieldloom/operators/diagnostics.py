"""Where a field crosses a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NumericsError
from ..mesh import KEYS, Mesh


def interface_position(df: DataFrame, mesh: Mesh, name: str, axis: int = 0, level: float = 0.0, at: dict[str, int] | None = None, from_high: bool = True) -> DataFrame:
    """One row, position, of the first crossing of the level along a line of cells; no row if there is none.

    at: the other indices of the line (default 0). The crossing is linear
    between two centres; scanning begins at the high end unless told else.
    """
    key, line = KEYS[axis], df
    for a, k in enumerate(KEYS):
        if a != axis:
            line = line.filter(F.col(k) == (at or {}).get(k, 0))
    pair = line.select(key, F.col(name).alias("a"), F.lead(name).over(Window.partitionBy(*[k for k in KEYS if k != key]).orderBy(key)).alias("b"))
    hit = pair.filter(F.col("b").isNotNull() & ((F.col("a") - level) * (F.col("b") - level) <= 0) & (F.col("a") != F.col("b")))
    place = mesh.coordinate(axis) + (F.lit(level) - F.col("a")) / (F.col("b") - F.col("a")) * F.lit(mesh.d[axis])
    return hit.select(key, place.alias("position")).orderBy(F.desc(key) if from_high else F.asc(key)).limit(1).select("position")


def position(df: DataFrame, mesh: Mesh, name: str, **how: object) -> float:
    row = interface_position(df, mesh, name, **how).first()
    if row is None:
        raise NumericsError("interfacePosition", f"{name} does not cross the level")
    return row["position"]
