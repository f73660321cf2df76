"""Domain masks: a 1 or 0 column named like any field, with no active cell beyond the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import KEYS
from ..plans.expr import Expr, const, field, shift, where
from ..plans.lower import Grid
from .boundary import Boundary, fixed
from .faces import face_table
from .stencils import step


def build(grid: Grid, inside: Expr, name: str = "mask") -> Grid:
    """Cells whose centre satisfies the predicate; an empty selection is an error."""
    made = grid.assign({name: where(inside, 1.0, 0.0)})
    if not made.df.filter(F.col(name) > 0).limit(1).count():
        raise ValidationError("DomainMask", "no cell is inside")
    return Grid(made.df, made.mesh, {**made.boundaries, name: Boundary.all(fixed(0.0))}, made.default, made.line)


def masked_sum(df: DataFrame, name: str, mask: str = "mask", out: str = "total") -> DataFrame:
    return df.filter(F.col(mask) > 0).agg(F.sum(name).alias(out))


def mirror_closure(grid: Grid, name: str, mask: str = "mask") -> Grid:
    """Inactive cells take the mean of their active face neighbours, if there are any."""
    f, m, total, count = field(name), field(mask), const(0), const(0)
    for axis in range(grid.mesh.dim):
        for by in (-1, 1):
            near = shift(m, step(axis, by))
            total, count = total + where(near > 0, shift(f, step(axis, by)), 0.0), count + near
    return grid.assign({name: where(m > 0, f, where(count > 0, total / where(count > 0, count, 1.0), f))})


def mask_faces(grid: Grid, faces: DataFrame, name: str, axis: int, mask: str = "mask") -> DataFrame:
    """Face values, zero unless both cells are active; faces on the rim are zero."""
    m = field(mask)
    open_ = face_table(grid, axis, {"__open": lambda n: shift(m, step(axis, n(-1))) * shift(m, step(axis, n(0)))})
    return faces.join(open_, list(KEYS)).withColumn(name, F.when(F.col("__open") > 0, F.col(name)).otherwise(F.lit(0.0))).drop("__open")
