"""Transfer between meshes over the same region: conservative and interpolating.

Overlaps are separable: a small table for each axis says which source
cells a target cell meets and how much. Source cells are spread by these
tables and summed by target, so one shuffle serves any ratio of meshes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import KEYS, Mesh


def same_region(a: Mesh, b: Mesh) -> None:
    for axis in range(max(a.dim, b.dim)):
        ends = [(m.origin[axis], m.origin[axis] + m.n[axis] * m.d[axis]) for m in (a, b)]
        size = max(abs(ends[0][1] - ends[0][0]), 1e-300)
        if any(abs(x - y) > 1e-12 * size for x, y in zip(*ends, strict=True)):
            raise ValidationError("MeshMap", f"the meshes cover different ranges of axis {axis}")


def _overlaps(src: Mesh, dst: Mesh, axis: int) -> Column:
    """Targets of a source cell along an axis, with lengths of overlap."""
    key, ds, dd = F.col(KEYS[axis]), src.d[axis], dst.d[axis]
    if axis >= max(src.dim, dst.dim):
        return F.array(F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("w")))
    lo, hi = key * F.lit(ds), (key + 1) * F.lit(ds)
    first = F.greatest(F.floor(lo / dd + F.lit(1e-9)), F.lit(0)).cast("int")
    last = F.least(F.ceil(hi / dd - F.lit(1e-9)) - 1, F.lit(dst.n[axis] - 1)).cast("int")
    each = F.transform(F.sequence(first, F.greatest(first, last)), lambda t: F.struct(t.alias("at"), (F.least(hi, (t + 1) * F.lit(dd)) - F.greatest(lo, t * F.lit(dd))).alias("w")))
    return F.filter(each, lambda e: e["w"] > 0)


def conserve(df: DataFrame, src: Mesh, dst: Mesh, names: list[str]) -> DataFrame:
    """Target means that keep every field's integral."""
    same_region(src, dst)
    wide = df.withColumn("__x", F.explode(_overlaps(src, dst, 0))).withColumn("__y", F.explode(_overlaps(src, dst, 1))).withColumn("__z", F.explode(_overlaps(src, dst, 2)))
    w = F.col("__x.w") * F.col("__y.w") * F.col("__z.w")
    size = 1.0
    for axis in range(max(src.dim, dst.dim)):
        size *= dst.d[axis]
    return wide.groupBy(*[F.col(f"__{a}.at").alias(k) for a, k in zip("xyz", KEYS, strict=True)]).agg(*[(F.sum(w * F.col(c)) / F.lit(size)).alias(c) for c in names])


def interpolate(df: DataFrame, src: Mesh, dst: Mesh, names: list[str]) -> DataFrame:
    """Values at target centres, linear along each axis, clamped at the rim.

    Target cells ask for their 2^dim source cells; requests and values meet
    in one join on the source key.
    """
    cells = dst.frame(df.sparkSession)
    corners = None
    for axis, key in enumerate(KEYS):
        n = src.n[axis]
        if n == 1:
            own = F.array(F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("w")))
        else:
            u = (dst.coordinate(axis) - F.lit(src.origin[axis])) / F.lit(src.d[axis]) - F.lit(0.5)
            c = F.least(F.greatest(F.floor(u), F.lit(0)), F.lit(n - 2)).cast("int")
            w = F.least(F.greatest(u - c, F.lit(0.0)), F.lit(1.0))
            own = F.array(F.struct(c.alias("at"), (F.lit(1.0) - w).alias("w")), F.struct((c + 1).alias("at"), w.alias("w")))
        cells = cells.withColumn(f"__{key}", F.explode(own))
        corners = F.col(f"__{key}.w") if corners is None else corners * F.col(f"__{key}.w")
    asked = cells.select(*[F.col(k).alias(f"to_{k}") for k in KEYS], *[F.col(f"__{k}.at").alias(k) for k in KEYS], corners.alias("__w"))
    got = asked.join(df.select(*KEYS, *names), list(KEYS))
    return got.groupBy(*[F.col(f"to_{k}").alias(k) for k in KEYS]).agg(*[F.sum(F.col("__w") * F.col(c)).alias(c) for c in names])


def ratio(fine: Mesh, coarse: Mesh) -> tuple[int, int, int]:
    """How many fine cells make a coarse one along each axis, for aligned meshes."""
    out = []
    for a in range(3):
        r = fine.n[a] / coarse.n[a]
        if not math.isclose(r, round(r)):
            raise ValidationError("MeshMap", "the meshes are not aligned")
        out.append(round(r))
    return tuple(out)
