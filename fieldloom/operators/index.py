"""Integer fields: table lookups and adoption of neighbours' ids.

Ids below zero are unassigned. Lookup tables of checked size are broadcast,
larger ones joined by a shuffle.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import KEYS, Mesh

#: Rows of a lookup table up to which it is broadcast (16 bytes each).
BROADCAST_ROWS = 1 << 20


def gather(cells: DataFrame, ids: str, table: DataFrame, out: str, fallback: float = 0.0) -> DataFrame:
    """out = the table's value at the cell's id, or the fallback for unassigned and unknown ids; table: id, value."""
    table = table.select(F.col("id").alias("__id"), F.col("value").alias("__value"))
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = cells.join(F.broadcast(table) if small else table, (F.col(ids) == F.col("__id")) & (F.col(ids) >= 0), "left")
    return joined.withColumn(out, F.coalesce("__value", F.lit(float(fallback)))).drop("__id", "__value")


def gather_with(cells: DataFrame, ids: str, table: DataFrame, out: str, fn, aux: Column) -> DataFrame:  # noqa: ANN001
    """out = fn(id, table value or 0, aux) in every cell."""
    got = gather(cells, ids, table, "__got")
    return got.withColumn(out, fn(F.col(ids), F.col("__got"), aux)).drop("__got")


def adopt(cells: DataFrame, mesh: Mesh, ids: str, score: str, arrived: Column, least_source: int = 0) -> DataFrame:
    """Unassigned cells that have arrived take the id of the best-scored assigned neighbour.

    All neighbours count, diagonal ones too, within the mesh; among equal
    scores the first in z, y, x order wins. Every cell reads the old state.
    Assigned cells are sent to their neighbours, so the shuffle carries
    sources only, and maxima are taken before it.
    """
    reach = [(-1, 0, 1) if n > 1 else (0,) for n in mesh.n]
    moves = [(dx, dy, dz) for dz, dy, dx in product(reach[2], reach[1], reach[0]) if (dx, dy, dz) != (0, 0, 0)]
    # a source at offset o from the receiver is sent to the receiver at -o
    targets = F.array(*[F.struct(*[(F.col(k) - o).alias(k) for k, o in zip(KEYS, m, strict=True)], F.lit(-rank).alias("rank")) for rank, m in enumerate(moves)])
    inside = F.lit(True)
    for k, n in zip(KEYS, mesh.n, strict=True):
        inside = inside & F.col(f"t.{k}").between(0, n - 1)
    sent = cells.filter(F.col(ids) >= max(0, least_source)).select(F.explode(targets).alias("t"), F.col(ids).alias("__id"), F.col(score).alias("__s")).filter(inside)
    best = sent.groupBy(*[F.col(f"t.{k}").alias(k) for k in KEYS]).agg(F.max_by("__id", F.struct("__s", "t.rank")).alias("__new"))
    out = cells.join(best, list(KEYS), "left")
    return out.withColumn(ids, F.when((F.col(ids) < 0) & arrived & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(ids))).drop("__new")
