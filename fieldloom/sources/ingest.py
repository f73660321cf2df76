"""Relational tables as fields: residues of keys are cell indices, sums are values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import KEYS, Mesh
from ..operators.boundary import PERIODIC, Boundary
from ..plans.lower import Grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binned(df: DataFrame, mesh: Mesh, keys: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """Sums by cell, 0 in cells without rows: partial sums in each task, and the empty cells are a union, not a join."""
    own = df.select(*[keys.get(k, F.lit(0)).cast("int").alias(k) for k in KEYS], *[c.cast("double").alias(n) for n, c in sums.items()])
    empty = mesh.frame(df.sparkSession).select(*KEYS, *[F.lit(0.0).alias(n) for n in sums])
    return own.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in sums]).unionByName(empty).groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in sums])


def derived(df: DataFrame) -> DataFrame:
    """Exact fields from the integer sums v and w: p and q in [0, 1], velocities ux and uy, ids from -1 to 4."""
    whole = lambda c: F.col(c).cast("long")
    return df.select(
        *KEYS, "v", "w",
        (whole("v") % 17 / F.lit(16.0)).alias("p"), (whole("w") % 13 / F.lit(16.0)).alias("q"),
        (whole("v") % 5 - 2).cast("double").alias("ux"), (whole("w") % 5 - 2).cast("double").alias("uy"),
        F.when(whole("v") % 7 == 0, whole("v") % 5).otherwise(-1).cast("int").alias("id"),
    )


def lineitem_grid(spark: SparkSession, sf_dir: str, boundary: Boundary | None = None, n: tuple[int, int] = (32, 24), d: tuple[float, float] = (1.0, 1.0)) -> Grid:
    """Quantities and counts of line items by residues of part and order key."""
    mesh = Mesh.uniform(*n, d=d)
    keys = {"i": F.col("l_partkey") % n[0], "j": F.col("l_orderkey") % n[1]}
    df = derived(binned(table(spark, sf_dir, "lineitem"), mesh, keys, {"v": F.col("l_quantity"), "w": F.lit(1)}))
    return Grid(df, mesh, {}, boundary or Boundary.all(PERIODIC))


def lineitem_box(spark: SparkSession, sf_dir: str, boundary: Boundary | None = None, n: tuple[int, int, int] = (8, 6, 4)) -> Grid:
    """As lineitem_grid in 3D, with the supplier key along z."""
    mesh = Mesh.uniform(*n)
    keys = {"i": F.col("l_partkey") % n[0], "j": F.col("l_orderkey") % n[1], "k": F.col("l_suppkey") % n[2]}
    df = derived(binned(table(spark, sf_dir, "lineitem"), mesh, keys, {"v": F.col("l_quantity"), "w": F.lit(1)}))
    return Grid(df, mesh, {}, boundary or Boundary.all(PERIODIC))


def event_line(spark: SparkSession, sf_dir: str, n: int = 240) -> Grid:
    """Number of events by hour of the period, folded into n cells."""
    mesh = Mesh.uniform(n)
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) % n
    df = binned(table(spark, sf_dir, "events"), mesh, {"i": hour}, {"v": F.lit(1), "w": F.col("user_id") % 7})
    return Grid(derived(df), mesh, {}, Boundary())
