"""Projection of phase fractions on the Gibbs simplex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError

MOST = 32


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """Clip negative fractions, spread the deficit over those that are left, and repeat; if all are clipped the first becomes 1.

    A fraction of exactly zero counts among those that share but takes
    nothing, so with zeros the sum isn't kept.
    """
    if not 0 < len(names) <= MOST:
        raise ValidationError("simplex", f"needs 1 to {MOST} fractions")
    for k in range(len(names)):
        # state as one array, so that each pass is one expression
        v = F.col("__v")
        df = df.withColumn("__v", F.array(*names)) if k == 0 else df
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
        df = df.withColumns({"__d": total - 1, "__n": F.size(F.filter(v, lambda x: x >= 0)), "__neg": F.exists(v, lambda x: x < 0)})
        share = F.when(F.col("__n") > 0, F.col("__d") / F.when(F.col("__n") > 0, F.col("__n")).otherwise(1))
        moved = F.transform(v, lambda x: F.when(x > 0, x - share).otherwise(F.lit(0.0)))
        df = df.withColumn("__v", F.when(F.col("__neg"), moved).otherwise(v))
    clipped = F.forall("__v", lambda x: x <= 0)
    final = F.transform("__v", lambda x, k: F.when(clipped, F.when(k == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.greatest(x, F.lit(0.0))))
    df = df.withColumn("__v", final)
    return df.withColumns({c: F.element_at("__v", k + 1) for k, c in enumerate(names)}).drop("__v", "__d", "__n", "__neg")
