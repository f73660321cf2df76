"""Plane-strain elasticity with an eigenstrain, solved mode by mode in Fourier space.

The transform is separable: rows along x are transformed in groups of one
grid line each, then lines along y of the result, so no task holds the
grid. Each mode is then a two-by-two solve in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import Mesh


def _lines(df: DataFrame, line: str, along: str, columns: list[str], inverse: bool) -> DataFrame:
    """Transform complex columns (pairs name_re, name_im) along one axis, a group for each line."""
    parts = [f"{c}_{p}" for c in columns for p in ("re", "im")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(along)
        out = {line: rows[line].to_numpy(), along: rows[along].to_numpy()}
        for c in columns:
            value = rows[f"{c}_re"].to_numpy() + 1j * rows[f"{c}_im"].to_numpy()
            value = np.fft.ifft(value) if inverse else np.fft.fft(value)
            out[f"{c}_re"], out[f"{c}_im"] = value.real, value.imag
        return pd.DataFrame(out)

    return df.select(line, along, *parts).groupBy(line).applyInPandas(run, ", ".join([f"{line} int", f"{along} int", *(f"{p} double" for p in parts)]))


def fft2(df: DataFrame, names: list[str]) -> DataFrame:
    """Two-dimensional transforms of real columns: i, j count modes; columns name_re, name_im."""
    complex_ = df.select("i", "j", *[c for n in names for c in (F.col(n).cast("double").alias(f"{n}_re"), F.lit(0.0).alias(f"{n}_im"))])
    return _lines(_lines(complex_, "j", "i", names, False), "i", "j", names, False)


def ifft2(df: DataFrame, names: list[str]) -> DataFrame:
    """Back to real columns."""
    back = _lines(_lines(df, "j", "i", names, True), "i", "j", names, True)
    return back.select("i", "j", F.lit(0).alias("k"), *[F.col(f"{n}_re").alias(n) for n in names])


@dataclass(frozen=True)
class Elasticity:
    """Cubic stiffness and a dilatational eigenstrain given as a field; the mean strain is that of a stress-free cell, or zero."""

    c11: float
    c12: float
    c44: float
    clamped: bool = False

    def __post_init__(self) -> None:
        if self.c44 <= 0 or self.c11 <= abs(self.c12):
            raise ValidationError("Elasticity", "the stiffness is not positive definite")

    def strains(self, df: DataFrame, mesh: Mesh, eigen: str) -> DataFrame:
        """e11, e22, e12 of every cell."""
        if mesh.dim != 2:
            raise ValidationError("Elasticity", "needs a 2D mesh")
        modes = fft2(df, [eigen])
        wave = lambda key, axis: (F.when(F.col(key) * 2 > mesh.n[axis], F.col(key) - mesh.n[axis]).otherwise(F.col(key))).cast("double") * F.lit(2 * np.pi / (mesh.n[axis] * mesh.d[axis]))
        kx, ky = wave("i", 0), wave("j", 1)
        a, b, c = self.c11 * kx * kx + self.c44 * ky * ky, (self.c12 + self.c44) * kx * ky, self.c11 * ky * ky + self.c44 * kx * kx
        det, press = a * c - b * b, self.c11 + self.c12
        zero = (F.col("i") == 0) & (F.col("j") == 0)
        safe = F.when(zero, F.lit(1.0)).otherwise(det)
        gx, gy = press * (c * kx - b * ky) / safe, press * (a * ky - b * kx) / safe
        mean = F.lit(0.0 if self.clamped else 1.0)
        out = []
        for part in ("re", "im"):
            e = F.col(f"{eigen}_{part}")
            out += [
                F.when(zero, mean * e).otherwise(kx * gx * e).alias(f"e11_{part}"),
                F.when(zero, mean * e).otherwise(ky * gy * e).alias(f"e22_{part}"),
                F.when(zero, F.lit(0.0)).otherwise(0.5 * (kx * gy + ky * gx) * e).alias(f"e12_{part}"),
            ]
        return ifft2(modes.select("i", "j", *out), ["e11", "e22", "e12"])

    def energy(self, df: DataFrame, mesh: Mesh, eigen: str) -> DataFrame:
        """Energy density of every cell."""
        both = self.strains(df, mesh, eigen).join(df.select("i", "j", "k", eigen), ["i", "j", "k"])
        d11, d22, d12 = F.col("e11") - F.col(eigen), F.col("e22") - F.col(eigen), F.col("e12")
        return both.withColumn("energy", 0.5 * (self.c11 * (d11 * d11 + d22 * d22) + 2 * self.c12 * d11 * d22 + 4 * self.c44 * d12 * d12))
