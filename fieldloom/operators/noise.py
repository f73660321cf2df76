"""Additive noise from a digest of cell and seed: the same field for any partitioning, and in any engine that has MD5."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError

KINDS = ("GAUSSIAN", "UNIFORM", "LOG_NORMAL", "CAUCHY", "EXPONENTIAL", "BERNOULLI")


def uniform01(seed: int, draw: int = 0) -> Column:
    """In (0, 1], by cell."""
    digest = F.md5(F.concat_ws(":", "i", "j", "k", F.lit(seed), F.lit(draw)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 1) / F.lit(float(1 << 48))


def sample(kind: str, seed: int, a: float, b: float) -> Column:
    """GAUSSIAN (mean, sd), UNIFORM (low, high), LOG_NORMAL (mean, sd of the logarithm), CAUCHY (location, scale), EXPONENTIAL (shift, scale), BERNOULLI (probability of +b, else -b: a, b)."""
    u, v = uniform01(seed), uniform01(seed, 1)
    normal = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)
    if kind == "GAUSSIAN":
        return F.lit(a) + F.lit(b) * normal
    if kind == "UNIFORM":
        return F.lit(a) + F.lit(b - a) * u
    if kind == "LOG_NORMAL":
        return F.exp(F.lit(a) + F.lit(b) * normal)
    if kind == "CAUCHY":
        return F.lit(a) + F.lit(b) * F.tan(F.lit(math.pi) * (u - 0.5))
    if kind == "EXPONENTIAL":
        return F.lit(a) - F.lit(b) * F.ln(u)
    if kind == "BERNOULLI":
        return F.when(u <= a, F.lit(b)).otherwise(F.lit(-b))
    raise ConfigError("noise", f"unknown kind {kind}", f"one of {KINDS}")


def add(df: DataFrame, name: str, kind: str, seed: int, a: float, b: float) -> DataFrame:
    return df.withColumn(name, F.col(name) + sample(kind, seed, a, b))
