"""Structured meshes: a key domain (i, j, k) with spacing and origin."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError, ValidationError

AXES, KEYS, COORDINATES = ("x", "y", "z"), ("i", "j", "k"), ("CARTESIAN", "CYLINDRICAL", "SPHERICAL")


@dataclass(frozen=True)
class Patch:
    """A named half-open box of cells on one face of a mesh, one cell thick along the normal."""

    name: str
    axis: int
    side: int  # -1: low, 1: high
    lo: tuple[int, int, int]
    hi: tuple[int, int, int]

    def within(self) -> Column:
        """Whether a cell belongs to the patch."""
        out = F.lit(True)
        for k, a, b in zip(KEYS, self.lo, self.hi, strict=True):
            out = out & (F.col(k) >= a) & (F.col(k) < b)
        return out

    @property
    def cells(self) -> int:
        return (self.hi[0] - self.lo[0]) * (self.hi[1] - self.lo[1]) * (self.hi[2] - self.lo[2])


@dataclass(frozen=True)
class Mesh:
    """n cells, spacing d and origin along each axis; unused axes have one cell."""

    n: tuple[int, int, int]
    d: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    coordinates: str = "CARTESIAN"
    patches: tuple[Patch, ...] = field(default=())

    def __post_init__(self) -> None:
        if len(self.n) != 3 or min(self.n) < 1:
            raise ValidationError("Mesh", f"cell counts must be positive: {self.n}")
        if min(self.d) <= 0:
            raise ValidationError("Mesh", f"spacings must be positive: {self.d}")
        if self.coordinates not in COORDINATES:
            raise ConfigError("Mesh", f"unknown coordinate system {self.coordinates}", f"one of {COORDINATES}")
        if not self.patches:
            object.__setattr__(self, "patches", self._sides())
        self._check_tiling()

    @classmethod
    def uniform(cls, *n: int, d: float | tuple = 1.0, origin: float | tuple = 0.0, coordinates: str = "CARTESIAN") -> Mesh:
        """A mesh of one to three axes."""
        full = lambda x, rest: (*(x if isinstance(x, tuple) else (x,) * len(n)), *(rest,) * (3 - len(n)))
        return cls((*n, *(1,) * (3 - len(n))), full(d, 1.0), full(origin, 0.0), coordinates)

    @property
    def dim(self) -> int:
        return max([1, *(a + 1 for a in range(3) if self.n[a] > 1)])

    @property
    def cells(self) -> int:
        return self.n[0] * self.n[1] * self.n[2]

    @property
    def volume(self) -> float:
        """Of one cell."""
        out = 1.0
        for a in range(self.dim):
            out *= self.d[a]
        return out

    def _sides(self) -> tuple[Patch, ...]:
        out = []
        for a in range(self.dim):
            for side, name in ((-1, "min"), (1, "max")):
                lo, hi = [0, 0, 0], list(self.n)
                lo[a], hi[a] = (0, 1) if side < 0 else (self.n[a] - 1, self.n[a])
                out.append(Patch(AXES[a] + name, a, side, tuple(lo), tuple(hi)))
        return tuple(out)

    def _check_tiling(self) -> None:
        """Patches of one face must cover it exactly, without overlap."""
        for a in range(self.dim):
            for side in (-1, 1):
                own = [p for p in self.patches if (p.axis, p.side) == (a, side)]
                face = self.cells // self.n[a]
                if not own:
                    continue
                for p in own:
                    if any(x < 0 or y > m or x >= y for x, y, m in zip(p.lo, p.hi, self.n, strict=True)):
                        raise ValidationError("Mesh", f"patch {p.name} leaves the mesh")
                for k, p in enumerate(own):
                    for q in own[k + 1 :]:
                        if all(max(a1, a2) < min(b1, b2) for a1, b1, a2, b2 in zip(p.lo, p.hi, q.lo, q.hi, strict=True)):
                            raise ValidationError("Mesh", f"patches {p.name} and {q.name} overlap")
                if sum(p.cells for p in own) != face:
                    raise ValidationError("Mesh", f"patches do not tile the {AXES[a]} face")

    def patch(self, name: str) -> Patch:
        for p in self.patches:
            if p.name == name:
                return p
        raise ConfigError("Mesh", f"no patch {name}", f"one of {[p.name for p in self.patches]}")

    def cartesian(self, where: str) -> None:
        if self.coordinates != "CARTESIAN":
            raise ValidationError(where, f"needs CARTESIAN coordinates, not {self.coordinates}")

    def coordinate(self, axis: int, face: bool = False) -> Column:
        """Position of cell centres, or of faces, along an axis; 0 along axes that the mesh doesn't use."""
        if axis >= self.dim:
            return F.lit(0.0)
        at = F.col(KEYS[axis]) + (F.lit(0.0) if face else F.lit(0.5))
        return F.lit(self.origin[axis]) + at * F.lit(self.d[axis])

    def frame(self, spark: SparkSession, face: int | None = None) -> DataFrame:
        """All cells, or all faces normal to an axis, as rows (i, j, k), made in parallel."""
        n = [m + (a == face) for a, m in enumerate(self.n)]
        at = F.col("id")
        return spark.range(n[0] * n[1] * n[2]).select(
            (at % n[0]).cast("int").alias("i"), (F.floor(at / n[0]) % n[1]).cast("int").alias("j"), F.floor(at / (n[0] * n[1])).cast("int").alias("k")
        )

    def to_text(self) -> str:
        out = [f"dim {self.dim}", f"coordSys {self.coordinates}"]
        for a in range(self.dim):
            out.append(f"n{AXES[a]} {self.n[a]} d{AXES[a]} {self.d[a]!r} {AXES[a]}0 {self.origin[a]!r}")
        return "\n".join(out) + "\n"

    @classmethod
    def from_text(cls, text: str) -> Mesh:
        """Keys and values in any order; # begins a comment."""
        words = re.sub(r"#[^\n]*", "", text).split()
        if len(words) % 2:
            raise ConfigError("Mesh", "a key has no value")
        got = dict(zip(words[::2], words[1::2], strict=True))
        try:
            dim = int(got["dim"])
            axes = AXES[:dim]
            n, d = [int(got[f"n{a}"]) for a in axes], [float(got.get(f"d{a}", 1.0)) for a in axes]
            origin = [float(got.get(f"{a}0", 0.0)) for a in axes]
        except (KeyError, ValueError) as e:
            raise ConfigError("Mesh", f"missing or bad key {e}") from e
        return cls.uniform(*n, d=tuple(d), origin=tuple(origin), coordinates=got.get("coordSys", "CARTESIAN").upper())
