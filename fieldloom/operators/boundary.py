"""Boundary rules as maps of neighbour indices.

Ghost cells are never stored: a rule says which cell, or which value, a
neighbour index beyond the domain stands for. Rules of different axes
compose with x outermost, so a corner is the x rule applied to what the y
rule gave.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError, ValidationError, warn_once
from ..mesh import AXES, Mesh, Patch

#: cell(k): the value of the k-th cell from the wall, 0 the nearest; distance of the ghost cell, from 1; the ghost's value.
Ghost = Callable[[Callable[[int], Column], int], Column]


@dataclass(frozen=True)
class Rule:
    """One side of one axis: periodic, noflux, reflect, fixed, custom (a function, for halos up to width) or parts (a rule for each patch of the side)."""

    kind: str = "noflux"
    value: float = 0.0
    ghost: Ghost | None = None
    width: int = 1
    parts: tuple[tuple[Patch, Rule], ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in ("periodic", "noflux", "reflect", "fixed", "custom", "parts"):
            raise ConfigError("boundary", f"unknown rule {self.kind}", f"periodic, noflux, reflect, fixed or one of {sorted(_NAMED)}")
        if (self.kind == "custom") != (self.ghost is not None) or (self.kind == "parts") != bool(self.parts):
            raise ConfigError("boundary", "a custom rule needs a function, and a rule of parts its patches")
        if any(r.kind in ("periodic", "parts") for _, r in self.parts):
            raise ConfigError("boundary", "a part of a side can't be periodic or have parts")

    @property
    def mapped(self) -> bool:
        """Whether the rule is a map of indices or a value, which tiles need."""
        return self.kind not in ("custom", "parts")

    def wide(self, width: int) -> bool:
        """Whether halos of this width are certified."""
        if self.kind == "parts":
            return all(r.wide(width) for _, r in self.parts)
        return width <= 1 or self.kind in ("periodic", "reflect") or (self.kind == "custom" and width <= self.width)

    def homogeneous(self) -> Rule:
        """The rule that differences of two fields with this rule obey."""
        if self.kind == "parts":
            return Rule("parts", parts=tuple((p, r.homogeneous()) for p, r in self.parts))
        if self.kind == "custom":  # functions are affine in the cells: what they give for zeros is taken off
            ghost = self.ghost
            return Rule("custom", ghost=lambda cell, d: ghost(cell, d) - ghost(lambda k: F.lit(0.0), d), width=self.width)
        return Rule("fixed") if self.kind == "fixed" else self

    def index(self, at: int, n: int) -> int | None:
        """The cell that an index stands for, or None for the fixed value."""
        if 0 <= at < n:
            return at
        if self.kind == "periodic":
            return at % n
        if self.kind == "noflux":
            return min(max(at, 0), n - 1)
        if self.kind == "reflect":
            at = -at - 1 if at < 0 else 2 * n - at - 1
            return min(max(at, 0), n - 1)
        return None


PERIODIC, NOFLUX, REFLECT = Rule("periodic"), Rule("noflux"), Rule("reflect")


def fixed(value: float) -> Rule:
    return Rule("fixed", value)


def custom(ghost: Ghost, width: int = 1) -> Rule:
    return Rule("custom", ghost=ghost, width=width)


def wall_value(value: float) -> Rule:
    """The field has this value on the wall itself, between cells: ghosts mirror the inner cells about it."""
    return custom(lambda cell, d: 2 * value - cell(d - 1), 1 << 20)


def by_patch(rules: dict[str, Rule], mesh: Mesh) -> Rule:
    """Rules by the names of patches, which must be all those of one side."""
    patches = [mesh.patch(name) for name in rules]
    sides = {(p.axis, p.side) for p in patches}
    if len(sides) != 1 or len(patches) != sum((p.axis, p.side) in sides for p in mesh.patches):
        raise ConfigError("boundary", "rules by patch need all patches of one side")
    return Rule("parts", parts=tuple((p, rules[p.name]) for p in patches))


_NAMED: dict[str, Callable[[dict], Rule]] = {"wall": lambda spec: wall_value(float(spec.get("value", 0.0)))}


def register(name: str, make: Callable[[dict], Rule]) -> None:
    """A kind of rule that settings can name; make gets the side's settings."""
    if name.lower() in ("periodic", "noflux", "reflect", "fixed"):
        raise ConfigError("boundary", f"{name} is built in")
    _NAMED[name.lower()] = make


@dataclass(frozen=True)
class Boundary:
    """Rules for the low and high side of each axis."""

    x: tuple[Rule, Rule] = (NOFLUX, NOFLUX)
    y: tuple[Rule, Rule] = (NOFLUX, NOFLUX)
    z: tuple[Rule, Rule] = (NOFLUX, NOFLUX)

    def __post_init__(self) -> None:
        for name, pair in zip(AXES, (self.x, self.y, self.z), strict=True):
            if (pair[0].kind == "periodic") != (pair[1].kind == "periodic"):
                raise ConfigError("boundary", f"{name} is periodic on one side only")

    @classmethod
    def all(cls, rule: Rule) -> Boundary:
        return cls((rule, rule), (rule, rule), (rule, rule))

    def axis(self, a: int) -> tuple[Rule, Rule]:
        return (self.x, self.y, self.z)[a]

    def certify(self, width: int, dim: int) -> None:
        """Halos wider than one cell need periodic or mirrored sides."""
        if not all(r.wide(width) for a in range(dim) for r in self.axis(a)):
            raise ValidationError("boundary", "wide nonperiodic closure is not certified", "use periodic or reflect, a custom rule of that width, or a one-cell scheme")

    def homogeneous(self) -> Boundary:
        return Boundary(*(tuple(r.homogeneous() for r in self.axis(a)) for a in range(3)))


def from_config(config: dict, mesh: Mesh) -> Boundary:
    """Sides x_min, x_max, ...: a name, or {type, value, closure: constant | reflect}."""

    def rule(spec: str | dict) -> Rule:
        kind = spec if isinstance(spec, str) else spec.get("type", "noflux")
        kind = kind.lower()
        if kind == "noflux" and isinstance(spec, dict) and spec.get("closure") == "reflect":
            kind = "reflect"
        if kind in _NAMED:
            return _NAMED[kind](spec if isinstance(spec, dict) else {})
        return Rule(kind, float(spec.get("value", 0.0)) if isinstance(spec, dict) else 0.0)

    pairs = []
    for a in range(3):
        sides = [config.get(f"{AXES[a]}_{side}") for side in ("min", "max")]
        if a >= mesh.dim:
            pairs.append((NOFLUX, NOFLUX))
        elif sides.count(None) == 1:
            raise ConfigError("boundary", f"{AXES[a]} has a rule on one side only")
        elif sides[0] is None:
            warn_once(f"boundary {AXES[a]}", f"no rule for {AXES[a]}: noflux is used")
            pairs.append((NOFLUX, NOFLUX))
        else:
            pairs.append((rule(sides[0]), rule(sides[1])))
    return Boundary(*pairs)
