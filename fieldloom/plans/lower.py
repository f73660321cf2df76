"""Lowering of expressions to columns.

A field is a column of one table keyed (i, j, k). Samples become lag and
lead columns: one window an axis serves all fields and offsets, first z,
then y over the z-shifted columns, then x, which composes boundary rules
with x outermost. The table is shuffled once an axis that is really used.

A window's unit is a grid line. Lines longer than `line` cells are cut in
blocks: cells near a cut are also sent to the neighbouring block, so no
task needs a whole line and the cost grows with the cut surface only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..mesh import KEYS, Mesh
from ..operators.boundary import Boundary, Rule
from .expr import Expr, samples

#: Cells of a line up to which one window takes the whole line.
LINE = 1 << 20

_UNARY: dict[str, Callable] = {"sin": F.sin, "cos": F.cos, "tanh": F.tanh, "exp": F.exp, "log": F.ln, "sqrt": F.sqrt, "abs": F.abs}
_BINARY: dict[str, Callable] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "atan2": F.atan2, "hypot": F.hypot,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "min": lambda a, b: F.when(a < b, a).otherwise(b), "max": lambda a, b: F.when(a > b, a).otherwise(b),
}
_PREDICATES = {"lt", "le", "gt", "ge", "and", "or"}


def column(e: Expr, mesh: Mesh, params: dict[str, float], sample: Callable[[str, tuple[int, int, int]], Column], seen: dict | None = None) -> Column:
    """The expression as a column; predicates count as 1 and 0 in arithmetic."""
    seen = {} if seen is None else seen
    if e in seen:
        return seen[e]
    go = lambda a: column(a, mesh, params, sample, seen)
    num = lambda a: go(a).cast("double") if a.op in _PREDICATES else go(a)
    truth = lambda a: go(a) if a.op in _PREDICATES else go(a) != 0
    if e.op == "const":
        out = F.lit(e.payload)
    elif e.op == "param":
        if e.payload not in params:
            raise ValidationError("lower", f"no value for parameter {e.payload}")
        out = F.lit(float(params[e.payload]))
    elif e.op == "coord":
        axis, move = e.payload
        out = mesh.coordinate(axis) + F.lit(move * mesh.d[axis])
    elif e.op == "sample":
        out = sample(*e.payload)
    elif e.op == "neg":
        out = -num(e.args[0])
    elif e.op == "pow":
        out = num(e.args[0]) * num(e.args[0]) if e.payload == 2 else F.pow(num(e.args[0]), F.lit(e.payload))
    elif e.op == "where":
        out = F.when(truth(e.args[0]), num(e.args[1])).otherwise(num(e.args[2]))
    elif e.op == "and":
        out = truth(e.args[0]) & truth(e.args[1])
    elif e.op == "or":
        out = truth(e.args[0]) | truth(e.args[1])
    elif e.op in _UNARY:
        out = _UNARY[e.op](num(e.args[0]))
    elif e.op in _BINARY:
        out = _BINARY[e.op](num(e.args[0]), num(e.args[1]))
    else:
        raise ValidationError("lower", f"{e.op} has no scheme yet", "bind schemes first")
    seen[e] = out
    return out


@dataclass(frozen=True)
class Grid:
    """Fields on a mesh: a table with i, j, k and one double column a field, and each field's boundary."""

    df: DataFrame
    mesh: Mesh
    boundaries: dict[str, Boundary]
    default: Boundary = Boundary()
    line: int = LINE

    def boundary(self, name: str) -> Boundary:
        return self.boundaries.get(name, self.default)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in KEYS]

    def with_df(self, df: DataFrame) -> Grid:
        return replace(self, df=df)

    def assign(self, outputs: dict[str, Expr], params: dict[str, float] | None = None) -> Grid:
        """New or replaced columns, all computed from the present ones."""
        wide, name = neighbours(self, set().union(*[samples(e) for e in outputs.values()]) if outputs else set())
        sample = lambda f, o: F.col(name(f, o))
        seen: dict = {}
        new = {k: column(e, self.mesh, params or {}, sample, seen).cast("double").alias(k) for k, e in outputs.items()}
        return self.with_df(wide.select(*KEYS, *[new.pop(c, F.col(c)) for c in self.fields], *new.values()))

    def select(self, outputs: dict[str, Expr], params: dict[str, float] | None = None) -> DataFrame:
        return self.assign(outputs, params).df.select(*KEYS, *outputs)


def neighbours(grid: Grid, wanted: set[tuple[str, tuple[int, int, int]]]) -> tuple[DataFrame, Callable[[str, tuple[int, int, int]], str]]:
    """The grid's table with a column for every wanted sample, and the columns' names."""
    mesh, df = grid.mesh, grid.df
    flat = lambda o: tuple(x if mesh.n[a] > 1 or a < mesh.dim else 0 for a, x in enumerate(o))
    wanted = {(f, flat(o)) for f, o in wanted}
    for f, _ in wanted:
        if f not in df.columns:
            raise ValidationError("neighbours", f"no field {f}", f"one of {grid.fields}")

    def name(f: str, o: tuple[int, int, int]) -> str:
        o = flat(o)
        return f if o == (0, 0, 0) else f"__{f}_" + "_".join(map(str, o)).replace("-", "m")

    for axis in (2, 1, 0):
        done = {}
        for f, o in sorted(wanted):
            here = tuple(x if a >= axis else 0 for a, x in enumerate(o))
            before = tuple(x if a > axis else 0 for a, x in enumerate(o))
            if o[axis] and here not in (None,) and name(f, here) not in done:
                done[name(f, here)] = (name(f, before), o[axis], tuple(_placed(r, mesh, axis, o) for r in grid.boundary(f).axis(axis)))
        if done:
            df = _shifted(df, mesh, axis, done, grid.line)
    return df, name


def _placed(rule: Rule, mesh: Mesh, axis: int, offset: tuple[int, int, int]) -> Rule | list[tuple[Column, Rule]]:
    """A rule, or the rules of a side's parts with the rows whose ghost cell lies in each."""
    if rule.kind != "parts":
        return rule
    out = []
    for patch, own in rule.parts:
        inside = F.lit(True)
        for a, (lo, hi) in enumerate(zip(patch.lo, patch.hi, strict=True)):
            if a != axis:
                at = F.least(F.greatest(F.col(KEYS[a]) + offset[a], F.lit(0)), F.lit(mesh.n[a] - 1))
                inside = inside & (at >= lo) & (at < hi)
        out.append((inside, own))
    return out


def _moved(value: Column, by: int, window: Window) -> Column:
    return value if by == 0 else F.lead(value, by).over(window) if by > 0 else F.lag(value, -by).over(window)


def _shifted(df: DataFrame, mesh: Mesh, axis: int, wants: dict[str, tuple[str, int, tuple]], line: int) -> DataFrame:
    n, key = mesh.n[axis], KEYS[axis]
    others = [k for a, k in enumerate(KEYS) if a != axis and mesh.n[a] > 1]
    width = max(abs(by) for _, by, _ in wants.values())
    blocks = n > max(line, 2 * width)
    if not blocks:
        window = Window.partitionBy(*others).orderBy(key) if others else Window.partitionBy(F.lit(0)).orderBy(key)
        return df.withColumns({new: _neighbour(old, by, rules, n, key, window, wrap=True) for new, (old, by, rules) in wants.items()})
    periodic = any(isinstance(r[0], Rule) and r[0].kind == "periodic" for _, _, r in wants.values())
    last = (n - 1) // line
    place, block = F.col(key), F.floor(F.col(key) / line).cast("int")
    copy = lambda b, p: F.struct(b.cast("int").alias("b"), p.cast("int").alias("p"))
    inside = place - block * line
    copies = [F.array(copy(block, place)), F.when((inside < width) & (block > 0), F.array(copy(block - 1, place))), F.when((inside >= line - width) & (block < last), F.array(copy(block + 1, place)))]
    if periodic:
        copies += [F.when(place < width, F.array(copy(F.lit(last), place + n))), F.when(place >= n - width, F.array(copy(F.lit(0), place - n)))]
    spread = df.withColumn("__c", F.explode(F.flatten(F.array_compact(F.array(*copies)))))
    window = Window.partitionBy("__c.b", *others).orderBy("__c.p")
    out = spread.withColumns({new: _neighbour(old, by, rules, n, key, window, wrap=False) for new, (old, by, rules) in wants.items()})
    return out.filter((F.col("__c.p") == F.col(key)) & (F.col("__c.b") == F.floor(F.col(key) / line))).drop("__c")


def _neighbour(old: str, by: int, rules: tuple, n: int, key: str, window: Window, wrap: bool) -> Column:
    """The value `by` cells on; near an edge the rule's index, which is a shift of its own for each distance."""
    value, rule = F.col(old), rules[by > 0]
    inner = _moved(value, by, window)
    if isinstance(rule, list):
        out = F.when(F.lit(False), value)
        for inside, own in rule:
            out = out.when(inside, _neighbour(old, by, (own, own), n, key, window, wrap))
        return out.otherwise(inner)
    if rule.kind == "periodic":
        if not wrap:
            return inner
        by = by % n if by > 0 else -(-by % n)
        return value if by == 0 else F.coalesce(_moved(value, by, window), _moved(value, by - n if by > 0 else by + n, window))
    out = F.when((F.col(key) + by >= 0) & (F.col(key) + by < n), inner)
    for far in range(min(abs(by), n)):
        at = n - 1 - far if by > 0 else far
        if rule.kind == "custom":
            cell = lambda c, far=far: _moved(value, far - min(c, n - 1) if by > 0 else min(c, n - 1) - far, window)
            out = out.when(F.col(key) == at, rule.ghost(cell, abs(by) - far))
            continue
        to = rule.index(at + by, n)
        out = out.when(F.col(key) == at, F.lit(rule.value) if to is None else _moved(value, to - at, window))
    return out
