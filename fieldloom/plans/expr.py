"""Symbolic expressions over fields.

Nodes are immutable and shared: building the same expression twice gives
the same object. Differential operators stay symbolic until a scheme is
bound; then everything is arithmetic over samples, values of fields at grid
offsets, which lower to columns (lower.py) or to arrays (arrays.py).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from ..errors import NumericsError, ValidationError

Number = int | float


class Expr:
    """op with arguments; payload holds names, values and offsets."""

    __slots__ = ("op", "args", "payload", "_hash")
    _pool: dict = {}

    def __new__(cls, op: str, args: tuple = (), payload: object = None) -> Expr:
        key = (op, tuple(map(id, args)), payload, type(payload))
        if key not in cls._pool:
            self = object.__new__(cls)
            self.op, self.args, self.payload = op, args, payload
            cls._pool[key] = self
        return cls._pool[key]

    def __reduce__(self) -> tuple:
        return Expr, (self.op, self.args, self.payload)

    def __add__(self, o: Expr | Number) -> Expr:
        return add(self, wrap(o))

    def __radd__(self, o: Number) -> Expr:
        return add(wrap(o), self)

    def __sub__(self, o: Expr | Number) -> Expr:
        return sub(self, wrap(o))

    def __rsub__(self, o: Number) -> Expr:
        return sub(wrap(o), self)

    def __mul__(self, o: Expr | Number) -> Expr:
        return mul(self, wrap(o))

    def __rmul__(self, o: Number) -> Expr:
        return mul(wrap(o), self)

    def __truediv__(self, o: Expr | Number) -> Expr:
        return div(self, wrap(o))

    def __rtruediv__(self, o: Number) -> Expr:
        return div(wrap(o), self)

    def __neg__(self) -> Expr:
        return neg(self)

    def __pow__(self, k: Number) -> Expr:
        return power(self, k)

    def __lt__(self, o: Expr | Number) -> Expr:
        return _compare("lt", self, wrap(o))

    def __le__(self, o: Expr | Number) -> Expr:
        return _compare("le", self, wrap(o))

    def __gt__(self, o: Expr | Number) -> Expr:
        return _compare("gt", self, wrap(o))

    def __ge__(self, o: Expr | Number) -> Expr:
        return _compare("ge", self, wrap(o))

    def __and__(self, o: Expr) -> Expr:
        return Expr("and", (self, wrap(o)))

    def __or__(self, o: Expr) -> Expr:
        return Expr("or", (self, wrap(o)))

    def __repr__(self) -> str:
        inner = ", ".join([*map(repr, self.args), *([repr(self.payload)] if self.payload is not None else [])])
        return f"{self.op}({inner})"


def wrap(x: Expr | Number) -> Expr:
    return x if isinstance(x, Expr) else const(x)


def const(x: Number) -> Expr:
    return Expr("const", (), float(x))


def field(name: str) -> Expr:
    return Expr("sample", (), (name, (0, 0, 0)))


def param(name: str) -> Expr:
    return Expr("param", (), name)


def coord(axis: int) -> Expr:
    return Expr("coord", (), (axis, 0))


def at(name: str, offset: tuple[int, int, int]) -> Expr:
    return Expr("sample", (), (name, offset))


def is_const(e: Expr, value: float | None = None) -> bool:
    return e.op == "const" and (value is None or e.payload == value)


def add(a: Expr, b: Expr) -> Expr:
    if is_const(a) and is_const(b):
        return const(a.payload + b.payload)
    return b if is_const(a, 0.0) else a if is_const(b, 0.0) else Expr("add", (a, b))


def sub(a: Expr, b: Expr) -> Expr:
    if a is b:
        return const(0)
    if is_const(a) and is_const(b):
        return const(a.payload - b.payload)
    return a if is_const(b, 0.0) else neg(b) if is_const(a, 0.0) else Expr("sub", (a, b))


def mul(a: Expr, b: Expr) -> Expr:
    if is_const(a) and is_const(b):
        return const(a.payload * b.payload)
    if is_const(a, 0.0) or is_const(b, 0.0):
        return const(0)
    if is_const(a) and b.op == "mul" and is_const(b.args[0]):  # a scale of a scale is one scale
        return mul(const(a.payload * b.args[0].payload), b.args[1])
    return b if is_const(a, 1.0) else a if is_const(b, 1.0) else Expr("mul", (a, b))


def div(a: Expr, b: Expr) -> Expr:
    if is_const(b, 0.0):
        raise NumericsError("Expr", "division by a constant zero")
    if is_const(a) and is_const(b):
        return const(a.payload / b.payload)
    return const(0) if is_const(a, 0.0) else a if is_const(b, 1.0) else Expr("div", (a, b))


def neg(a: Expr) -> Expr:
    return const(-a.payload) if is_const(a) else a.args[0] if a.op == "neg" else Expr("neg", (a,))


def power(a: Expr, k: Number) -> Expr:
    if k == 0:
        return const(1)
    return a if k == 1 else const(a.payload**k) if is_const(a) else Expr("pow", (a,), float(k))


_FOLD = {"sin": math.sin, "cos": math.cos, "tanh": math.tanh, "exp": math.exp, "log": math.log, "sqrt": math.sqrt, "abs": abs}


def call(name: str, a: Expr | Number) -> Expr:
    """sin, cos, tanh, exp, log, sqrt or abs."""
    a = wrap(a)
    return const(_FOLD[name](a.payload)) if is_const(a) else Expr(name, (a,))


def atan2(y: Expr | Number, x: Expr | Number) -> Expr:
    return Expr("atan2", (wrap(y), wrap(x)))


def hypot(x: Expr | Number, y: Expr | Number) -> Expr:
    return Expr("hypot", (wrap(x), wrap(y)))


def minimum(a: Expr | Number, b: Expr | Number) -> Expr:
    return Expr("min", (wrap(a), wrap(b)))


def maximum(a: Expr | Number, b: Expr | Number) -> Expr:
    return Expr("max", (wrap(a), wrap(b)))


def _compare(op: str, a: Expr, b: Expr) -> Expr:
    return Expr(op, (a, b))


def where(condition: Expr | bool, a: Expr | Number, b: Expr | Number) -> Expr:
    a, b = wrap(a), wrap(b)
    if isinstance(condition, bool):
        return a if condition else b
    if is_const(condition):
        return a if condition.payload != 0 else b
    return a if a is b else Expr("where", (condition, a, b))


# differential operators, bound to schemes later; key: how the scheme table names the operand


def derivative(e: Expr, axis: int, order: int = 1) -> Expr:
    if order > 2:
        raise ValidationError("Expr", f"derivatives of order {order} have no scheme")
    return Expr("d", (e,), (axis,) * order)


def mixed(e: Expr) -> Expr:
    return Expr("d", (e,), (0, 1))


def lap(e: Expr) -> Expr:
    return Expr("lap", (e,))


def grad_sq(e: Expr) -> Expr:
    return Expr("grad_sq", (e,))


def advect(velocity: Iterable[Expr], e: Expr) -> Expr:
    return Expr("advect", (*velocity, e))


def div_grad(coefficient: Expr, e: Expr) -> Expr:
    return Expr("div_grad", (coefficient, e))


def div_normal(coefficient: Expr, e: Expr, floor: float = 0.0) -> Expr:
    return Expr("div_normal", (coefficient, e), floor)


DIFFERENTIAL = {"d", "lap", "grad_sq", "advect", "div_grad", "div_normal"}


def rebuilt(e: Expr, args: tuple) -> Expr:
    """The node with other arguments, simplified again."""
    simple: dict[str, Callable] = {"add": add, "sub": sub, "mul": mul, "div": div, "neg": neg, "where": where}
    if e.op in simple:
        return simple[e.op](*args)
    return power(args[0], e.payload) if e.op == "pow" else Expr(e.op, args, e.payload)


def transformed(e: Expr, leaf: Callable[[Expr], Expr | None], seen: dict | None = None) -> Expr:
    """Rebuild bottom-up; leaf returns a replacement, or None to go on."""
    seen = {} if seen is None else seen
    if e not in seen:
        new = leaf(e)
        seen[e] = new if new is not None else rebuilt(e, tuple(transformed(a, leaf, seen) for a in e.args)) if e.args else e
    return seen[e]


def shift(e: Expr, offset: tuple[int, int, int]) -> Expr:
    """The expression's value at a grid offset: pushed through to the samples."""
    if offset == (0, 0, 0):
        return e

    def leaf(n: Expr) -> Expr | None:
        if n.op == "sample":
            name, own = n.payload
            return at(name, tuple(a + b for a, b in zip(own, offset, strict=True)))
        if n.op == "coord":
            return Expr("coord", (), (n.payload[0], n.payload[1] + offset[n.payload[0]]))
        if n.op in DIFFERENTIAL:
            raise ValidationError("shift", "bind schemes before shifting a derivative")
        return None

    return transformed(e, leaf)


def samples(e: Expr, out: set | None = None, seen: set | None = None) -> set[tuple[str, tuple[int, int, int]]]:
    """All (field, offset) that an expression reads."""
    out, seen = set() if out is None else out, set() if seen is None else seen
    if e not in seen:
        seen.add(e)
        if e.op == "sample":
            out.add(e.payload)
        for a in e.args:
            samples(a, out, seen)
    return out


def halo(e: Expr) -> tuple[int, bool]:
    """How far it reads, and whether it reads diagonal neighbours."""
    own = samples(e)
    return max((max(map(abs, o)) for _, o in own), default=0), any(sum(x != 0 for x in o) > 1 for _, o in own)


def operators(e: Expr) -> list[str]:
    """The differential operators that need a scheme, sorted, each once."""
    out, seen = set(), set()

    def visit(n: Expr) -> None:
        if n in seen:
            return
        seen.add(n)
        if n.op in DIFFERENTIAL:
            out.add(f"{n.op}({key_of(n)})")
        for a in n.args:
            visit(a)

    visit(e)
    return sorted(out)


def key_of(n: Expr) -> str:
    """How scheme tables name the operands of a differential operator."""
    name = lambda a: a.payload[0] if a.op == "sample" else "expr"
    if n.op == "d":
        return ",".join([name(n.args[0]), *("xyz"[a] for a in n.payload)])
    return ",".join(map(name, n.args))


def partial(e: Expr, name: str) -> Expr:
    """Pointwise derivative with respect to a field's value."""
    if e.op == "sample":
        return const(1 if e.payload == (name, (0, 0, 0)) else 0)
    return _chain(e, lambda a: partial(a, name))


def _chain(e: Expr, d: Callable[[Expr], Expr]) -> Expr:
    """Sum, product and chain rules, with d for the arguments."""
    a = e.args
    if e.op in ("const", "param", "coord"):
        return const(0)
    rules: dict[str, Callable[[], Expr]] = {
        "add": lambda: d(a[0]) + d(a[1]),
        "sub": lambda: d(a[0]) - d(a[1]),
        "mul": lambda: d(a[0]) * a[1] + a[0] * d(a[1]),
        "div": lambda: d(a[0]) / a[1] - a[0] * d(a[1]) / (a[1] * a[1]),
        "neg": lambda: -d(a[0]),
        "pow": lambda: e.payload * power(a[0], e.payload - 1) * d(a[0]),
        "sin": lambda: call("cos", a[0]) * d(a[0]),
        "cos": lambda: -(call("sin", a[0]) * d(a[0])),
        "tanh": lambda: (1 - e * e) * d(a[0]),
        "exp": lambda: e * d(a[0]),
        "log": lambda: d(a[0]) / a[0],
        "sqrt": lambda: d(a[0]) / (2 * e),
        "abs": lambda: where(a[0] >= 0, d(a[0]), -d(a[0])),
        "where": lambda: where(a[0], d(a[1]), d(a[2])),
        "min": lambda: where(a[0] <= a[1], d(a[0]), d(a[1])),
        "max": lambda: where(a[0] >= a[1], d(a[0]), d(a[1])),
        "hypot": lambda: (a[0] * d(a[0]) + a[1] * d(a[1])) / e,
        "atan2": lambda: (a[1] * d(a[0]) - a[0] * d(a[1])) / (a[0] * a[0] + a[1] * a[1]),
    }
    if e.op not in rules:
        raise ValidationError("derivative", f"{e.op} has no derivative rule")
    return rules[e.op]()


def expanded(e: Expr) -> Expr:
    """First derivatives and Laplacians of pointwise expressions, by chain and product rules, down to derivatives of fields."""

    def first(a: Expr, axis: int) -> Expr:
        if a.op == "sample":
            return derivative(a, axis)
        if a.op == "coord":
            return const(a.payload[0] == axis)
        return _chain(a, lambda b: first(b, axis))

    def laplacian(a: Expr) -> Expr:
        if a.op == "sample":
            return lap(a)
        if a.op in ("add", "sub"):
            return rebuilt(a, tuple(map(laplacian, a.args)))
        if a.op == "neg":
            return -laplacian(a.args[0])
        names = sorted({n for n, _ in samples(a)})
        out = const(0)
        for p in names:
            out = out + partial(a, p) * lap(field(p))
            for q in names:
                both = partial(partial(a, p), q)
                out = out + both * (grad_sq(field(p)) if p == q else add(*[derivative(field(p), x) * derivative(field(q), x) for x in (0, 1)]))
        return out

    def leaf(n: Expr) -> Expr | None:
        if n.op == "d" and len(n.payload) == 1 and n.args[0].op != "sample":
            return first(expanded(n.args[0]), n.payload[0])
        if n.op == "lap" and n.args[0].op != "sample":
            return laplacian(expanded(n.args[0]))
        return None

    return transformed(e, leaf)


@dataclass(frozen=True)
class Vector:
    """Components of a vector expression."""

    parts: tuple[Expr, ...]

    @classmethod
    def field(cls, name: str, size: int) -> Vector:
        return cls(tuple(field(n) for n in names(name, size)))

    def __add__(self, o: Vector) -> Vector:
        return Vector(tuple(a + b for a, b in zip(self.parts, o.parts, strict=True)))

    def __sub__(self, o: Vector) -> Vector:
        return Vector(tuple(a - b for a, b in zip(self.parts, o.parts, strict=True)))

    def __mul__(self, o: Expr | Number) -> Vector:
        return Vector(tuple(a * o for a in self.parts))

    def dot(self, o: Vector) -> Expr:
        out = const(0)
        for a, b in zip(self.parts, o.parts, strict=True):
            out = out + a * b
        return out

    def divergence(self) -> Expr:
        out = const(0)
        for axis, a in enumerate(self.parts):
            out = out + derivative(a, axis)
        return out

    def curl(self) -> Vector:
        if len(self.parts) != 3:
            raise ValidationError("curl", "needs three components")
        x, y, z = self.parts
        return Vector((derivative(z, 1) - derivative(y, 2), derivative(x, 2) - derivative(z, 0), derivative(y, 0) - derivative(x, 1)))


def gradient(e: Expr, dim: int) -> Vector:
    return Vector(tuple(derivative(e, a) for a in range(dim)))


def names(name: str, size: int) -> list[str]:
    """Columns of a vector field: _x, _y, _z for three components, else numbers."""
    return [f"{name}_{s}" for s in ("xyz" if size == 3 else map(str, range(size)))]
