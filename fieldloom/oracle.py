"""SQL for DuckDB that computes grid results another way: neighbours by mapped places in one ordered list."""

from __future__ import annotations

from collections.abc import Callable

GRID = """
s AS (SELECT CAST(l_partkey % 32 AS INT) i, CAST(l_orderkey % 24 AS INT) j, SUM(l_quantity) v, COUNT(*) w FROM lineitem GROUP BY 1, 2),
c AS (SELECT CAST(a AS INT) i, CAST(b AS INT) j FROM range(32) x(a), range(24) y(b)),
b AS (SELECT c.i, c.j, 0 AS k, CAST(COALESCE(s.v, 0) AS DOUBLE) v, CAST(COALESCE(s.w, 0) AS DOUBLE) w FROM c LEFT JOIN s USING (i, j)),
"""
BOX = """
s AS (SELECT CAST(l_partkey % 8 AS INT) i, CAST(l_orderkey % 6 AS INT) j, CAST(l_suppkey % 4 AS INT) k, SUM(l_quantity) v, COUNT(*) w FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT CAST(a AS INT) i, CAST(b AS INT) j, CAST(d AS INT) k FROM range(8) x(a), range(6) y(b), range(4) z(d)),
b AS (SELECT c.i, c.j, c.k, CAST(COALESCE(s.v, 0) AS DOUBLE) v, CAST(COALESCE(s.w, 0) AS DOUBLE) w FROM c LEFT JOIN s USING (i, j, k)),
"""
LINE = """
s AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) % 240 i, COUNT(*) v, SUM(user_id % 7) w FROM events GROUP BY 1),
c AS (SELECT CAST(a AS INT) i FROM range(240) x(a)),
b AS (SELECT c.i, 0 AS j, 0 AS k, CAST(COALESCE(s.v, 0) AS DOUBLE) v, CAST(COALESCE(s.w, 0) AS DOUBLE) w FROM c LEFT JOIN s USING (i)),
"""
FIELDS = """
g AS (SELECT i, j, k, v, w, (CAST(v AS BIGINT) % 17) / 16.0::DOUBLE AS p, (CAST(w AS BIGINT) % 13) / 16.0::DOUBLE AS q,
             CAST(CAST(v AS BIGINT) % 5 - 2 AS DOUBLE) ux, CAST(CAST(w AS BIGINT) % 5 - 2 AS DOUBLE) uy,
             CAST(CASE WHEN CAST(v AS BIGINT) % 7 = 0 THEN CAST(v AS BIGINT) % 5 ELSE -1 END AS INT) id FROM b)
"""
SIZES = {GRID: (32, 24, 1), BOX: (8, 6, 4), LINE: (240, 1, 1)}

Neighbour = Callable[..., str]


def _mapped(key: str, by: int, n: int, rule: str) -> str:
    if by == 0 or n == 1:
        return key
    at = f"({key} + {by})"
    if rule == "periodic":
        return f"(({key} + {by} + {n * 8}) % {n})"
    if rule == "noflux":
        return f"greatest(0, least({n - 1}, {at}))"
    if rule == "reflect":
        return f"CASE WHEN {at} < 0 THEN -{at} - 1 WHEN {at} >= {n} THEN {2 * n - 1} - {at} ELSE {at} END"
    return at


def with_steps(body: str, base: str = GRID) -> str:
    return f"WITH {base.strip()}{FIELDS}{body}"


def stage(formulas: dict[str, Callable[[Neighbour], str]], source: str = "g", keep: tuple[str, ...] = (), rule: str = "periodic", value: float = 0.0, base: str = GRID, digits: int | None = None, keys: str = "t.i, t.j, t.k") -> str:
    """A SELECT over a CTE; n(field, dx, dy, dz) is a neighbour's value, read from the list of all cells in order."""
    size, lists = SIZES[base], set()

    def n(f: str, dx: int = 0, dy: int = 0, dz: int = 0) -> str:
        if (dx, dy, dz) == (0, 0, 0):
            return f"t.{f}"
        lists.add(f)
        at = [f"({_mapped(f't.{key}', by, m, rule)})" for key, by, m in zip("ijk", (dx, dy, dz), size, strict=True)]
        got = f"a.{f}[1 + {at[0]} + {size[0]} * {at[1]} + {size[0] * size[1]} * {at[2]}]"
        if rule != "fixed":
            return got
        inside = " AND ".join(f"t.{key} + {by} BETWEEN 0 AND {m - 1}" for key, by, m in zip("ijk", (dx, dy, dz), size, strict=True) if by)
        return f"CASE WHEN {inside} THEN {got} ELSE {value!r}::DOUBLE END"

    columns = {k: fn(n) for k, fn in formulas.items()}
    if digits is not None:
        columns = {k: f"ROUND({c}, {digits}) + 0.0" for k, c in columns.items()}
    listed = ", ".join([keys, *(f"t.{f}" for f in keep), *(f"{c} AS {k}" for k, c in columns.items())])
    arrays = ", ".join(f"list({f} ORDER BY k, j, i) AS {f}" for f in sorted(lists))
    return f"SELECT {listed} FROM {source} t" + (f", (SELECT {arrays} FROM {source}) a" if lists else "")


def sql(formulas: dict[str, Callable[[Neighbour], str]], rule: str = "periodic", value: float = 0.0, base: str = GRID, digits: int | None = None) -> str:
    return with_steps(stage(formulas, rule=rule, value=value, base=base, digits=digits), base)


def chain(steps: list[tuple[dict[str, Callable[[Neighbour], str]], tuple[str, ...]]], last: str, rule: str = "periodic", base: str = GRID) -> str:
    """Several stages, each a CTE g1, g2, ... over the one before; last: the final SELECT."""
    out, source = [f"WITH {base.strip()}{FIELDS}"], "g"
    for k, (formulas, keep) in enumerate(steps, 1):
        out.append(f", g{k} AS ({stage(formulas, source, keep, rule, base=base)})")
        source = f"g{k}"
    return "".join(out) + last
