"""Small linear systems in expressions: each stage names columns and the text of their expressions, the same in any SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solving(n: int, rights: tuple[str, ...] = ("b",)) -> list[dict[str, str]]:
    """Stages that solve a_ij x_j = b_i (columns a0_0 .. of the upper triangle, b0 .. for each right side b) into x columns (xb0 .. for b).

    Elimination without exchange, which is stable for the symmetric positive definite systems of normal equations. A pivot of 0 gives nulls.
    """
    a = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    stages: list[dict[str, str]] = []
    for k in range(n - 1):
        step = {}
        for i in range(k + 1, n):
            f = f"{a(k, i)} / nullif({a(k, k)}, 0)"
            step |= {a(i, j): f"{a(i, j)} - {f} * {a(k, j)}" for j in range(i, n)}
            step |= {f"{r}{i}": f"{r}{i} - {f} * {r}{k}" for r in rights}
        stages.append(step)
    for i in reversed(range(n)):
        known = lambda r: "".join(f" - {a(i, j)} * x{r}{j}" for j in range(i + 1, n))  # noqa: E731, B023
        stages.append({f"x{r}{i}": f"({r}{i}{known(r)}) / nullif({a(i, i)}, 0)" for r in rights})
    return stages


def solved(df: DataFrame, n: int, rights: tuple[str, ...] = ("b",)) -> DataFrame:
    for stage in solving(n, rights):
        df = df.withColumns({k: F.expr(e) for k, e in stage.items()})
    return df


def solved_sql(source: str, n: int, rights: tuple[str, ...] = ("b",)) -> str:
    """The same as nested SQL over a table that has the columns."""
    seen: set[str] = set()
    for k, stage in enumerate(solving(n, rights)):
        new = {c: e for c, e in stage.items() if c.startswith("x") and c not in seen}
        old = {c: e for c, e in stage.items() if c not in new}
        seen |= new.keys()
        change = f" replace ({', '.join(f'{e} as {c}' for c, e in old.items())})" if old else ""
        add = "".join(f", {e} as {c}" for c, e in new.items())
        source = f"(select *{change}{add} from {source} as t{k})"
    return source
