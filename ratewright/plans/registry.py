"""Named queries with their check SQL, and named SQL fragments those share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``check`` is the SQL that must give the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return add


def fragment(name: str, needs: tuple[str, ...], body: str) -> None:
    """Declare a common table expression ``name AS (body)``; ``name`` may carry a column list."""
    FRAGMENTS[name.split("(")[0].strip()] = (needs, f"{name} AS ({body})")


def sql(main: str, *needs: str) -> str:
    """Prefix ``main`` with the fragments it needs, in dependency order."""
    seen: dict[str, str] = {}

    def visit(n):
        if n in seen:
            return
        deps, body = FRAGMENTS[n]
        for d in deps:
            visit(d)
        seen[n] = body

    for n in needs:
        visit(n)
    if not seen:
        return main
    return "WITH RECURSIVE " + ",\n".join(seen.values()) + "\n" + main


def rnd(expr: str, places: int) -> str:
    """Rounded expression without a negative zero."""
    return f"(round({expr}, {places}) + 0.0)"
