"""Named queries and, for each, the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewise.plans.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Put the common views a statement mentions (directly or not) in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    body = body.strip()
    if not needed:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if re.match(r"(?i)with\b", body):
        return head + ",\n" + re.sub(r"(?i)^with\b", "", body, count=1).strip()
    return head + "\n" + body


def sql_p_t(t: str, df: str, n: int = 40000) -> str:
    """Two-sided p of a t value: midpoint sums of cos(angle) ** (df - 1) from atan(|t| / sqrt(df)) and from 0."""
    def area(low):
        return (f"list_sum(list_transform(range({n}), lambda i : pow(cos({low} + (pi() / 2 - {low}) * (i + 0.5) / {n}), {df} - 1)))"
                f" * (pi() / 2 - {low})")
    return f"({area(f'atan(abs({t}) / sqrt({df}))')} / ({area('0.0')}))"


def sql_p_normal(z: str, n: int = 20000) -> str:
    """Two-sided p of a z value: midpoint sum of the density over 12 units from |z|."""
    return (f"(list_sum(list_transform(range({n}), lambda i : exp(-pow(abs({z}) + 12.0 * (i + 0.5) / {n}, 2) / 2)))"
            f" * 12.0 / {n} * 2 / sqrt(2 * pi()))")


def sql_p_chi2(x: str, k: str, n: int = 8000) -> str:
    """Upper tail of chi-square by midpoint sums of the chi density from the root of ``x``."""
    y, width = f"sqrt({x})", f"(greatest(sqrt({k}), sqrt({x})) + 14 - sqrt({x}))"
    at = f"({y} + {width} * (i + 0.5) / {n})"
    return (f"(list_sum(list_transform(range({n}), lambda i : exp(({k} - 1) * ln({at}) - pow({at}, 2) / 2"
            f" - lgamma({k} / 2.0) - ({k} / 2.0 - 1) * ln(2)))) * {width} / {n})")


def sql_p_f(f: str, a: str, b: str, n: int = 60000) -> str:
    """Upper tail of F: the square of a tangent has the density sin ** (a - 1) * cos ** (b - 1) of its angle."""
    def area(low):
        at = f"({low} + (pi() / 2 - {low}) * (i + 0.5) / {n})"
        return (f"list_sum(list_transform(range({n}), lambda i : pow(sin({at}), {a} - 1) * pow(cos({at}), {b} - 1)))"
                f" * (pi() / 2 - {low})")
    return f"({area(f'atan(sqrt({f} * {a} / {b}))')} / ({area('0.0')}))"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB counterpart over the same tables."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register
