"""Registry of named queries, each with an output contract and (where SQL can state it) an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.plans.oracle_views import VIEWS

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    out: dict[str, str]
    run: QueryFn
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def parse_out(out: str) -> dict[str, str]:
    """``"i:a,b d:c s:d b:e"`` -> ordered column kinds (integer, double, string, boolean)."""
    kinds: dict[str, str] = {}
    for group in out.split():
        kind, _, names = group.partition(":")
        for name in names.split(","):
            kinds[name] = kind
    return kinds


def _spark_cast(name: str, kind: str) -> Column:
    col = F.col(name)
    if kind == "i":
        return col.cast("long").alias(name)
    if kind == "d":
        return F.round(col.cast("double"), 6).alias(name)
    if kind == "s":
        return col.cast("string").alias(name)
    return col.cast("boolean").alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "d":
        return f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    return f"CAST({name} AS BOOLEAN) AS {name}"


def _with_views(body: str) -> str:
    """Prefix the view definitions the body (transitively) names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view, sql in VIEWS.items():
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(sql)
                if view not in needed:
                    needed.append(view)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


def query(name: str, out: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    kinds = parse_out(out)

    def wrap(fn: QueryFn) -> QueryFn:
        final = None
        if sql is not None:
            cols = ", ".join(_sql_cast(n, k) for n, k in kinds.items())
            final = f"SELECT {cols} FROM (\n{_with_views(sql)}\n) AS answer"
        if name in _ENTRIES:
            raise ValueError(f"duplicate query {name}")
        _ENTRIES[name] = Entry(name, kinds, fn, final)
        return fn

    return wrap


def run_entry(e: Entry, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a named query and give its columns the declared kinds (doubles to six places)."""
    return e.run(spark, sf_dir).select(*[_spark_cast(n, k) for n, k in e.out.items()])


def entries() -> dict[str, Entry]:
    from astrolake.plans import load_all

    load_all()
    return dict(_ENTRIES)
