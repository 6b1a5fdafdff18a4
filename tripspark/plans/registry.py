"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.plans.as_text import AS_TEXT
from tripspark.plans.standin import CTES, StandIn

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _shift(n: int) -> float:
    """A step far below the last kept digit: exact halves then round the same way in every engine."""
    return float(f"3.1e-{n + 2}")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round measured columns; adding 0 turns a negative zero into zero."""

    def one(c: str):
        return F.round(F.col(c).cast("double") + F.lit(_shift(digits[c])), digits[c]) + F.lit(0.0)

    return df.select(*[one(c).alias(c) if c in digits else F.col(c) for c in df.columns])


def _digits(spec: str) -> dict[str, int]:
    """'a b c:4' -> 6 digits for a and b, 4 for c."""
    out = {}
    for item in spec.split():
        name, _, n = item.partition(":")
        out[name] = int(n or 6)
    return out


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the needed common table expressions in front of a query, in dependency order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(FROM|JOIN|from|join)\s+{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in needed) + "\n" + sql


def _time_columns(name: str) -> list[tuple[str, str]]:
    items = [item.partition(":") for item in AS_TEXT.get(name, "").split()]
    return [(c, kind or "date") for c, _, kind in items]


def _text(c: str, kind: str) -> Column:
    return F.col(c).cast("date").cast("string") if kind == "date" else F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _text_sql(c: str, kind: str) -> str:
    return f"CAST(CAST({c} AS DATE) AS VARCHAR)" if kind == "date" else f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def query(name: str, sql: str | None = None, round: str = "", ctes: dict[str, str] | None = None):
    """Register a function of StandIn tables under ``name`` together with its SQL, if it has one."""
    digits = _digits(round)

    times = dict(_time_columns(name))

    def register(build: Callable[[StandIn], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(StandIn(spark, sf_dir)), digits).withColumns({c: _text(c, kind) for c, kind in times.items()})

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            parts = [f'round(CAST("{c}" AS DOUBLE) + {_shift(n)!r}, {n}) + 0.0e0 AS "{c}"' for c, n in digits.items()]
            parts += [f"{_text_sql(c, kind)} AS {c}" for c, kind in times.items()]
            replace = ", ".join(parts)
            body = f"SELECT * REPLACE ({replace}) FROM ({sql}) AS q" if replace else sql
            ORACLE[name] = with_ctes(body, ctes)
        return build

    return register
