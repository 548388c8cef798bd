"""Registration of runnable queries with their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHARED_SQL: dict[str, str] = {}


def shared(name: str, sql: str) -> None:
    """A named subquery that check statements may mention."""
    SHARED_SQL[name] = sql.strip()


def fork(base: str, other: str, suffix: str) -> None:
    """Copy every named subquery that rests on ``base`` so that it rests on ``other``."""
    touched = {base}
    while True:
        more = {
            n for n, sql in SHARED_SQL.items()
            if n not in touched and n != other and any(re.search(rf"\b{d}\b", sql) for d in touched)
        }
        if not more:
            break
        touched |= more
    names = {n: (other if n == base else n + suffix) for n in touched}
    for n in touched - {base}:
        sql = SHARED_SQL[n]
        for old, new in names.items():
            sql = re.sub(rf"\b{old}\b", new, sql)
        SHARED_SQL[names[n]] = sql


def statement(body: str) -> str:
    """Prefix ``body`` with the named subqueries it mentions, in dependency order."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name, sql in SHARED_SQL.items():
            if name in order or name in seen:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(sql, seen + (name,))
                if name not in order:
                    order.append(name)

    visit(body, ())
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({SHARED_SQL[n]})" for n in order)
    glue = ", " if body.lstrip().upper().startswith("WITH ") else " "
    rest = re.sub(r"^\s*WITH\s", "", body, flags=re.I) if glue == ", " else body
    return f"WITH {parts}{glue}{rest}"


def plain_types(df: DataFrame) -> DataFrame:
    """Widen ints, decimals and dates so that results compare by value across engines."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; ``sql`` computes the same rows on the same tables."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain_types(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def all_oracles() -> dict[str, str]:
    return {name: statement(sql) for name, sql in ORACLE.items()}
