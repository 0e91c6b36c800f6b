"""The registry of queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.sources.tables import binding_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, use: str = ""):
    """Registers a query under its function's name, with SQL over the named bindings; `use` lists them."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ctes = [f"{name} AS ({binding_sql(name)})" for name in use.split()]
            text = nudged(sql.strip())
            head = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
            if ctes:
                text = head + ",\n".join(ctes) + (",\n" + text[len(head) :] if text.startswith(head) else "\n" + text)
            ORACLE_SQL[f.__name__] = text
        return f

    return keep


def nudge(digits: int) -> float:
    """A little more than nothing, far below the last digit kept: values that are exact ties round alike in both engines, whichever way their sums came out."""
    return 3.7 * 10.0 ** -(digits + 3)


def nudged(sql: str) -> str:
    """The SQL with the nudge inside every lower-case round(value, digits)."""
    out, at = [], 0
    for call in re.finditer(r"\bround\(", sql):
        if call.start() < at:
            continue
        depth, comma, i = 1, 0, call.end()
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        out.append(f"{sql[at : call.end()]}({nudged(sql[call.end() : comma])}) + {nudge(digits)!r}::DOUBLE, {digits})")
        at = i
    return "".join(out) + sql[at:]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*(r(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(column: Column, digits: int = 6) -> Column:
    return F.round(column + F.lit(nudge(digits)), digits) + F.lit(0.0)


def quick(column: Column, digits: int = 6) -> Column:
    """r without decimals, for a row of every pair: as DuckDB rounds, by a multiplication and a division; large or no numbers as r."""
    scale = 10.0**digits
    v = (column + F.lit(nudge(digits))) * scale
    return F.when(F.abs(column) < 1e9, F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5)) / scale).otherwise(r(column, digits))
