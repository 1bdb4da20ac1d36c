"""Where the query modules put their queries and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str = "", name: str = "") -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def column(name: str, table: Callable, keys: list[str], make: Callable[[], dict[str, Column]], ctes: str, select: str, source: str) -> None:
    """A query that projects a table, with its SQL."""
    query(f"{f'WITH {ctes} ' if ctes else ''}SELECT {', '.join(keys)}, {select} FROM {source}", name)(lambda s, d: table(s, d).select(*keys, *[c.alias(k) for k, c in make().items()]))


def r6(c: Column) -> Column:
    return F.bround(c, 6) + 0.0


def sql_strip(c: str) -> str:
    """Python's strip() in SQL."""
    return rf"regexp_replace({c}, '^[\t-\r\x1C-\x20\x{{85}}\p{{Z}}]+|[\t-\r\x1C-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"


def sql_rstrip(c: str) -> str:
    return rf"regexp_replace({c}, '[\t-\r\x1C-\x20\x{{85}}\p{{Z}}]+$', '')"


def quoted(text: str) -> str:
    """A Python string as an SQL expression."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"
