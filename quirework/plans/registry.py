"""Queries by name, each with the DuckDB SQL it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import COMMANDS_SQL, ELEMENTS_SQL, NESTED_SQL, PAGES_SQL, VIEWPORTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_PARTS = {"doc_page": PAGES_SQL, "doc_element": ELEMENTS_SQL, "command_log": COMMANDS_SQL, "viewport": VIEWPORTS_SQL, "nested_el": NESTED_SQL}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; the tables its SQL names are put before it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            used = [part for name, part in _PARTS.items() if name in sql or name == "doc_element" and "nested_el" in sql]
            body = sql.strip()
            if body.upper().startswith("WITH "):
                recursive = body[5:].upper().startswith("RECURSIVE ")
                body = body[15:] if recursive else body[5:]
                head = "WITH RECURSIVE " if recursive else "WITH "
                SQL[f.__name__] = head + ",\n".join([*used, body])
            else:
                SQL[f.__name__] = ("WITH " + ",\n".join(used) + "\n" if used else "") + body
        return f

    return add
