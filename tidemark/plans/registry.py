"""How plan modules register: a decorator that takes the query's name and its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(name: str, *ctes: str, sql_text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[name] = f
            if sql_text is not None:
                sql[name] = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + sql_text
            return f

        return add

    return queries, sql, query
