"""Registration of queries together with their SQL counterparts."""

from __future__ import annotations

import re


class Registry:
    """Queries of one module: name -> callable and, where SQL can express it, name -> SQL."""

    def __init__(self, views: dict[str, str] | None = None):
        self.queries, self.sql, self.views = {}, {}, views or {}

    def query(self, sql: str | None = None, name: str | None = None):
        def register(f):
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.sql[key] = self.with_views(sql)
            return f

        return register

    def with_views(self, sql: str) -> str:
        """``sql`` preceded by the common table expressions it mentions, dependencies first."""
        order: list[str] = []

        def need(text: str, within: tuple[str, ...]) -> None:
            for v, body in self.views.items():
                if v not in order and v not in within and re.search(rf"\b{v}\b", text):
                    need(body, (*within, v))
                    if v not in order:
                        order.append(v)

        need(sql, ())
        if not order:
            return sql
        ctes = ", ".join(f"{v} AS ({self.views[v]})" for v in order)
        recursive = sql.lstrip().upper().startswith("WITH RECURSIVE") or any("UNION ALL SELECT c." in self.views[v] for v in order)
        body = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql) if re.match(r"^\s*WITH ", sql) else " " + sql
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}"
