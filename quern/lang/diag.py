"""Diagnostics with a kind and a position."""

from __future__ import annotations


class QueryError(Exception):
    """kind: syntax, unknown_object, unknown_field, ambiguous_field, type, unsupported, parameter, limit, restriction, temp_table, separator."""

    def __init__(self, kind: str, message: str, position: int | None = None):
        super().__init__(f"{kind}: {message}" + ("" if position is None else f" (at {position})"))
        self.kind, self.message, self.position = kind, message, position
