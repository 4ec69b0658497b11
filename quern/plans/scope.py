"""Names while a statement is lowered: values with kinds, sources, dereference joins."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.lang.diag import QueryError

_numbers = itertools.count(1)


@dataclass
class Val:
    """A lowered expression: its column, its kind and, for references, the objects it may point to; text of a string constant."""

    col: Column
    kind: str
    targets: tuple[str, ...] = ()
    text: str | None = None

    @property
    def wide(self) -> bool:
        """A reference that carries its type."""
        return self.kind == "ref" and len(self.targets) > 1


@dataclass
class Bound:
    """A field of a source: the column that holds it in the joined frame."""

    name: str
    column: str
    kind: str
    targets: tuple[str, ...] = ()

    def val(self) -> Val:
        return Val(F.col(self.column), self.kind, self.targets)


@dataclass
class Src:
    alias: str
    fields: dict[str, Bound]  # by every lower-case name
    order: list[Bound]
    obj: Any = None
    key: str | None = None
    also: tuple[str, ...] = ()  # further aliases

    def find(self, name: str) -> Bound | None:
        return self.fields.get(name.lower())


def bind(df: DataFrame, alias: str, columns: list[tuple[str, tuple[str, ...], str, tuple[str, ...]]], obj=None, exact: bool = False) -> tuple[DataFrame, Src]:
    """Give the frame's columns names that nothing else has. columns: (name, further names, kind, targets).

    exact: the frame has just these columns in this order, which saves a call for each.
    """
    n = next(_numbers)
    order = [Bound(name, f"s{n}_{i}", kind, targets) for i, (name, _, kind, targets) in enumerate(columns)]
    fields = {}
    for b, (name, more, _, _) in zip(order, columns):
        for x in (name, *more):
            fields.setdefault(x.lower(), b)
    df = df.toDF(*[b.column for b in order]) if exact else df.select(*[F.col(f"`{name}`").alias(b.column) for b, (name, *_) in zip(order, columns)])
    return df, Src(alias, fields, order, obj)


@dataclass
class Scope:
    engine: Any
    df: DataFrame | None = None
    sources: list[Src] = field(default_factory=list)
    parent: "Scope | None" = None
    joined: dict = field(default_factory=dict)  # (column, target) -> Src
    grouped: dict | None = None  # after grouping: text of a lowered expression -> column
    aggregates: dict | None = None

    def source(self, alias: str) -> Src | None:
        return next((s for s in self.sources if alias.lower() in (s.alias.lower(), *map(str.lower, s.also))), None)

    def path(self, parts: list[str], at: int | None = None) -> Val:
        found = self._path(parts, at)
        if found is not None:
            return found
        if self.parent is not None:
            outer = self.parent.path(parts, at)
            return Val(outer.col.outer(), outer.kind, outer.targets)
        raise QueryError("unknown_field", ".".join(parts), at)

    def _path(self, parts: list[str], at: int | None) -> Val | None:
        src = self.source(parts[0]) if len(parts) > 1 else None
        if src is None and len(parts) > 2 and self.engine.model.kind(parts[0]):
            # A source without an alias may be named in full.
            src = next((s for s in self.sources if s.obj is not None and s.obj is self.engine.model.find(parts[0], parts[1])), None)
            rest = parts[2:]
        else:
            rest = parts[1:]
        if src is None:
            owners = [s for s in self.sources if s.find(parts[0])]
            if not owners:
                return None
            if len(owners) > 1:
                raise QueryError("ambiguous_field", parts[0], at)
            src, rest = owners[0], parts
        bound = src.find(rest[0])
        if bound is None:
            raise QueryError("unknown_field", ".".join(parts), at)
        val = bound.val()
        for name in rest[1:]:
            val = self.dereference(val, name, at)
        return val

    # -- references --------------------------------------------------------------------------
    def _join(self, val: Val, target: str) -> Src:
        """LEFT JOIN of one target object, once for each reference column."""
        key = (str(val.col), target)
        if key not in self.joined:
            obj = self.engine.object(target)
            df, src = self.engine.relation(obj, f"_{target}", implicit=True)
            ref = src.find("Ref")
            if ref is None:
                raise QueryError("type", f"{target} has no reference")
            if val.wide:
                condition = (val.col["type"] == F.lit(obj.type_no)) & (val.col["ref"] == self.engine.key_text(target, F.col(ref.column)))
            else:
                condition = val.col == F.col(ref.column)
            self.df = self.df.join(df, condition, "left")
            self.joined[key] = src
        return self.joined[key]

    def dereference(self, val: Val, name: str, at: int | None = None) -> Val:
        if name.lower() in ("представление", "presentation"):
            return self.presentation(val)
        if val.kind != "ref":
            raise QueryError("type", f"{name} of a value that is no reference", at)
        owners = [t for t in val.targets if (f := self.engine.object(t).find(name))]
        if not owners:
            raise QueryError("unknown_field", f"{name} of {', '.join(val.targets)}", at)
        found = [(t, self._join(val, t).find(name)) for t in owners]
        if len(val.targets) == 1:
            return found[0][1].val()
        kinds = {b.kind for _, b in found}
        vals = [(t, b.val()) for t, b in found]
        if len(kinds) > 1:
            vals, kind = [(t, self.engine.composite(v)) for t, v in vals], "composite"
        else:
            kind = kinds.pop()
        out = None
        for t, v in vals:
            guard = val.col["type"] == F.lit(self.engine.object(t).type_no)
            out = F.when(guard, v.col) if out is None else out.when(guard, v.col)
        return Val(out, kind, found[0][1].targets if kind == "ref" else ())

    def presentation(self, val: Val) -> Val:
        """Text of a value; of a reference, its object's template; empty for a reference to nothing."""
        if val.kind != "ref":
            return self.engine.text(val)
        out = F.lit("")
        for t in val.targets:
            obj, src = self.engine.object(t), self._join(val, t)
            parts = [F.lit(p[1:-1]) if p.startswith("'") else F.coalesce(self.engine.text(src.find(p).val()).col, F.lit("")) for p in obj.presentation or ("Description",) if p.startswith("'") or src.find(p)]
            own = F.when(F.col(src.find("Ref").column).isNull(), F.lit("")).otherwise(F.concat(*parts))
            out = own if not val.wide else F.when(val.col["type"] == F.lit(obj.type_no), own).otherwise(out)
        return Val(F.when(val.col.isNotNull(), out), "string")
