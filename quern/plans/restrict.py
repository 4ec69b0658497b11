"""Row-level rules: a condition over an object's rows, also with joins of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.lang import ast
from quern.lang.diag import QueryError
from quern.lang.parser import parse_restriction
from quern.plans.scope import Scope, Src, bind

CURRENT_TABLE = "ТекущаяТаблица"  # how a rule names the rows that it restricts (fixed value)


def apply(engine, df: DataFrame, src: Src, text: str) -> DataFrame:
    """The rows for which the rule holds. Rows never multiply: with joins, some joined row must satisfy the condition."""
    from quern.plans.expressions import unnumbered

    rule = parse_restriction(text)
    names = (CURRENT_TABLE, *([rule.alias] if rule.alias else []))
    if rule.source is not None:
        if rule.source.query or rule.source.param or rule.source.args is not None or len(rule.source.parts) != 2 or engine.object_of(rule.source.parts) is not src.obj:
            raise QueryError("restriction", "the source of a rule is the object that it restricts")
        names += (rule.source.alias,) if rule.source.alias else ()
    if not rule.joins:
        condition, scope = _lowered(engine, [(df, Src(src.obj.full_name.split(".")[1], src.fields, src.order, src.obj, also=names))], [rule.condition])
        return scope.df.where(condition[0]).select(*df.columns)
    joined = [_joined(engine, j) for j in rule.joins]
    conditions = [j.on for j in rule.joins] + [rule.condition]
    for c in conditions:
        unnumbered(c, "a rule with joins")
    if len(joined) == 1 and rule.joins[0].how == "inner":
        row = Src(src.obj.full_name.split(".")[1], src.fields, src.order, src.obj, also=names)
        right = joined[0][0]
        lowered, scope = _lowered(engine, [(df, row), *joined], conditions, df.crossJoin(right))  # never run: it only shows whether the rule dereferences
        if not scope.joined:
            return df.join(right, reduce(lambda a, b: a & b, lowered), "left_semi")
    return _through_keys(engine, df, src, names, rule, joined)


def _joined(engine, j: ast.Join) -> tuple[DataFrame, Src]:
    x = j.right
    if x.query is not None or x.param is not None or x.args is not None or len(x.parts) != 2:
        raise QueryError("restriction", "a rule joins objects of the model only")
    if j.how not in ("inner", "left"):
        raise QueryError("restriction", "a rule joins by LEFT or INNER JOIN only")
    obj = engine.object_of(x.parts)
    return engine.relation(obj, x.alias or x.parts[1])


def _lowered(engine, sources: list[tuple[DataFrame, Src]], conditions: list[ast.Node], df: DataFrame | None = None) -> tuple[list[Column], Scope]:
    from quern.plans.expressions import Lower

    scope = Scope(engine, sources[0][0] if df is None else df, [s for _, s in sources])
    return [Lower(engine, scope).condition(c) for c in conditions], scope


def _through_keys(engine, df: DataFrame, src: Src, names: tuple[str, ...], rule: ast.Rule, joined: list[tuple[DataFrame, Src]]) -> DataFrame:
    """Join a copy of the rows, filter, and keep the rows whose key came through: the reference, or else all columns."""
    from quern.plans.expressions import Lower

    obj = src.obj
    copy, own = bind(engine.frame(obj), obj.full_name.split(".")[1], [(f.name, f.names, f.kind, f.targets) for f in obj.fields], obj, exact=True)
    own.also = names
    scope = Scope(engine, copy, [own])
    for j, (right, r) in zip(rule.joins, joined):
        scope.sources.append(r)
        before, scope.df = scope.df, right
        condition = Lower(engine, scope).condition(j.on)
        if scope.df is not right:
            raise QueryError("restriction", "a dereference in the condition of a rule's join")
        scope.df = before.join(right, condition, j.how)
    condition = Lower(engine, scope).condition(rule.condition)
    unique = own.find("Ref") is not None and obj.full_name.count(".") == 1 and not obj.kind.endswith("Register")
    keys = [(src.find("Ref"), own.find("Ref"))] if unique else list(zip(src.order, own.order))
    through = scope.df.where(condition).select(*[F.col(b.column) for _, b in keys])
    same = reduce(lambda a, b: a & b, [F.col(a.column).eqNullSafe(F.col(b.column)) for a, b in keys])
    return df.join(through, same, "left_semi")
