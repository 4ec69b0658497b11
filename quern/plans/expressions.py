"""Syntax tree to Column, with the kinds checked on the way."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from quern.functions import dates
from quern.functions.scalars import CALLS, like_regex
from quern.lang import ast
from quern.lang.diag import QueryError
from quern.lang.parser import UNITS
from quern.operators.hierarchy import descendants
from quern.plans.scope import Scope, Val

#: Tags of composite values and types (fixed values).
TAGS = {"null": 0, "undefined": 1, "boolean": 2, "number": 3, "date": 4, "string": 5, "ref": 8}
_NAMES = {"строка": "string", "string": "string", "число": "number", "number": "number", "дата": "date", "date": "date", "булево": "boolean", "boolean": "boolean"}
#: Values of system enumerations (fixed values).
SYSTEM = {
    ("виддвижениянакопления", "приход"): 0, ("виддвижениянакопления", "расход"): 1, ("accumulationrecordtype", "receipt"): 0, ("accumulationrecordtype", "expense"): 1,
    ("виддвижениябухгалтерии", "дебет"): 0, ("виддвижениябухгалтерии", "кредит"): 1, ("accountingrecordtype", "debit"): 0, ("accountingrecordtype", "credit"): 1,
    ("видсчета", "активный"): 0, ("видсчета", "пассивный"): 1, ("видсчета", "активнопассивный"): 2, ("accounttype", "active"): 0, ("accounttype", "passive"): 1, ("accounttype", "activepassive"): 2,
}


def _false() -> Column:
    return F.lit(False)


def literal(value, kind: str) -> Val:
    if kind in ("null", "undefined"):
        return Val(F.lit(None), kind)
    if kind == "date":
        return Val(F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast(dates.NTZ), "date")
    if kind == "number" and isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() and value.as_tuple().exponent >= 0 and abs(value) < 2**31 else value
    return Val(F.lit(value), kind, text=value if kind == "string" else None)


def python_value(engine, value) -> Val:
    """A parameter's value."""
    if isinstance(value, bool):
        return Val(F.lit(value), "boolean")
    if isinstance(value, (int, float, decimal.Decimal)):
        return Val(F.lit(value), "number")
    if isinstance(value, str):
        return Val(F.lit(value), "string", text=value)
    if isinstance(value, datetime.datetime):
        return literal(value, "date")
    if isinstance(value, (bytes, bytearray)):
        return Val(F.lit(bytes(value)), "binary")
    if value is None:
        return Val(F.lit(None), "null")
    if hasattr(value, "date") and hasattr(value, "recorder"):  # a point in time
        return Val(F.struct(literal(value.date, "date").col.alias("date"), F.lit(value.recorder).alias("ref")), "point")
    if isinstance(value, Ref):
        return Val(F.lit(value.key), "ref", (value.target,))
    raise QueryError("parameter", f"a parameter of type {type(value).__name__}")


class Ref:
    """A reference as a parameter: an object's full name and a key."""

    def __init__(self, target: str, key):
        self.target, self.key = target, key


class Lower:
    """Expressions of one scope."""

    def __init__(self, engine, scope: Scope):
        self.engine, self.scope = engine, scope

    def __call__(self, e: ast.Node) -> Val:
        if self.scope.aggregates is not None:
            if isinstance(e, ast.Aggregate):
                return self.scope.aggregates[repr(e)]
            if (found := self.scope.grouped.get(group_name(e, self.scope))) is not None:
                return found
            if isinstance(e, ast.Path):
                raise QueryError("type", f"{'.'.join(e.parts)} is neither grouped nor aggregated", e.at)
        elif isinstance(e, ast.Aggregate):
            raise QueryError("type", f"{e.name} is not allowed here")
        if isinstance(e, (ast.Binary, ast.In, ast.Between, ast.Like, ast.IsNull)) and getattr(e, "op", "") not in ("AND", "OR", "+", "-", "*", "/"):
            if (found := self._through_section(e)) is not None:
                return found
        return getattr(self, f"on_{type(e).__name__.lower()}")(e)

    def _through_section(self, e: ast.Node) -> Val | None:
        """A predicate over a section's column holds for an owner if it holds for some row: EXISTS, the owner once."""
        if self.scope.aggregates is not None:
            return None
        paths = [(n, found) for n in ast.walk(e, False) if isinstance(n, ast.Path) and (found := self.engine.section_in(n, self.scope))]
        if not paths:
            return None
        if len({id(f[1]) for _, f in paths}) > 1:
            raise QueryError("unsupported", "several sections in one predicate")
        unnumbered(e, "a predicate over a section")
        src, child, _ = paths[0][1]
        rows, inner = self.engine.relation(child, "section")
        for n, (_, _, rest) in paths:
            n.parts = [inner.alias, *rest]
        sub = Scope(self.engine, rows, [inner], parent=self.scope)
        condition = Lower(self.engine, sub).condition(e)
        owner = F.col(inner.find("Ref").column) == F.col(src.find("Ref").column).outer()
        return Val(sub.df.where(owner & condition).exists(), "boolean")

    def condition(self, e: ast.Node) -> Column:
        v = self(e)
        if v.kind not in ("boolean", "null", "unknown"):
            raise QueryError("type", "a condition is needed")
        return v.col.cast("boolean") if v.kind == "null" else v.col

    # -- leaves ------------------------------------------------------------------------------
    def on_path(self, e: ast.Path) -> Val:
        return self.scope.path(e.parts, e.at)

    def on_literal(self, e: ast.Literal) -> Val:
        return literal(e.value, e.kind)

    def on_param(self, e: ast.Param) -> Val:
        return python_value(self.engine, self.engine.parameter(e.name))

    def on_value(self, e: ast.Value) -> Val:
        low = tuple(p.lower() for p in e.parts)
        if low in SYSTEM:
            return Val(F.lit(SYSTEM[low]), "number")
        if len(e.parts) == 3 and (obj := self.engine.model.find(e.parts[0], e.parts[1])):
            if low[2] in ("пустаяссылка", "emptyref"):
                return Val(F.lit(obj.empty_ref), "ref", (obj.full_name,))
            for name, key in obj.predefined.items():
                if name.lower() == low[2]:
                    return Val(F.lit(key), "ref", (obj.full_name,))
        raise QueryError("unknown_object", ".".join(e.parts))

    def on_typeof(self, e: ast.TypeOf) -> Val:
        return Val(self._type(e.parts), "type")

    def _type(self, parts: list[str]) -> Column:
        if len(parts) == 1 and parts[0].lower() in _NAMES:
            tag, no = TAGS[_NAMES[parts[0].lower()]], 0
        elif len(parts) == 1 and parts[0].upper() in ("NULL", "UNDEFINED", "НЕОПРЕДЕЛЕНО"):
            tag, no = (0 if parts[0].upper() == "NULL" else 1), 0
        else:
            tag, no = TAGS["ref"], self.engine.object_of(parts).type_no
        return F.struct(F.lit(tag).cast("tinyint").alias("tag"), F.lit(no).alias("type"))

    # -- operators ---------------------------------------------------------------------------
    def on_unary(self, e: ast.Unary) -> Val:
        if e.op == "NOT":
            if isinstance(e.value, ast.In) and e.value.query is not None and not isinstance(e.value.value, ast.Tuple):
                return self(dataclasses.replace(e.value, negated=not e.value.negated))
            return Val(~self.condition(e.value), "boolean")
        return Val(-self._number(e.value), "number")

    def _number(self, e: ast.Node) -> Column:
        v = self(e)
        if v.kind not in ("number", "null", "unknown"):
            raise QueryError("type", "a number is needed")
        return v.col

    def on_binary(self, e: ast.Binary) -> Val:
        if e.op in ("AND", "OR"):
            a, b = self.condition(e.left), self.condition(e.right)
            return Val(a & b if e.op == "AND" else a | b, "boolean")
        a, b = self(e.left), self(e.right)
        if e.op in "+-*/":
            if e.op == "+" and a.kind == b.kind == "string":
                return Val(F.concat(a.col, b.col), "string")
            if not {a.kind, b.kind} <= {"number", "null", "unknown"}:
                raise QueryError("type", f"{a.kind} {e.op} {b.kind}")
            return Val({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col, "/": a.col / b.col}[e.op], "number")
        return Val(self.compare(e.op, a, b), "boolean")

    def compare(self, op: str, a: Val, b: Val) -> Column:
        if "undefined" in (a.kind, b.kind):
            other = b if a.kind == "undefined" else a
            same = (other.col["tag"] == F.lit(1)) if other.kind == "composite" else _false()
            return same if op == "=" else ~same
        if "composite" in (a.kind, b.kind):
            if op not in ("=", "<>"):
                raise QueryError("unsupported", "order of composite values")
            x, y = self.engine.composite(a).col, self.engine.composite(b).col
            same = reduce(lambda p, q: p & q, [x[f].eqNullSafe(y[f]) for f in ("s", "n", "d", "l", "type", "ref")], x["tag"] == y["tag"])
            return same if op == "=" else ~same
        if a.kind == b.kind == "ref":
            if a.wide != b.wide or (a.targets != b.targets and not a.wide):
                a, b = self.engine.widened(a), self.engine.widened(b)
        elif "null" not in (a.kind, b.kind) and a.kind != b.kind and "unknown" not in (a.kind, b.kind):
            if "string" in (a.kind, b.kind) and {a.kind, b.kind} & {"number", "boolean", "date"}:
                return F.when(a.col.isNotNull() & b.col.isNotNull(), _false())
            if {a.kind, b.kind} != {"ref", "number"} and {a.kind, b.kind} != {"ref", "string"}:
                raise QueryError("type", f"{a.kind} {op} {b.kind}")
        x, y = a.col, b.col
        if op == "=" and a.kind == b.kind == "string":
            # Equality, and only equality, ignores trailing spaces.
            if a.text is None and b.text is None:
                return F.rtrim(x) == F.rtrim(y)
            return self._is_one_of(x, [b.text]) if b.text is not None else self._is_one_of(y, [a.text])
        return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    @staticmethod
    def _is_one_of(x: Column, texts: list[str]) -> Column:
        """Equality with constants without regard to trailing spaces; the test of the beginning reaches the scan."""
        texts = list(dict.fromkeys(t.rstrip(" ") for t in texts))
        begins = reduce(lambda p, q: p | q, [x.startswith(t) for t in texts])
        return begins & (F.rtrim(x) == F.lit(texts[0]) if len(texts) == 1 else F.rtrim(x).isin(texts))

    def on_between(self, e: ast.Between) -> Val:
        v, low, high = self(e.value), self(e.low), self(e.high)
        c = self.compare(">=", v, low) & self.compare("<=", v, high)
        return Val(~c if e.negated else c, "boolean")

    def on_like(self, e: ast.Like) -> Val:
        v, pattern = self(e.value), e.pattern
        text = pattern.value if isinstance(pattern, ast.Literal) else self.engine.parameter(pattern.name) if isinstance(pattern, ast.Param) else None
        if not isinstance(text, str):
            raise QueryError("unsupported", "a pattern that is no text or parameter")
        c = v.col.rlike(like_regex(text, e.escape))
        return Val(~c if e.negated else c, "boolean")

    def on_isnull(self, e: ast.IsNull) -> Val:
        v = self(e.value)
        return Val(v.col.isNotNull() if e.negated else v.col.isNull(), "boolean")

    def on_refs(self, e: ast.Refs) -> Val:
        v, target = self(e.value), self.engine.object_of(e.target)
        if v.kind == "composite":
            return Val((v.col["tag"] == F.lit(TAGS["ref"])) & (v.col["type"] == F.lit(target.type_no)), "boolean")
        if v.kind != "ref":
            return Val(_false(), "boolean")
        if not v.wide:
            return Val(F.when(v.col.isNotNull() | F.lit(True), F.lit(v.targets == (target.full_name,))), "boolean")
        return Val(v.col["type"] == F.lit(target.type_no), "boolean")

    # -- membership --------------------------------------------------------------------------
    def _items(self, items: list[ast.Node]) -> list[Val]:
        out = []
        for x in items:
            if isinstance(x, ast.Param) and isinstance(value := self.engine.parameter(x.name), (list, tuple, set)):
                out += [python_value(self.engine, v) for v in value]
            else:
                out.append(self(x))
        return out

    def on_in(self, e: ast.In) -> Val:
        if e.hierarchy or e.query is not None and (e.negated or isinstance(e.value, ast.Tuple)):
            unnumbered(e.value, "what is looked for in other rows")
        if e.hierarchy:
            return self._in_hierarchy(e)
        if isinstance(e.value, ast.Tuple):
            values = [self(x) for x in e.value.items]
            if e.query is None:
                raise QueryError("unsupported", "a tuple in a list")
            df, columns = self.engine.subquery(e.query, self.scope)
            if len(columns) != len(values):
                raise QueryError("type", "the tuple and the query differ in width")
            # EXISTS with equality of each part: nulls never match, and NOT is plain NOT EXISTS.
            same = reduce(lambda p, q: p & q, [self.compare("=", Val(v.col.outer(), v.kind, v.targets), c.val()) for v, c in zip(values, columns)])
            found = df.where(same).exists()
            return Val(~found if e.negated else found, "boolean")
        v = self(e.value)
        if e.query is not None:
            df, columns = self.engine.subquery(e.query, self.scope)
            if len(columns) != 1:
                raise QueryError("type", "the query must have one column")
            c = columns[0].val()
            if v.kind == "ref" == c.kind and v.wide != c.wide:
                v, c = self.engine.widened(v), self.engine.widened(c)
            elif "composite" in (v.kind, c.kind):
                v, c = self.engine.composite(v), self.engine.composite(c)
            if e.negated:
                return Val(self._not_in(v, df.select(c.col.alias("_in"))), "boolean")
            found = v.col.isin(df.select(c.col.alias("_in")))
        else:
            items = self._items(e.items)
            found = reduce(lambda p, q: p | q, [self.compare("=", v, i) for i in items]) if items else _false()
            if items and all(i.kind == v.kind and v.kind in ("number", "date") for i in items):
                found = v.col.isin([i.col for i in items])
            elif items and v.kind == "string" and all(i.text is not None for i in items):
                found = self._is_one_of(v.col, [i.text for i in items])
        return Val(~found if e.negated else found, "boolean")

    @staticmethod
    def _not_in(v: Val, found: DataFrame) -> Column:
        """NOT IN with its unknowns: an anti-join on equality, and two checks that do not depend on the row.

        Spark's own NOT IN would broadcast the query's whole result, whatever its size.
        """
        matched = found.where(F.col("_in") == v.col.outer()).exists()
        unknown = found.where(F.col("_in").isNull()).exists() | (v.col.isNull() & found.exists())
        return ~matched & F.when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(True))

    def _in_hierarchy(self, e: ast.In) -> Val:
        v = self(e.value)
        if v.kind != "ref":
            raise QueryError("type", "hierarchy of a value that is no reference")
        engine, found = self.engine, None
        engine.refuse("a descent of a hierarchy")
        for t in v.targets:
            obj = engine.object(t)
            base = engine.frame(obj)
            if e.query is not None:
                seeds, columns = engine.subquery(e.query, None)
                seeds = seeds.select(columns[0].val().col.alias("node")).distinct()
            else:
                items = self._items(e.items)
                if any(i.kind == "ref" and i.targets != (t,) for i in items):
                    items = [i for i in items if i.kind != "ref" or i.targets == (t,)]
                if not items:
                    continue
                seeds = engine.spark.range(1).select(F.explode(F.array_distinct(F.array(*[i.col for i in items]))).alias("node"))
            parent = obj.find("Parent")
            nodes = descendants(base.select(F.col("Ref").alias("id"), F.col("Parent").alias("parent")), seeds) if parent else seeds
            if v.wide:
                inside = nodes.where(F.col("node").cast("string") == v.col["ref"].outer()).exists() & (v.col["type"] == F.lit(obj.type_no))
            else:
                inside = nodes.where(F.col("node") == v.col.outer()).exists()
            found = inside if found is None else found | inside
        found = _false() if found is None else found
        return Val(~found if e.negated else found, "boolean")

    # -- choices and casts -------------------------------------------------------------------
    def on_case(self, e: ast.Case) -> Val:
        operand = self(e.operand) if e.operand is not None else None
        tests = [self.condition(w) if operand is None else self.compare("=", operand, self(w)) for w, _ in e.whens]
        vals = self.engine.unified([self(t) for _, t in e.whens] + ([self(e.otherwise)] if e.otherwise is not None else []))
        out = F.when(tests[0], vals[0].col)
        for test, v in zip(tests[1:], vals[1:]):
            out = out.when(test, v.col)
        if e.otherwise is not None:
            out = out.otherwise(vals[-1].col)
        first = next((v for v in vals if v.kind not in ("null", "undefined")), vals[0])
        return Val(out, first.kind, first.targets)

    def on_cast(self, e: ast.Cast) -> Val:
        v = self(e.value)
        name = e.target[0].lower()
        if len(e.target) == 1 and name in _NAMES:
            kind = _NAMES[name]
            col = v.col[{"string": "s", "number": "n", "date": "d", "boolean": "l"}[kind]] if v.kind == "composite" else v.col
            if kind == "string":
                col = col.cast("string")
                if e.sizes and e.sizes[0]:
                    col = F.substring(col, 1, e.sizes[0])
            elif kind == "number":
                col = col.cast(f"decimal({e.sizes[0]},{e.sizes[1] if len(e.sizes) > 1 else 0})") if e.sizes else col.cast("decimal(38,10)") if v.kind != "number" else col
            else:
                col = col.cast("boolean" if kind == "boolean" else dates.NTZ)
            return Val(col, kind)
        target = self.engine.object_of(e.target)
        if v.kind == "composite":
            guard, ref = (v.col["tag"] == F.lit(TAGS["ref"])) & (v.col["type"] == F.lit(target.type_no)), v.col["ref"]
        elif v.kind == "ref" and v.wide:
            guard, ref = v.col["type"] == F.lit(target.type_no), v.col["ref"]
        elif v.kind == "ref":
            out = Val(v.col if v.targets == (target.full_name,) else F.lit(None), "ref", (target.full_name,))
            guard = None
        else:
            out, guard = Val(F.lit(None), "ref", (target.full_name,)), None
        if guard is not None:
            kind = dict(self.engine.frame(target).dtypes)["Ref"]
            out = Val(F.when(guard, ref).try_cast(kind), "ref", (target.full_name,))
        for part in e.rest:
            out = self.scope.dereference(out, part)
        return out

    # -- calls -------------------------------------------------------------------------------
    def on_call(self, e: ast.Call) -> Val:
        n = e.name
        if n in ("BEGINOFPERIOD", "ENDOFPERIOD"):
            build = dates.begin_of if n == "BEGINOFPERIOD" else dates.end_of
            return Val(build(self(e.args[0]).col, self._unit(e.args[1])), "date")
        if n == "DATEADD":
            return Val(dates.add(self(e.args[0]).col, self._unit(e.args[1]), self._number(e.args[2])), "date")
        if n == "DATEDIFF":
            unit = self._unit(e.args[2])
            if unit in ("WEEK", "TENDAYS", "HALFYEAR"):
                raise QueryError("unsupported", f"DATEDIFF by {unit}", e.at)
            return Val(dates.difference(self(e.args[0]).col, self(e.args[1]).col, unit), "number")
        if n in dates.PARTS:
            v = self(e.args[0])
            if v.kind not in ("date", "null"):
                raise QueryError("type", f"{n} takes a date", e.at)
            return Val(dates.PARTS[n](v.col), "number")
        if n == "ISNULL":
            a, b = self.engine.unified([self(x) for x in e.args])
            first = a if a.kind not in ("null", "undefined") else b
            return Val(F.coalesce(a.col, b.col), first.kind, first.targets)
        if n == "VALUETYPE":
            return Val(self.engine.type_of(self(e.args[0])), "type")
        if n == "UUID":
            v = self(e.args[0])
            if v.kind != "ref" or not v.targets or not any(t and self.engine.binary_key(t) for t in v.targets):
                return Val(v.col["ref"] if v.wide else v.col.cast("string"), "uuid")
            digits = F.lower(v.col["ref"] if v.wide else F.hex(v.col))
            # Sixteen bytes are stored as d, e, c, b, a of a canonical a-b-c-d-e.
            groups = [F.substring(digits, at, n) for at, n in ((25, 8), (21, 4), (17, 4), (1, 4), (5, 12))]
            return Val(F.when(F.length(digits) == 32, F.concat_ws("-", *groups)).otherwise(digits), "uuid")
        if n in ("PRESENTATION", "REFPRESENTATION"):
            v = self(e.args[0])
            if v.kind == "ref":
                unnumbered(e, n)
            return self.scope.presentation(v)
        if n == "RECORDAUTONUMBER":
            # 1, 2, 3, ... by the partitions' counts, never in one task; ids by partition have gaps, also before the first row.
            return Val(InternalFunction.distributed_sequence_id() + 1, "number")
        args = [self(x) for x in e.args]
        if n == "ROUND":
            places = e.args[1] if len(e.args) > 1 else ast.Literal(0, "number")
            negative = isinstance(places, ast.Unary) and places.op == "-"
            places = places.value if negative else places
            if not isinstance(places, ast.Literal):
                raise QueryError("unsupported", "ROUND to computed places", e.at)
            return Val(F.round(args[0].col, -int(places.value) if negative else int(places.value)), "number")
        build, kind = CALLS[n]
        needs_text = n in ("SUBSTRING", "STRINGLENGTH", "TRIMALL", "TRIML", "TRIMR", "UPPER", "LOWER", "LEFT", "RIGHT", "STRFIND", "STRREPLACE")
        if args[0].kind not in (("string", "null", "unknown") if needs_text else ("number", "null", "unknown")):
            raise QueryError("type", f"{n} of {args[0].kind}", e.at)
        return Val(build(*[a.col for a in args]), kind)

    def _unit(self, e: ast.Node) -> str:
        if isinstance(e, ast.Path) and len(e.parts) == 1 and e.parts[0].upper() in UNITS:
            return UNITS[e.parts[0].upper()]
        raise QueryError("syntax", "a unit of dates is needed")


def unnumbered(e: ast.Node, where: str) -> None:
    """Spark numbers every child of the operator that holds the number; a join or an inner query would number other rows."""
    for n in ast.walk(e, False):
        if isinstance(n, ast.Call) and n.name == "RECORDAUTONUMBER":
            raise QueryError("unsupported", f"RECORDAUTONUMBER in {where}", n.at)


def group_name(e: ast.Node, scope: Scope) -> str:
    """The same for expressions that a grouping takes as one: paths by the column they lead to."""
    if isinstance(e, ast.Path):
        try:
            return "column " + str(scope.path(e.parts).col)
        except QueryError:
            return repr(e.parts)
    import copy
    import re

    return re.sub(r", at=\d+", "", repr(copy.copy(e)))


def composite_type() -> T.DataType:
    return T.StructType([T.StructField("tag", T.ByteType()), T.StructField("s", T.StringType()), T.StructField("n", T.DecimalType(38, 10)), T.StructField("d", T.TimestampNTZType()), T.StructField("l", T.BooleanType()), T.StructField("type", T.IntegerType()), T.StructField("ref", T.StringType())])
