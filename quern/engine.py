"""The session: a Spark session, a model and tables; query texts in, lazy DataFrames out."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.lang import ast
from quern.lang.diag import QueryError
from quern.lang.parser import parse, parse_restriction
from quern.model import SERVICE, STANDARD, Model, Object
from quern.operators import accounting
from quern.operators import totals as totals_op
from quern.plans import restrict
from quern.plans.expressions import TAGS, Lower, composite_type, group_name, literal, python_value, unnumbered
from quern.plans.scope import Bound, Scope, Src, Val, bind
from quern.plans.virtual import TABLES, VirtualTable

MAX_TEMP = 256  # fixed limit of the language
DENIED = False


def unique_labels(labels: list[str]) -> list[str]:
    """Labels that differ without regard to case: repeats get _2, _3, ..."""
    out, seen = [], set()
    for label in labels:
        new, k = label, 1
        while new.lower() in seen:
            k += 1
            new = f"{label}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


class Engine:
    """tables: name -> DataFrame. separators: separator -> value. restrictions: object's full name -> condition text, or DENIED.

    With restricted=True every statement is filtered, every object that it reads needs an entry in restrictions (None:
    unrestricted), and what cannot be filtered is refused: descents of hierarchies, hierarchical totals, constants,
    filter criteria, projected sections, and temporary tables from before. A rule's own reads are not restricted, and
    it sees session parameters only.
    """

    def __init__(self, spark: SparkSession, model: Model, tables: Callable[[str], DataFrame], session: dict[str, Any] | None = None, separators: dict[str, Any] | None = None, restrictions: dict[str, Any] | None = None, restricted: bool = False, ext_kinds: dict[str, list] | None = None, materialize: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.model, self.tables = spark, model, tables
        self.session, self.separators = dict(session or {}), dict(separators or {})
        self.restrictions, self.restricted, self.ext_kinds = dict(restrictions or {}), restricted, ext_kinds or {}
        self.materialize = materialize  # applied to every new temporary table, for instance DataFrame.checkpoint
        self.temp: dict[str, tuple[DataFrame, list[Bound]]] = {}
        self._params: dict[str, Any] = {}
        self._used: set[str] = set()
        self._allowed = False
        self._in_rule = False
        self._opened: dict[str, DataFrame] = {}
        self._frames: dict[tuple, DataFrame] = {}
        self._binary: dict[str, bool] = {}  # objects whose references are bytes
        self._unfiltered: set[str] = set()  # temporary tables made while the engine was not restricted

    # -- statements --------------------------------------------------------------------------
    def query(self, text: str, params: dict[str, Any] | None = None, totals_level: bool = False) -> DataFrame:
        """The result of the last statement of the text; temporary tables change only if all succeed."""
        return self.batch(text, params, totals_level)[-1]

    def batch(self, text: str, params: dict[str, Any] | None = None, totals_level: bool = False) -> list[DataFrame]:
        statements = parse(text)
        self._params, self._used = {k.lower(): v for k, v in (params or {}).items()}, set()
        if len(self._params) != len(params or {}):
            raise QueryError("parameter", "a parameter is bound twice")
        kept = dict(self.temp)
        try:
            out = [self._statement(s, totals_level) for s in statements]
            if unused := set(self._params) - self._used:
                raise QueryError("parameter", f"unused: {', '.join(sorted(unused))}")
            return out
        except Exception:
            self.temp = kept
            raise

    def parameter(self, name: str) -> Any:
        low = name.lower()
        if not self._in_rule:
            self._used.add(low)
            if low in self._params:
                return self._params[low]
        for k, v in self.session.items():
            if k.lower() == low:
                return v
        raise QueryError("parameter", f"{'session parameter ' if self._in_rule else ''}&{name} has no value")

    def refuse(self, what: str) -> None:
        """Some reads cannot be filtered."""
        if self.restricted and not self._in_rule:
            raise QueryError("unsupported", f"{what} under restrictions")

    def _statement(self, s: ast.Node, level: bool) -> DataFrame:
        if isinstance(s, ast.Drop):
            if self.temp.pop(s.name.lower(), None) is None:
                raise QueryError("temp_table", f"{s.name} does not exist")
            return self.spark.range(0).select(F.lit(0).cast("long").alias("Количество"))
        df, columns = self._query(s, None, top=True)
        if s.into or s.add:
            return self._store(s, df, columns)
        if s.totals:
            df, columns = self._totals(s, df, columns, level)
        return self._flat(df, columns, ["__level"] if s.totals and level else [])

    def _store(self, s: ast.Query, df: DataFrame, columns: list[Bound]) -> DataFrame:
        name = (s.into or s.add).lower()
        if s.into:
            if name in self.temp:
                raise QueryError("temp_table", f"{s.into} exists already")
            if len(self.temp) >= MAX_TEMP:
                raise QueryError("limit", f"more than {MAX_TEMP} temporary tables")
            for e in s.index:
                if not (isinstance(e, ast.Path) and any(c.name.lower() == e.parts[-1].lower() for c in columns)):
                    raise QueryError("unknown_field", "an index over what is no column")
            df = self.materialize(df) if self.materialize else df
            self.temp[name] = (df, columns)
            self._unfiltered.discard(name)
            if not self.restricted:
                self._unfiltered.add(name)
        else:
            if name not in self.temp:
                raise QueryError("temp_table", f"{s.add} does not exist")
            before, old = self.temp[name]
            if [(c.name.lower(), c.kind) for c in old] != [(c.name.lower(), c.kind) for c in columns]:
                raise QueryError("temp_table", f"{s.add} has another structure")
            self.temp[name] = (before.select(*[c.column for c in old]).unionAll(df.select(*[c.column for c in columns])), old)
        return df.agg(F.count("*").alias("Количество"))

    def _flat(self, df: DataFrame, columns: list[Bound], extra: list[str]) -> DataFrame:
        """Composite columns spread over their members; everything under its label."""
        out = []
        for c in columns:
            if c.kind == "composite":
                out += [F.col(c.column)[m].alias(f"{c.name}_{n}") for m, n in (("tag", "TYPE"), ("s", "S"), ("n", "N"), ("d", "T"), ("l", "L"), ("type", "RTRef"), ("ref", "RRRef"))]
            else:
                out.append(F.col(c.column).alias(c.name))
        return df.select(*out, *extra)

    # -- objects -----------------------------------------------------------------------------
    def object(self, full: str) -> Object:
        return self.model.by_full_name(full)

    def object_of(self, parts: list[str]) -> Object:
        found = self.model.find(parts[0], parts[1]) if len(parts) == 2 else None
        if found is None:
            raise QueryError("unknown_object", ".".join(parts))
        return found

    def ext_dimension_kinds(self, obj: Object) -> list:
        return self.ext_kinds.get(obj.full_name, list(range(1, obj.ext_dimensions + 1)))

    def table(self, name: str) -> DataFrame:
        """A table, opened once: opening reads footers and lists files, which costs more than lowering a statement."""
        if name not in self._opened:
            self._opened[name] = self.tables(name)
        return self._opened[name]

    def refresh(self) -> None:
        """Open the tables anew, to see files that were added since."""
        self._opened.clear()
        self._frames.clear()

    def frame(self, obj: Object) -> DataFrame:
        """The object's rows with the model's names; column pruning reaches the scan."""
        for separator in obj.separators:
            if separator not in self.separators:
                raise QueryError("separator", f"{separator} has no value")
        key = (obj.full_name, repr([self.separators[s] for s in obj.separators]))
        if key not in self._frames:
            base = obj.table(self.table) if callable(obj.table) else self.table(obj.table)
            for more in obj.extensions:
                base = base.unionByName(self.table(more), allowMissingColumns=True)
            for separator, name in obj.separators.items():
                base = base.where(F.expr(obj.find(name).sql) == F.lit(self.separators[separator]))
            self._frames[key] = base.select(*[F.expr(f.sql).alias(f.name) for f in obj.fields])
        return self._frames[key]

    def relation(self, obj: Object, alias: str, implicit: bool = False) -> tuple[DataFrame, Src]:
        """An object's rows under its rule. implicit: reached by a dereference, which ALLOWED alone does not filter."""
        df, src = bind(self.frame(obj), alias, [(f.name, f.names, f.kind, f.targets) for f in obj.fields], obj, exact=True)
        if self._in_rule:
            return df, src
        full = obj.full_name
        if self.restricted and full not in self.restrictions:
            raise QueryError("restriction", f"{full} has no decision")
        rule = self.restrictions.get(full)
        if rule is None or not (self._allowed and not implicit or self.restricted):
            return df, src
        if rule is DENIED:
            return df.where(F.lit(False)), src
        self._in_rule = True
        try:
            return restrict.apply(self, df, src, rule), src
        finally:
            self._in_rule = False

    # -- values ------------------------------------------------------------------------------
    def key_text(self, full: str, key: Column) -> Column:
        """A reference's key as text; of binary keys, their hexadecimal digits."""
        return F.hex(key) if self.binary_key(full) else key.cast("string")

    def binary_key(self, full: str) -> bool:
        if full not in self._binary:
            obj = self.object(full)
            self._binary[full] = obj.find("Ref") is not None and dict(self.frame(obj).dtypes)["Ref"] == "binary"
        return self._binary[full]

    def text(self, v: Val) -> Val:
        if v.kind == "date":
            return Val(F.date_format(v.col.cast("timestamp"), "dd.MM.yyyy HH:mm:ss"), "string")
        if v.kind == "boolean":
            return Val(F.when(v.col, "Да").when(~v.col, "Нет"), "string")
        if v.kind == "composite":
            return Val(F.coalesce(v.col["s"], v.col["n"].cast("string"), v.col["d"].cast("string"), v.col["l"].cast("string"), v.col["ref"]), "string")
        return Val((v.col["ref"] if v.wide else v.col).cast("string"), "string")

    def widened(self, v: Val) -> Val:
        if v.wide or v.kind != "ref":
            return v
        no = self.object(v.targets[0]).type_no
        return Val(F.when(v.col.isNotNull(), F.struct(F.lit(no).alias("type"), self.key_text(v.targets[0], v.col).alias("ref"))), "ref", (*v.targets, ""))

    def composite(self, v: Val) -> Val:
        if v.kind == "composite":
            return v
        if v.kind in ("null", "undefined"):
            return Val(F.lit(None).cast(composite_type()) if v.kind == "null" else self._tagged("undefined", {}), "composite")
        place = {"string": "s", "number": "n", "date": "d", "boolean": "l"}.get(v.kind)
        if v.kind == "ref":
            w = self.widened(v)
            filled = self._tagged("ref", {"type": w.col["type"], "ref": w.col["ref"]})
        elif place:
            filled = self._tagged(v.kind, {place: v.col})
        else:
            raise QueryError("type", f"{v.kind} in a composite value")
        return Val(F.when(v.col.isNotNull(), filled), "composite")

    @staticmethod
    def _tagged(kind: str, parts: dict[str, Column]) -> Column:
        return F.struct(*[(F.lit(TAGS[kind]) if f.name == "tag" else parts.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in composite_type()])

    def unified(self, vals: list[Val]) -> list[Val]:
        """Values of one kind as they are; references widened to one width; other mixtures composite."""
        real = [v for v in vals if v.kind not in ("null", "undefined", "unknown")]
        kinds = {v.kind for v in real}
        if len(kinds) > 1:
            return [self.composite(v) for v in vals]
        if kinds == {"ref"}:
            targets = tuple(sorted({t for v in real for t in v.targets if t}))
            if len(targets) > 1:
                return [Val(w.col, "ref", targets) if (w := self.widened(v)).kind == "ref" else v for v in vals]
        return vals

    def type_of(self, v: Val) -> Column:
        make = lambda tag, no=None: F.struct(F.lit(tag).cast("tinyint").alias("tag"), (F.lit(0) if no is None else no).cast("int").alias("type"))
        if v.kind == "composite":
            return F.when(v.col.isNull(), make(0)).otherwise(F.struct(v.col["tag"].alias("tag"), F.coalesce(v.col["type"], F.lit(0)).alias("type")))
        if v.kind == "ref":
            return F.when(v.col.isNull(), make(0)).otherwise(make(TAGS["ref"], v.col["type"] if v.wide else F.lit(self.object(v.targets[0]).type_no)))
        return F.when(v.col.isNull(), make(0)).otherwise(make(TAGS.get(v.kind, 0)))

    # -- queries -----------------------------------------------------------------------------
    def subquery(self, q: ast.Query, outer: Scope | None) -> tuple[DataFrame, list[Bound]]:
        if q.into or q.add or q.totals:
            raise QueryError("unsupported", "a temporary table or totals in a nested query")
        return self._query(q, outer, top=False)

    def _query(self, q: ast.Query, outer: Scope | None, top: bool) -> tuple[DataFrame, list[Bound]]:
        if len(q.branches) == 1:
            order = q.order if top or q.branches[0][0].top is not None else []
            return self._select(q.branches[0][0], order, outer, q)
        parts = [self._select(s, [], outer, q) for s, _ in q.branches]
        width = len(parts[0][1])
        if any(len(columns) != width for _, columns in parts):
            raise QueryError("type", "the parts of a union differ in width")
        aligned = [[] for _ in parts]
        bounds = []
        for i in range(width):
            vals = self.unified([columns[i].val() for _, columns in parts])
            first = next((v for v in vals if v.kind not in ("null", "undefined")), vals[0])
            bounds.append(Bound(parts[0][1][i].name, f"u{i}", first.kind, first.targets))
            for k, v in enumerate(vals):
                aligned[k].append(v.col.alias(f"u{i}"))
        out = parts[0][0].select(*aligned[0])
        for k, (_, every) in enumerate(q.branches[1:], 1):
            out = out.unionAll(parts[k][0].select(*aligned[k]))
            if not every:
                out = out.distinct()
        named, src = bind(out, "", [(b.name, (), b.kind, b.targets) for b in bounds], exact=True)
        if top and q.order:
            keys = []
            for e, down in q.order:
                b = src.find(e.parts[-1]) if isinstance(e, ast.Path) else None
                if b is None:
                    raise QueryError("unknown_field", "a union is ordered by its columns")
                keys.append(self._direction(F.col(b.column), down))
            named = named.orderBy(*keys)
        return named, src.order

    @staticmethod
    def _direction(c: Column, down: bool) -> Column:
        return c.desc_nulls_first() if down else c.asc_nulls_last()

    def _used_names(self, s: ast.Select, q: ast.Query, alias: str) -> set[str]:
        """Lower-case first segments that the statement takes from a source (outside the source's own arguments)."""
        out, low = set(), alias.lower()
        nodes = [e for e, _ in s.items] + [s.where, s.having] + s.group + [e for e, _ in q.order] + self._conditions(s.sources)
        if q.totals:
            nodes += [e for e, _ in q.totals.fields] + [e for e, _, _ in q.totals.points]
        for root in nodes:
            for n in ast.walk(root) if root is not None else ():
                if isinstance(n, ast.Path):
                    out.add((n.parts[1] if len(n.parts) > 1 and n.parts[0].lower() == low else n.parts[0]).lower())
                    if len(n.parts) > 2:
                        out.add(n.parts[2].lower()) if self.model.kind(n.parts[0]) else None
                elif isinstance(n, ast.Star) and (n.source is None or n.source.lower() == low):
                    out.add("*")
        return out

    def _conditions(self, sources: list[ast.Node]) -> list[ast.Node]:
        out, stack = [], list(sources)
        while stack:
            x = stack.pop()
            if isinstance(x, ast.Join):
                out.append(x.on)
                stack += [x.left, x.right]
        return out

    # -- sources -----------------------------------------------------------------------------
    def _source(self, x: ast.Source, s: ast.Select, q: ast.Query, outer: Scope | None) -> tuple[DataFrame, Src]:
        if x.query is not None:
            df, columns = self._query(x.query, None, top=False)
            if x.query.totals:
                raise QueryError("unsupported", "totals in a nested query")
            df, src = bind(df, x.alias, [(c.name, (), c.kind, c.targets) for c in columns], exact=True)
            return df, src
        if x.param is not None:
            return self._value_table(x)
        parts = x.parts
        if len(parts) == 1 and x.args is None:
            if parts[0].lower() in ("константы", "constants"):
                return self._constants(x.alias or parts[0], self._used_names(s, q, x.alias or parts[0]))
            found = self.temp.get(parts[0].lower())
            if found is None:
                raise QueryError("unknown_object", parts[0])
            if parts[0].lower() in self._unfiltered:
                self.refuse("a temporary table that was made without them")
            df, columns = found
            return bind(df, x.alias or parts[0], [(c.name, (), c.kind, c.targets) for c in columns], exact=True)
        obj = self.model.find(parts[0], parts[1]) if len(parts) > 1 else None
        if obj is None:
            raise QueryError("unknown_object", ".".join(parts))
        alias = x.alias or parts[-1]
        if obj.kind == "FilterCriterion":
            return self._criterion(obj, x, alias)
        if len(parts) == 2:
            if x.args is not None:
                raise QueryError("syntax", f"{'.'.join(parts)} takes no arguments")
            return self.relation(obj, alias)
        if (name := TABLES.get(parts[2].upper())) and obj.kind.endswith("Register"):
            used = self._used_names(s, q, alias)
            if "*" in used and not name.startswith("SLICE"):
                raise QueryError("unsupported", "* of a virtual table")
            return VirtualTable(self, obj, name, x.args, used, alias).build()
        if (child := obj.section(parts[2])) is not None:
            return self.relation(child, alias)
        if obj.ext_dimensions and parts[2].lower() in {n.lower() for n in ("ExtDimensions", *SERVICE["ExtDimensions"])}:
            return self._ext_values(obj, alias)
        raise QueryError("unknown_object", ".".join(parts))

    def _ext_values(self, obj: Object, alias: str) -> tuple[DataFrame, Src]:
        """The extra-dimension values of an accounting register's records, where the model names no table of them."""
        df, src = self.relation(obj, "")
        keep = [src.find(n) for n in ("Period", "Recorder", "LineNumber") if src.find(n)]
        levels = [(kind, src.find(f"ExtDimension{k}Dr"), src.find(f"ExtDimension{k}Cr")) for k, kind in enumerate(self.ext_dimension_kinds(obj), 1)]
        out = accounting.ext_dimension_values(df, [b.column for b in keep], [(kind, d.column, c.column) for kind, d, c in levels])
        columns = [(b.column, (b.name, *STANDARD[b.name]), b.kind, b.targets) for b in keep]
        value = levels[0][1]
        out, bound = bind(out, alias, columns + [("Correspond", ("RecordType", "ВидДвижения"), "number", ()), ("Kind", ("Вид",), "unknown", ()), ("Value", ("Значение",), value.kind, value.targets)])
        for b, own in zip(bound.order, keep):
            b.name = own.name
        return out, bound

    def checked_balance(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """A current balance that is read without ALLOWED under restrictions: the rows with __forbidden_row FALSE, or, if
        there is a balance that a rule hides, one row of nulls with __forbidden_row TRUE.

        Only one SELECT of plain fields from one accumulation register's Balance, without a period; its condition and
        the rule are equalities of a text dimension with a text or parameter. Data and check are one plan.
        """
        if not self.restricted:
            raise QueryError("restriction", "balances are checked under restrictions")
        statements = parse(text)
        q = statements[0]
        s = q.branches[0][0] if isinstance(q, ast.Query) else None
        x = s.sources[0] if s is not None and len(s.sources) == 1 else None
        parts = x.parts if isinstance(x, ast.Source) else []
        obj = self.model.find(*parts[:2]) if len(parts) == 3 else None
        plain = (
            len(statements) == 1 and s is not None and len(q.branches) == 1 and not (q.order or q.totals or q.into or q.add or q.index) and not (s.distinct or s.group or s.allowed) and s.top is None and s.where is None and s.having is None
            and obj is not None and obj.kind == "AccumulationRegister" and TABLES.get(parts[2].upper()) == "BALANCE" and all(isinstance(e, ast.Path) and (len(e.parts) == 1 or len(e.parts) == 2 and e.parts[0].lower() == (x.alias or "").lower()) for e, _ in s.items)
        )
        args = (x.args or []) if plain else []
        if not plain or (args and args[0] is not None):
            raise QueryError("restriction", "only a plain SELECT of a current balance is checked")
        for condition in args[1:]:
            self._dimension_equality(obj, condition)
        df = self.query(text, params)
        rule = self.restrictions.get(obj.full_name)
        if rule is None:
            return df.withColumn("__forbidden_row", F.lit(False))
        if rule is DENIED:
            opposite = None
        else:
            parsed = parse_restriction(rule)
            if parsed.alias or parsed.joins:
                raise QueryError("restriction", "only a plain equality of a dimension is checked")
            self._dimension_equality(obj, parsed.condition)
            opposite = f"NOT ISNULL({rule}, FALSE)"
        every = ast.Query([(dataclasses.replace(s, items=[(ast.Path([f.name]), None) for f in obj.by_purpose("dimension")]), False)])
        kept = self.restrictions
        self.restrictions = kept | {obj.full_name: opposite}
        try:
            self._params, self._used = {k.lower(): v for k, v in (params or {}).items()}, set()
            hidden, _ = self._query(every, None, top=True)
        finally:
            self.restrictions = kept
        found = hidden.select(F.lit(1)).exists()
        refused = self.spark.range(1).where(found).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes], F.lit(True).alias("__forbidden_row"))
        return df.withColumn("__forbidden_row", F.lit(False)).where(~found).unionAll(refused)

    def _dimension_equality(self, obj: Object, e: ast.Node | None) -> None:
        if e is None:
            return
        field = obj.find(e.left.parts[0]) if isinstance(e, ast.Binary) and e.op == "=" and isinstance(e.left, ast.Path) and len(e.left.parts) == 1 else None
        constant = field is not None and (isinstance(e.right, ast.Param) or isinstance(e.right, ast.Literal) and e.right.kind == "string")
        if not constant or field.purpose != "dimension" or field.kind != "string":
            raise QueryError("restriction", "only equalities of a text dimension are checked")

    def _value_table(self, x: ast.Source) -> tuple[DataFrame, Src]:
        table = self.parameter(x.param)
        if isinstance(table, DataFrame):
            df = table
        elif isinstance(table, ValueTable):
            df = self.spark.createDataFrame(table.rows, table.schema)
        else:
            raise QueryError("parameter", f"&{x.param} is no table")
        kinds = {"string": "string", "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date"}
        return bind(df, x.alias, [(c, (), kinds.get(t, "number" if t in ("int", "bigint", "double", "float") or t.startswith("decimal") else "unknown"), ()) for c, t in df.dtypes])

    def _constants(self, alias: str, used: set[str]) -> tuple[DataFrame, Src]:
        """One row, whatever was written; only constants that are used are read."""
        self.refuse("the source of constants")
        wanted = [c for c in self.model.constants() if used & {n.lower() for n in (c.name, *c.aliases)}]
        parts, fields = None, []
        for c in wanted:
            f = c.find("Value")
            one = self.frame(c).agg(F.max("Value").alias(c.name))
            parts = one if parts is None else parts.crossJoin(one)  # rows of one and one
            fields.append((c.name, c.aliases, f.kind, f.targets))
        return bind(parts if parts is not None else self.spark.range(1).select(F.lit(1).alias("_one")), alias, fields or [("_one", (), "number", ())])

    def _criterion(self, obj: Object, x: ast.Source, alias: str) -> tuple[DataFrame, Src]:
        if not x.args or len(x.args) != 1:
            raise QueryError("syntax", "a filter criterion takes one value")
        self.refuse("a filter criterion")
        value = Lower(self, Scope(self))(x.args[0])
        out, targets = None, tuple(dict.fromkeys(t for t, _ in obj.content))
        for full, name in obj.content:
            target = self.object(full)
            df, src = self.relation(target, "")
            hit = df.where(Lower(self, Scope(self)).compare("=", src.find(name).val(), value))
            part = hit.select(F.struct(F.lit(target.type_no).alias("type"), self.key_text(full, F.col(src.find("Ref").column)).alias("ref")).alias("Ref"))
            out = part if out is None else out.unionAll(part)
        return bind(out, alias, [("Ref", ("Ссылка",), "ref", targets if len(targets) > 1 else (*targets, ""))])

    def _from(self, x: ast.Node, s: ast.Select, q: ast.Query, outer: Scope | None, into: list[Src]) -> DataFrame:
        if isinstance(x, ast.Source):
            df, src = self._source(x, s, q, outer)
            if src.alias and any(o.alias.lower() == src.alias.lower() for o in into):
                raise QueryError("syntax", f"alias {src.alias} is repeated")
            into.append(src)
            return df
        own: list[Src] = []
        left = self._from(x.left, s, q, outer, own)
        right = self._from(x.right, s, q, outer, own)
        scope = Scope(self, left, own)
        if x.how == "full" and not self._equality(x.on):
            raise QueryError("unsupported", "a full join without an equality")
        unnumbered(x.on, "the condition of a join")
        condition = Lower(self, scope).condition(x.on)
        into += own
        return scope.df.join(right, condition, x.how)

    def _equality(self, e: ast.Node) -> bool:
        if isinstance(e, ast.Binary) and e.op == "AND":
            return self._equality(e.left) or self._equality(e.right)
        return isinstance(e, ast.Binary) and e.op == "="

    # -- one SELECT --------------------------------------------------------------------------
    def _select(self, s: ast.Select, order: list, outer: Scope | None, q: ast.Query) -> tuple[DataFrame, list[Bound]]:
        was, self._allowed = self._allowed, self._allowed or s.allowed
        try:
            return self._select_within(s, order, outer, q)
        finally:
            self._allowed = was

    def _select_within(self, s: ast.Select, order: list, outer: Scope | None, q: ast.Query) -> tuple[DataFrame, list[Bound]]:
        scope = Scope(self, parent=outer)
        for x in s.sources:
            part = self._from(x, s, q, outer, scope.sources)
            scope.df = part if scope.df is None else scope.df.crossJoin(part)
        if scope.df is None:
            scope.df = self.spark.range(1).select(F.lit(1).alias("_one"))
        lower = Lower(self, scope)
        if s.where is not None:
            condition = lower.condition(s.where)
            scope.df = scope.df.where(condition)
        items = self._expanded(s, scope)
        labels = unique_labels([a or self._label(e, i, scope) for i, (e, a) in enumerate(items)])
        by_label = {}
        for label, (e, _) in zip(labels, items):
            by_label.setdefault(label.lower(), e)
        keys = []
        for e, down in order:
            alone = isinstance(e, ast.Path) and len(e.parts) == 1 and e.parts[0].lower() in by_label
            keys.append((by_label[e.parts[0].lower()] if alone else e, down))
        roots = [e for e, _ in items] + ([s.having] if s.having is not None else []) + [e for e, _ in keys]
        aggregates = [n for r in roots for n in ast.walk(r, False) if isinstance(n, ast.Aggregate)]
        if s.group or aggregates or s.having is not None:
            self._group(s, scope, lower, roots, aggregates, by_label)
        if s.having is not None:
            scope.df = scope.df.where(lower.condition(s.having))
        vals = [self._projected(e, scope, lower) for e, _ in items]
        ordering = [self._direction(c, down) for e, down in keys for c in [self._sortable(lower(e))]]
        shown = [v.col.alias(f"c{i}") for i, v in enumerate(vals)]
        bounds = [(label, v) for label, v in zip(labels, vals)]
        df = scope.df
        if s.distinct:
            positions = []
            for (e, down) in keys:
                at = next((i for i, (x, _) in enumerate(items) if group_name(x, Scope(self, df, scope.sources)) == group_name(e, Scope(self, df, scope.sources))), None)
                if at is None:
                    raise QueryError("type", "ordering by what DISTINCT does not show")
                positions.append(self._direction(F.col(f"c{at}"), down))
            df = df.select(*shown).distinct()
            df = df.orderBy(*positions) if positions else df
        elif ordering:
            df = df.select(*shown, *[self._sortable(lower(e)).alias(f"o{i}") for i, (e, _) in enumerate(keys)])
            df = df.orderBy(*[self._direction(F.col(f"o{i}"), down) for i, (_, down) in enumerate(keys)])
        else:
            df = df.select(*shown)
        if s.top is not None:
            df = df.limit(s.top)
        if ordering and not s.distinct:
            df = df.select(*[f"c{i}" for i in range(len(vals))])
        out, src = bind(df, "", [(label, (), v.kind, v.targets) for label, v in bounds], exact=True)
        return out, src.order

    @staticmethod
    def _sortable(v: Val) -> Column:
        return v.col

    def _expanded(self, s: ast.Select, scope: Scope) -> list[tuple[ast.Node, str | None]]:
        out = []
        for e, alias in s.items:
            if isinstance(e, ast.Star):
                if e.source is None and (len(s.items) > 1 or len(scope.sources) != 1):
                    raise QueryError("unsupported", "* beside other columns or over several sources")
                src = scope.sources[0] if e.source is None else scope.source(e.source)
                if src is None:
                    raise QueryError("unknown_object", e.source)
                out += [(ast.Path([src.alias, b.name] if src.alias else [b.name]), b.name) for b in src.order]
            else:
                out.append((e, alias))
        return out

    def _label(self, e: ast.Node, i: int, scope: Scope) -> str:
        if isinstance(e, ast.Section):
            e = e.path
        if isinstance(e, ast.Path):
            parts = e.parts
            if len(parts) > 1 and scope.source(parts[0]):
                parts = parts[1:]
            elif len(parts) > 2 and self.model.kind(parts[0]):
                parts = parts[2:]
            return "".join(parts)
        return f"Поле{i + 1}"

    def _group(self, s: ast.Select, scope: Scope, lower: Lower, roots: list, aggregates: list, by_label: dict) -> None:
        keys: dict[str, Val] = {}
        for e in s.group:
            if isinstance(e, ast.Path) and len(e.parts) == 1 and e.parts[0].lower() in by_label and not any(src.find(e.parts[0]) for src in scope.sources):
                e = by_label[e.parts[0].lower()]
            v = lower(e)
            keys[group_name(e, scope)] = v
        grouped_paths = {tuple(p.lower() for p in e.parts) for e in s.group if isinstance(e, ast.Path)}
        # A dereference of a key belongs to the grouping.
        stack = list(roots)
        while stack:
            n = stack.pop()
            if isinstance(n, ast.Aggregate) or group_name(n, scope) in keys:
                continue
            if isinstance(n, ast.Path):
                low = tuple(p.lower() for p in n.parts)
                if any(low[:k] in grouped_paths for k in range(1, len(low))) or any(low[1 : k + 1] in grouped_paths for k in range(1, len(low))) or (len(low) > 1 and any(g[1:] == low[:k] for g in grouped_paths if len(g) > 1 for k in range(1, len(low)))):
                    keys[group_name(n, scope)] = lower(n)
                continue
            if isinstance(n, ast.Call) and n.name in ("PRESENTATION", "REFPRESENTATION"):
                inner = n.args[0]
                if group_name(inner, scope) in keys:
                    keys[group_name(n, scope)] = lower(n)
                    continue
            stack += [c for c in ast.children(n) if not isinstance(c, ast.Query)]
        named = {name: (f"g{i}", v) for i, (name, v) in enumerate(keys.items())}
        calls, found = [], {}
        for a in aggregates:
            if (key := repr(a)) in found:
                continue
            arg = lower(a.arg) if a.arg is not None else None
            column = f"a{len(found)}"
            if a.name == "COUNT":
                made = F.count(F.lit(1)) if arg is None else F.countDistinct(arg.col) if a.distinct else F.count(arg.col)
                kind, targets = "number", ()
            else:
                if a.name in ("SUM", "AVG") and arg.kind not in ("number", "unknown", "null"):
                    raise QueryError("type", f"{a.name} of {arg.kind}")
                made = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}[a.name](arg.col)
                kind, targets = (arg.kind, arg.targets) if a.name in ("MIN", "MAX") else ("number", ())
            calls.append(made.alias(column))
            found[key] = Val(F.col(column), kind, targets)
        grouping = scope.df.groupBy(*[v.col.alias(c) for c, v in named.values()])
        scope.df = grouping.agg(*calls) if calls else scope.df.select(*[v.col.alias(c) for c, v in named.values()]).distinct()
        scope.grouped = {name: Val(F.col(c), v.kind, v.targets) for name, (c, v) in named.items()}
        scope.aggregates = found

    # -- tabular sections in a projection ------------------------------------------------------
    def _section(self, e: ast.Path, scope: Scope) -> tuple[Src, Object] | None:
        src = scope.source(e.parts[0]) if len(e.parts) == 2 else scope.sources[0] if len(e.parts) == 1 and len(scope.sources) == 1 else None
        if src is None or src.obj is None or src.find(e.parts[-1]):
            return None
        child = src.obj.section(e.parts[-1])
        return (src, child) if child is not None else None

    def _projected(self, e: ast.Node, scope: Scope, lower: Lower) -> Val:
        if isinstance(e, ast.Section):
            if self._section(e.path, scope) is None:
                raise QueryError("unknown_field", ".".join(e.path.parts), e.path.at)
            return self._section_value(e.path, scope, e.fields)
        return self._section_value(e, scope) if isinstance(e, ast.Path) and self._section(e, scope) else lower(e)

    def section_in(self, e: ast.Path, scope: Scope) -> tuple[Src, Object, list[str]] | None:
        """The source, section and rest of a path that leads through a tabular section."""
        for k in range(1, len(e.parts)):
            found = self._section(ast.Path(e.parts[:k]), scope) if k <= 2 else None
            if found:
                return (*found, e.parts[k:])
        return None

    def _section_value(self, e: ast.Path, scope: Scope, only: list[str] | None = None) -> Val:
        """A section as an array of its rows, in the order of their numbers."""
        self.refuse("a projected section")
        src, child = self._section(e, scope)
        rows, inner = self.relation(child, "")
        owner, line = inner.find("Ref"), inner.find("LineNumber")
        fields = [b for b in inner.order if b is not owner and b is not line]
        if only is not None:
            if missing := [n for n in only if inner.find(n) is None]:
                raise QueryError("unknown_field", ", ".join(missing), e.at)
            fields = [b for n in only if (b := inner.find(n)) is not line]
        nested = rows.groupBy(F.col(owner.column).alias("_owner")).agg(F.array_sort(F.collect_list(F.struct(F.col(line.column).alias("LineNumber"), *[F.col(b.column).alias(b.name) for b in fields]))).alias(f"_n{line.column}"))
        scope.df = scope.df.join(nested, F.col(src.find("Ref").column) == nested["_owner"], "left").drop("_owner")
        return Val(F.coalesce(F.col(f"_n{line.column}"), F.array()), "nested")

    # -- totals ------------------------------------------------------------------------------
    def _totals(self, q: ast.Query, df: DataFrame, columns: list[Bound], level: bool) -> tuple[DataFrame, list[Bound]]:
        by_name = {c.name.lower(): c for c in columns}

        def column(e: ast.Node) -> Bound:
            found = by_name.get(e.parts[-1].lower()) if isinstance(e, ast.Path) else None
            if found is None:
                raise QueryError("unknown_field", "totals are over the result's columns")
            return found

        sums, out = {}, list(columns)
        for e, alias in q.totals.fields:
            if not isinstance(e, ast.Aggregate):
                raise QueryError("type", "totals take aggregates")
            target = column(e.arg) if e.arg is not None else None
            own = by_name.get(alias.lower()) if alias else target
            if own is None:
                own = Bound(alias or "Количество", f"t{len(sums)}", "number")
                out.append(own)
            sums[own.column] = (e.name, target.column if target else None)
        points = [column(e) for e, _, _ in q.totals.points]
        order = []
        for e, down in q.order:
            b = by_name.get(e.parts[-1].lower()) if isinstance(e, ast.Path) else None
            if b is not None:
                order.append(self._direction(F.col(b.column), down))
        trees = [i for i, (_, mode, _) in enumerate(q.totals.points) if mode != "plain"]
        if trees:
            self.refuse("hierarchical totals")
            if len(points) > 1 or points[0].kind != "ref" or len(points[0].targets) != 1:
                raise QueryError("unsupported", "hierarchical totals beside other points, or over what is no single reference")
            obj = self.object(points[0].targets[0])
            if obj.find("Parent") is None:
                raise QueryError("type", f"{obj.full_name} has no hierarchy")
            base = self.frame(obj).select(F.col("Ref").alias("id"), F.col("Parent").alias("parent"))
            made = totals_op.hierarchical(df, order, points[0].column, base, sums, q.totals.overall, q.totals.points[0][1] == "only", level, self.materialize)
        else:
            made = totals_op.totals(df, order, [p.column for p in points], sums, q.totals.overall, level, self.materialize)
        return made, out

    def release(self) -> None:
        """Free what totals of this process have persisted."""
        totals_op.release()

    # -- settings ----------------------------------------------------------------------------
    def setting(self, table: str, user: str, obj: str, key: str) -> DataFrame:
        """The stored value of one setting; two rows tell a caller that it is ambiguous. All three keys compare exactly."""
        df = self.table(table)
        same = (F.col("userid") == user) & (F.col("objectkey") == obj) & (F.col("settingskey") == key)
        return df.where(same).select("settingsdata").limit(2)

    # -- discovery ---------------------------------------------------------------------------
    def describe(self, text: str, params: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        """How the result's columns make up logical values: label, kind, targets, and the physical columns of each."""
        statements = parse(text)
        self._params, self._used = {k.lower(): v for k, v in (params or {}).items()}, set()
        kept = dict(self.temp)
        try:
            for s in statements[:-1]:
                self._statement(s, False)
            _, columns = self._query(statements[-1], None, top=True)
        finally:
            self.temp = kept
        members = ("TYPE", "S", "N", "T", "L", "RTRef", "RRRef")
        return [{"label": c.name, "kind": c.kind, "targets": [t for t in c.targets if t], "columns": [f"{c.name}_{m}" for m in members] if c.kind == "composite" else [c.name]} for c in columns]

    def field_usage(self, text: str) -> dict[str, set[str]]:
        """Field path -> the clauses that read it: projection, condition, grouping, ordering, join, argument."""
        out: dict[str, set[str]] = {}

        def note(role: str, root: ast.Node | None) -> None:
            for n in ast.walk(root, False) if root is not None else ():
                if isinstance(n, ast.Path):
                    out.setdefault(".".join(n.parts), set()).add(role)

        for q in (n for s in parse(text) for n in ast.walk(s) if isinstance(n, ast.Query)):
            for s, _ in q.branches:
                for e, _ in s.items:
                    note("projection", e)
                note("condition", s.where)
                note("condition", s.having)
                for e in s.group:
                    note("grouping", e)
                for e in self._conditions(s.sources):
                    note("join", e)
                for x in s.sources:
                    for n in ast.walk(x, False):
                        if isinstance(n, ast.Source):
                            for a in n.args or ():
                                note("argument", a)
            for e, _ in q.order:
                note("ordering", e)
        return out

    def prepare(self, text: str) -> dict[str, Any]:
        """Names of the parameters, objects and temporary tables that a text mentions, without lowering it."""
        statements = parse(text)
        params, objects, temps, fields = set(), set(), set(), set()
        for s in statements:
            for n in ast.walk(s):
                if isinstance(n, ast.Param):
                    params.add(n.name)
                elif isinstance(n, ast.Source):
                    if n.param:
                        params.add(n.param)
                    elif len(n.parts) > 1:
                        obj = self.model.find(n.parts[0], n.parts[1])
                        objects.add(obj.full_name if obj else ".".join(n.parts[:2]))
                    elif n.parts:
                        temps.add(n.parts[0])
                elif isinstance(n, ast.Path):
                    fields.add(".".join(n.parts))
        return {"parameters": sorted(params), "objects": sorted(objects), "temporary_tables": sorted(temps), "fields": sorted(fields)}


class ValueTable:
    """A typed table as a parameter: rows and a Spark schema string."""

    def __init__(self, rows: list, schema: str):
        self.rows, self.schema = rows, schema
