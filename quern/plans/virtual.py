"""Virtual tables of registers: arguments to operators, results to named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.lang import ast
from quern.lang.diag import QueryError
from quern.lang.parser import UNITS
from quern.operators import accounting, registers
from quern.plans.scope import Scope, Src, Val, bind

#: Virtual tables, Russian and English (fixed values).
TABLES = dict(zip(
    "СРЕЗПОСЛЕДНИХ СРЕЗПЕРВЫХ ОСТАТКИ ОБОРОТЫ ОСТАТКИИОБОРОТЫ ОБОРОТЫДТКТ ДВИЖЕНИЯССУБКОНТО".split(),
    "SLICELAST SLICEFIRST BALANCE TURNOVERS BALANCEANDTURNOVERS DRCRTURNOVERS RECORDSWITHEXTDIMENSIONS".split(),
))
TABLES |= {v: v for v in list(TABLES.values())}
#: Russian endings of resource columns (fixed values).
ENDINGS = {
    "Balance": "Остаток", "Turnover": "Оборот", "Receipt": "Приход", "Expense": "Расход", "OpeningBalance": "НачальныйОстаток", "ClosingBalance": "КонечныйОстаток",
    "BalanceDr": "ОстатокДт", "BalanceCr": "ОстатокКт", "TurnoverDr": "ОборотДт", "TurnoverCr": "ОборотКт", "SplittedBalanceDr": "РазвернутыйОстатокДт", "SplittedBalanceCr": "РазвернутыйОстатокКт",
    "OpeningBalanceDr": "НачальныйОстатокДт", "OpeningBalanceCr": "НачальныйОстатокКт", "ClosingBalanceDr": "КонечныйОстатокДт", "ClosingBalanceCr": "КонечныйОстатокКт",
    "OpeningSplittedBalanceDr": "НачальныйРазвернутыйОстатокДт", "OpeningSplittedBalanceCr": "НачальныйРазвернутыйОстатокКт", "ClosingSplittedBalanceDr": "КонечныйРазвернутыйОстатокДт", "ClosingSplittedBalanceCr": "КонечныйРазвернутыйОстатокКт",
}
_PERIODS = {"SECOND": "Секунда", "MINUTE": "Минута", "HOUR": "Час", "DAY": "День", "WEEK": "Неделя", "TENDAYS": "Декада", "MONTH": "Месяц", "QUARTER": "Квартал", "HALFYEAR": "Полугодие", "YEAR": "Год"}
_ENGLISH = {"TENDAYS": "TenDays", "HALFYEAR": "HalfYear"}
_GRAINS = {"ПЕРИОД": "PERIOD", "PERIOD": "PERIOD", "РЕГИСТРАТОР": "RECORDER", "RECORDER": "RECORDER", "ЗАПИСЬ": "RECORD", "RECORD": "RECORD", "АВТО": "AUTO", "AUTO": "AUTO"} | UNITS
_COMPLETIONS = {"ДВИЖЕНИЯ", "ДВИЖЕНИЯИГРАНИЦЫПЕРИОДА", "MOVEMENTS", "MOVEMENTSANDPERIODBOUNDARIES"}


class Boundary:
    """A period argument that includes or excludes its moment; point: a (date, recorder) pair or a date."""

    def __init__(self, point, including: bool):
        self.point, self.including = point, including


class PointInTime:
    def __init__(self, date, recorder):
        self.date, self.recorder = date, recorder


class VirtualTable:
    def __init__(self, engine, obj, name: str, args: list[ast.Node | None] | None, used: set[str], alias: str):
        self.engine, self.obj, self.name, self.used, self.alias = engine, obj, name, used, alias
        self.args = args or []

    def arg(self, i: int) -> ast.Node | None:
        return self.args[i] if i < len(self.args) else None

    def check(self, most: int) -> None:
        if len(self.args) > most:
            raise QueryError("syntax", f"{self.name} takes at most {most} arguments")

    def period(self, i: int) -> Column | None:
        e = self.arg(i)
        if e is None:
            return None
        if any(isinstance(x, (ast.Path, ast.Aggregate)) and not (isinstance(x, ast.Path) and x.parts[0].upper() in UNITS) for x in ast.walk(e)):
            raise QueryError("unsupported", "a period that is not constant")
        from quern.plans.expressions import Lower

        v = Lower(self.engine, Scope(self.engine))(e)
        return None if v.kind in ("null", "undefined") else v.col

    def name_arg(self, i: int, allowed: dict[str, str], what: str) -> str | None:
        e = self.arg(i)
        if e is None:
            return None
        if isinstance(e, ast.Path) and len(e.parts) == 1 and e.parts[0].upper() in allowed:
            return allowed[e.parts[0].upper()]
        raise QueryError("type", f"{what} is needed")

    def filtered(self, *conditions: int) -> tuple[DataFrame, Src]:
        """The register's records under the table's own conditions, with the names of the model."""
        from quern.plans.expressions import Lower

        df, src = self.engine.relation(self.obj, "")
        scope = Scope(self.engine, df, [src])
        for i in conditions:
            if (e := self.arg(i)) is not None:
                condition = Lower(self.engine, scope).condition(e)
                scope.df = scope.df.where(condition)
        return scope.df, src

    def reads(self, names: tuple[str, ...]) -> bool:
        return any(n.lower() in self.used for n in names)

    def build(self) -> tuple[DataFrame, Src]:
        if self.obj.kind == "InformationRegister" and self.name in ("SLICELAST", "SLICEFIRST"):
            return self.slice()
        if self.obj.kind == "AccumulationRegister" and self.name in ("BALANCE", "TURNOVERS", "BALANCEANDTURNOVERS"):
            return self.accumulation()
        if self.obj.kind == "AccountingRegister" and self.name not in ("SLICELAST", "SLICEFIRST"):
            return self.accounting()
        raise QueryError("unsupported", f"{self.name} of {self.obj.full_name}")

    # -- information registers -----------------------------------------------------------------
    def slice(self) -> tuple[DataFrame, Src]:
        self.check(2)
        if self.arg(1) is not None and any(isinstance(x, ast.Path) and len(x.parts) > 1 for x in ast.walk(self.arg(1), False)):
            raise QueryError("unsupported", "a dereference in the condition of a slice")
        df, src = self.filtered(1)
        dims = [src.find(f.name).column for f in self.obj.by_purpose("dimension")]
        dims += [src.find(f).column for f in self.obj.separators.values()]
        out = registers.slice_of(df, dims, src.find("Period").column, self.period(0), self.name == "SLICELAST")
        src.alias = self.alias
        return out, src

    # -- accumulation registers ----------------------------------------------------------------
    def movements(self, df: DataFrame, src: Src) -> registers.Movements:
        obj = self.obj
        column = lambda n: b.column if (b := src.find(n)) else None
        dims = obj.by_purpose("dimension")
        return registers.Movements(
            df, [column(f.name) for f in dims], {f.name: column(f.name) for f in obj.by_purpose("resource")}, column("Period"), column("RecordType") if obj.register == "balance" else None,
            column("Active"), column("Recorder"), column("LineNumber"), {column(f.name) for f in dims if self.reads(f.names)},
        )

    def split_reads(self) -> set[str]:
        out = {n for n, more in (("Period", ("период", "period")), ("Recorder", ("регистратор", "recorder")), ("LineNumber", ("номерстроки", "linenumber"))) if self.used & set(more)}
        return out | {f"Period{u}" for u, ru in _PERIODS.items() if self.used & {f"период{ru}".lower(), f"period{_ENGLISH.get(u, u)}".lower()}}

    def accumulation(self) -> tuple[DataFrame, Src]:
        obj, n = self.obj, {"BALANCE": 2, "TURNOVERS": 4, "BALANCEANDTURNOVERS": 5}[self.name]
        self.check(n)
        df, src = self.filtered(n - 1)
        m = self.movements(df, src)
        if self.name == "BALANCE":
            if obj.register != "balance":
                raise QueryError("unsupported", "balances of a turnover register")
            out = registers.balance(m, self.before(m.period, m.recorder))
            endings, split = ["Balance"], []
        else:
            periodicity = self.name_arg(2, _GRAINS, "a periodicity")
            split = registers.grain(m, periodicity, self.split_reads())
            begin, end = self.period(0), self.period(1)
            if self.name == "TURNOVERS":
                out = registers.turnovers(m, begin, end, split)
                endings = ["Turnover"] + (["Receipt", "Expense"] if m.record_type else [])
            else:
                if obj.register != "balance":
                    raise QueryError("unsupported", "balances of a turnover register")
                self.name_arg(3, {c: c for c in _COMPLETIONS}, "a completion")
                endings = ["OpeningBalance", "Receipt", "Expense", "Turnover", "ClosingBalance"]
                read = any(self.reads(self._names(f, e)) for f in obj.by_purpose("resource") for e in ("OpeningBalance", "ClosingBalance"))
                out = registers.balance_and_turnovers(m, begin, end, split, read)
        dims = [f for f in obj.by_purpose("dimension") if self.reads(f.names)]
        return self.named(out, src, dims, split, [(f, e) for f in obj.by_purpose("resource") for e in endings])

    def before(self, period: str, recorder: str | None) -> Column | None:
        """Movements that count for a balance: strictly before a date; a point or boundary compares (date, recorder)."""
        e = self.arg(0)
        value = self.engine.parameter(e.name) if isinstance(e, ast.Param) else None
        including = False
        if isinstance(value, Boundary):
            including, value = value.including, value.point
            if not isinstance(value, PointInTime):
                from quern.plans.expressions import literal

                at = literal(value, "date").col
                return F.col(period) <= at if including else F.col(period) < at
        if isinstance(value, PointInTime):
            from quern.plans.expressions import literal

            at, key = literal(value.date, "date").col, F.lit(value.recorder)
            same = F.col(period) == at
            return (F.col(period) < at) | (same & (F.col(recorder) <= key if including else F.col(recorder) < key))
        bound = self.period(0)
        return None if bound is None else F.col(period) < bound

    @staticmethod
    def _names(f, ending: str) -> tuple[str, ...]:
        return tuple(n + e for n in f.names for e in (ending, ENDINGS[ending]))

    def named(self, out: DataFrame, src: Src, dims: list, split: list, results: list, extra: list = ()) -> tuple[DataFrame, Src]:
        """Results under their names: dimensions, split columns, then resource columns."""
        columns, picks = [], []
        for f in dims:
            b = src.find(f.name)
            columns.append((f.name, f.names, f.kind, f.targets))
            picks.append(F.col(b.column).alias(f.name))
        for name, names, kind, targets, column in extra:
            columns.append((name, names, kind, targets))
            picks.append(F.col(column).alias(name))
        for name, _ in split:
            unit = name[6:]
            names = {"Period": ("Период",), "Recorder": ("Регистратор",), "LineNumber": ("НомерСтроки", "LineNo")}.get(name) or (f"Период{_PERIODS[unit]}", f"Period{_ENGLISH.get(unit, unit.capitalize())}")
            b = src.find(name)
            kind, targets = ("date", ()) if name.startswith("Period") else (b.kind, b.targets)
            columns.append((name, names, kind, targets))
            picks.append(F.col(name))
        for f, ending in results:
            columns.append((f.name + ending, self._names(f, ending), "number", ()))
            picks.append(F.col(f.name + ending))
        df, result = bind(out.select(*picks), self.alias, columns, self.obj)
        return df, result

    # -- accounting registers ------------------------------------------------------------------
    def accounting(self) -> tuple[DataFrame, Src]:
        obj, ext = self.obj, self.obj.ext_dimensions > 0
        layout = {  # places of the arguments with extra dimensions; without them their places vanish
            "BALANCE": ("period", "account", "ext", "condition"),
            "TURNOVERS": ("begin", "end", "grain", "account", "ext", "condition", "coraccount", "corext"),
            "BALANCEANDTURNOVERS": ("begin", "end", "grain", "completion", "account", "ext", "condition"),
            "DRCRTURNOVERS": ("begin", "end", "grain", "account", "ext", "accountcr", "extcr", "condition"),
            "RECORDSWITHEXTDIMENSIONS": ("begin", "end", "condition", "order", "top"),
        }[self.name]
        slots = [s for s in layout if ext or not s.startswith(("ext", "corext"))]
        self.check(len(slots))
        at = {s: i for i, s in enumerate(slots)}
        given = {s: self.arg(i) for s, i in at.items() if self.arg(i) is not None}
        df, src = self.engine.relation(obj, "")
        column = lambda n: b.column if (b := src.find(n)) else None
        period, active = column("Period"), column("Active")
        resources = obj.by_purpose("resource")
        if self.name == "RECORDSWITHEXTDIMENSIONS":
            return self._records(df, src, given, at)
        sides = lambda f: (column(f"{f.name}Dr") or column(f.name), column(f"{f.name}Cr") or column(f.name))
        levels = range(1, obj.ext_dimensions + 1)
        if self.name == "DRCRTURNOVERS":
            return self._pairs(df, src, given, at, levels, period, active)
        two = {"Account": (column("AccountDr"), column("AccountCr"))}
        two |= {f"ExtDimension{k}": (column(f"ExtDimension{k}Dr"), column(f"ExtDimension{k}Cr")) for k in levels}
        dims = obj.by_purpose("dimension")
        two |= {f.name: sides(f) for f in dims if not f.balance}
        shared = [(f.name, column(f.name)) for f in dims if f.balance]
        correspondents = {"BalancedAccount": (column("AccountDr"), column("AccountCr"))} if self.name == "TURNOVERS" else {}
        if self.name == "TURNOVERS":
            correspondents |= {f"BalancedExtDimension{k}": (column(f"ExtDimension{k}Dr"), column(f"ExtDimension{k}Cr")) for k in levels}
        keep = [(n, c) for n, c in (("Period", period), ("Recorder", column("Recorder")), ("LineNumber", column("LineNumber"))) if c]
        base = df.select(*[F.col(c).alias(n) for n, c in keep + shared], *[c for n, c in (("a", active),) if c], *{c for pair in [*two.values(), *correspondents.values(), *map(sides, resources)] for c in pair if c})
        folded = accounting.fold(base, [n for n, _ in keep + shared], two, {f.name: sides(f) for f in resources}, correspondents, active)
        # Conditions see one side at a time.
        account = src.find("AccountDr")
        columns = [("Account", ("Счет",), account.kind, account.targets)]
        columns += [(f"ExtDimension{k}", (f"Субконто{k}",), src.find(f"ExtDimension{k}Dr").kind, src.find(f"ExtDimension{k}Dr").targets) for k in levels]
        columns += [(f.name, f.names, f.kind, f.targets) for f in dims] + [(f.name, f.names, f.kind, ()) for f in resources]
        if correspondents:
            columns += [("BalancedAccount", ("КорСчет",), account.kind, account.targets)]
            columns += [(f"BalancedExtDimension{k}", (f"КорСубконто{k}",), columns[k][2], columns[k][3]) for k in levels]
        columns += [(n, {"Period": ("Период",), "Recorder": ("Регистратор",), "LineNumber": ("НомерСтроки",)}[n], src.find(n).kind, src.find(n).targets) for n, _ in keep]
        columns += [("side", (), "number", ())]
        rows, view = bind(folded, self.alias, columns, None)
        scope = Scope(self.engine, rows, [view])
        from quern.plans.expressions import Lower

        for slot, rename in (("account", None), ("condition", None), ("coraccount", "BalancedAccount")):
            if slot in given:
                target = view
                if rename:
                    target = Src(self.alias, {**view.fields, "account": view.find(rename), "счет": view.find(rename)}, view.order)
                inner = Scope(self.engine, scope.df, [target], joined=scope.joined)
                condition = Lower(self.engine, inner).condition(given[slot])
                scope.df = inner.df.where(condition)
        back = scope.df.select(*[F.col(b.column).alias(b.name) for b in view.order])
        back = self._by_kinds(back, given.get("ext"), levels, "ExtDimension")
        names = [c for c in columns if c[0] in ("Account", "BalancedAccount") or c[0].startswith(("ExtDimension", "BalancedExtDimension")) or c[0] in {f.name for f in dims}]
        kept = [c for c in names if self.reads((c[0], *c[1]))]
        finest = [c[0] for c in names if not c[0].startswith("Balanced")]
        e = accounting.Entries(back, finest if self.name != "TURNOVERS" else [c[0] for c in names], [f.name for f in resources], [c[0] for c in kept])
        split = []
        if self.name == "BALANCE":
            out = accounting.balance(e, "Period", self._bound(at.get("period"), "Period"))
            endings = ["Balance", "BalanceDr", "BalanceCr", "SplittedBalanceDr", "SplittedBalanceCr"]
        elif self.name == "TURNOVERS":
            m = registers.Movements(back, [], {}, "Period", recorder="Recorder", line="LineNumber")
            split = registers.grain(m, self.name_arg(at["grain"], _GRAINS, "a periodicity"), self.split_reads())
            out = accounting.turnovers(e, "Period", self.period(at["begin"]), self.period(at["end"]), split)
            endings = ["Turnover", "TurnoverDr", "TurnoverCr"]
        else:
            m = registers.Movements(back, [], {}, "Period", recorder="Recorder", line="LineNumber")
            split = registers.grain(m, self.name_arg(at["grain"], _GRAINS, "a periodicity"), self.split_reads())
            self.name_arg(at["completion"], {c: c for c in _COMPLETIONS}, "a completion")
            begin, end = self.period(at["begin"]), self.period(at["end"])
            out = accounting.running_balances(e, "Period", begin, end, split) if split else accounting.balance_and_turnovers(e, "Period", begin, end)
            endings = [x for x in ENDINGS if x.startswith(("Opening", "Closing", "Turnover"))]
        result = [(c[0], c[1], c[2], c[3]) for c in kept]
        result += [(n, {"Period": ("Период",), "Recorder": ("Регистратор",), "LineNumber": ("НомерСтроки",)}.get(n) or (f"Период{_PERIODS[n[6:]]}",), "date" if n.startswith("Period") else src.find(n).kind, () if n.startswith("Period") else src.find(n).targets) for n, _ in split]
        result += [(f.name + x, self._names(f, x), "number", ()) for f in resources for x in endings]
        return bind(out, self.alias, result, self.obj)

    def _bound(self, i: int | None, period: str) -> Column | None:
        b = None if i is None else self.period(i)
        return None if b is None else F.col(period) < b

    def _by_kinds(self, df: DataFrame, listed: ast.Node | None, levels: range, name: str) -> DataFrame:
        """With listed kinds, level j holds the value of the level that has kind j; records without one go."""
        if listed is None:
            return df
        items = listed.items if isinstance(listed, ast.Tuple) else [listed]
        kinds = []
        for x in items:
            v = self.engine.parameter(x.name) if isinstance(x, ast.Param) else x.value if isinstance(x, ast.Literal) else None
            kinds += list(v) if isinstance(v, (list, tuple)) else [v]
        order = {k: i + 1 for i, k in enumerate(self.engine.ext_dimension_kinds(self.obj))}
        for j, kind in enumerate(kinds, 1):
            if kind not in order:
                raise QueryError("parameter", f"extra dimension kind {kind!r}")
            df = df.withColumn(f"_{name}{j}", F.col(f"{name}{order[kind]}")).where(F.col(f"{name}{order[kind]}").isNotNull())
        for k in levels:
            df = df.withColumn(f"{name}{k}", F.col(f"_{name}{k}") if k <= len(kinds) else F.lit(None)).drop(f"_{name}{k}")
        return df

    def _pairs(self, df, src, given, at, levels, period, active) -> tuple[DataFrame, Src]:
        from quern.plans.expressions import Lower

        scope = Scope(self.engine, df, [src])
        for slot, side in (("account", "AccountDr"), ("accountcr", "AccountCr"), ("condition", None)):
            if slot in given:
                seen = src if side is None else Src(src.alias, {**src.fields, "account": src.find(side), "счет": src.find(side)}, src.order)
                inner = Scope(self.engine, scope.df, [seen], joined=scope.joined)
                condition = Lower(self.engine, inner).condition(given[slot])
                scope.df = inner.df.where(condition)
        fields = [f for f in self.obj.fields if f.purpose == "dimension" or f.name in ("AccountDr", "AccountCr") or f.name.startswith("ExtDimension")]
        kept = [f for f in fields if self.reads(f.names)]
        m = registers.Movements(scope.df, [], {}, period, recorder=src.find("Recorder") and src.find("Recorder").column, line=src.find("LineNumber") and src.find("LineNumber").column)
        split = registers.grain(m, self.name_arg(at["grain"], _GRAINS, "a periodicity"), self.split_reads())
        results, sums = [], {}
        for f in self.obj.by_purpose("resource"):
            for ending, column in ([("Turnover", f.name)] if f.balance else [("TurnoverDr", f"{f.name}Dr"), ("TurnoverCr", f"{f.name}Cr")]):
                results.append((f, ending))
                sums[f.name + ending] = F.col(src.find(column).column)
        out = accounting.dr_cr_turnovers(scope.df, [src.find(f.name).column for f in kept], sums, period, self.period(at["begin"]), self.period(at["end"]), split, active)
        return self.named(out, src, kept, split, results)

    def _records(self, df, src, given, at) -> tuple[DataFrame, Src]:
        from quern.plans.expressions import Lower

        scope = Scope(self.engine, df, [src])
        scope.df = scope.df.where(registers.between(src.find("Period").column, self.period(at["begin"]), self.period(at["end"])))
        if "condition" in given:
            condition = Lower(self.engine, scope).condition(given["condition"])
            scope.df = scope.df.where(condition)
        if "top" in given:
            top = given["top"]
            n = self.engine.parameter(top.name) if isinstance(top, ast.Param) else top.value
            order = [F.col(src.find(n).column) for n in ("Period", "Recorder", "LineNumber") if src.find(n)]
            if "order" in given:
                items = given["order"].items if isinstance(given["order"], ast.Tuple) else [given["order"]]
                order = [Lower(self.engine, scope)(x).col.asc_nulls_last() for x in items]
            scope.df = scope.df.orderBy(*order).limit(int(n))
        src.alias = self.alias
        return scope.df, src
