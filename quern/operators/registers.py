"""Register operators as plain DataFrame functions: slices, balances, turnovers, running balances.

A result has one row for each combination of the dimensions that the statement reads; unread
dimensions are summed away. Intervals are half-open, balances are strictly before their period,
slices include it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import begin_of

CALENDAR = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "TENDAYS", "MONTH", "QUARTER", "HALFYEAR", "YEAR")


def slice_of(rows: DataFrame, dims: list[str], period: str, bound: Column | None, last: bool) -> DataFrame:
    """The latest (or earliest) records of every combination of dims up to (from) the bound; ties all stay."""
    if bound is not None:
        rows = rows.where(F.col(period) <= bound if last else F.col(period) >= bound)
    order = F.col(period).desc_nulls_last() if last else F.col(period).asc_nulls_last()
    return rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*dims).orderBy(order))).where("_rank = 1").drop("_rank")


@dataclass
class Movements:
    """rows with dimensions, resources (name -> column), an optional record type (0 receipt, 1 expense) and activity."""

    rows: DataFrame
    dims: list[str]
    resources: dict[str, str]
    period: str = "Period"
    record_type: str | None = None
    active: str | None = None
    recorder: str | None = None
    line: str | None = None
    read: set[str] = field(default_factory=set)  # dimensions that the statement reads

    def live(self) -> DataFrame:
        return self.rows.where(F.col(self.active)) if self.active else self.rows

    def signed(self, c: str) -> Column:
        return F.when(F.col(self.record_type) == 0, F.col(c)).otherwise(-F.col(c)) if self.record_type else F.col(c)

    def part(self, c: str, kind: int) -> Column:
        return F.when(F.col(self.record_type) == kind, F.col(c)).otherwise(F.lit(0)) if self.record_type else (F.col(c) if kind == 0 else F.lit(0))

    @property
    def kept(self) -> list[str]:
        return [d for d in self.dims if d in self.read]


def between(period: str, begin: Column | None, end: Column | None) -> Column:
    out = F.lit(True)
    if begin is not None:
        out = out & (F.col(period) >= begin)
    return out & (F.col(period) < end) if end is not None else out


def balance(m: Movements, before: Column | None) -> DataFrame:
    """dims, <resource>Balance; combinations of all dimensions whose balances are all zero are dropped first."""
    rows = m.live()
    if before is not None:
        rows = rows.where(before)
    sums = [F.sum(m.signed(c)).alias(f"{r}Balance") for r, c in m.resources.items()]
    whole = rows.groupBy(*m.dims).agg(*sums)
    some = F.lit(False)
    for r in m.resources:
        some = some | (F.col(f"{r}Balance") != 0)
    whole = whole.where(some)
    if len(m.kept) == len(m.dims):
        return whole
    return whole.groupBy(*m.kept).agg(*[F.sum(f"{r}Balance").alias(f"{r}Balance") for r in m.resources])


def grain(m: Movements, periodicity: str | None, read: set[str]) -> list[tuple[str, Column]]:
    """Split columns (name, expression). Under AUTO the finest of what is read decides."""
    period, names = F.col(m.period), []
    if periodicity == "AUTO":
        if "LineNumber" in read:
            names = ["Period", "Recorder", "LineNumber"]
        elif "Recorder" in read or "Period" in read:
            names = ["Period", "Recorder"]
        else:
            unit = next((u for u in CALENDAR if f"Period{u}" in read), None)
            return [(f"Period{u}", begin_of(period, u)) for u in CALENDAR if f"Period{u}" in read] if unit else []
        out = [("Period", period)]
        out += [("Recorder", F.col(m.recorder))] if m.recorder else []
        out += [("LineNumber", F.col(m.line))] if m.line and "LineNumber" in names else []
        return out + [(f"Period{u}", begin_of(period, u)) for u in CALENDAR if f"Period{u}" in read]
    if periodicity in (None, "PERIOD"):
        return []
    if periodicity in ("RECORDER", "RECORD"):
        out = [("Period", period)] + ([("Recorder", F.col(m.recorder))] if m.recorder else [])
        return out + ([("LineNumber", F.col(m.line))] if periodicity == "RECORD" and m.line else [])
    return [("Period", begin_of(period, periodicity))]


def turnovers(m: Movements, begin: Column | None, end: Column | None, split: list[tuple[str, Column]]) -> DataFrame:
    """dims, split columns, <resource>Turnover, and Receipt and Expense if movements have a record type."""
    rows = m.live().where(between(m.period, begin, end))
    aggs = [F.sum(m.signed(c)).alias(f"{r}Turnover") for r, c in m.resources.items()]
    if m.record_type:
        aggs += [F.sum(m.part(c, k)).alias(f"{r}{n}") for r, c in m.resources.items() for k, n in ((0, "Receipt"), (1, "Expense"))]
    return rows.groupBy(*m.kept, *[e.alias(n) for n, e in split]).agg(*aggs)


def balance_and_turnovers(m: Movements, begin: Column | None, end: Column | None, split: list[tuple[str, Column]], balances_read: bool) -> DataFrame:
    """dims, split columns, <resource>Opening, Receipt, Expense, Turnover, Closing (with the suffix Balance for the first and last)."""
    rows = m.live()
    if end is not None:
        rows = rows.where(F.col(m.period) < end)
    inside = F.lit(True) if begin is None else F.col(m.period) >= begin
    if split and not balances_read:
        out = turnovers(m, begin, end, split)
        for r in m.resources:
            for n in ("OpeningBalance", "ClosingBalance"):
                out = out.withColumn(f"{r}{n}", F.lit(None).cast("decimal(38,6)"))
        return out
    zero = F.lit(0)
    parts = []
    for r, c in m.resources.items():
        parts += [F.sum(F.when(~inside, m.signed(c)).otherwise(zero)).alias(f"{r}OpeningBalance"), F.sum(F.when(inside, m.part(c, 0)).otherwise(zero)).alias(f"{r}Receipt")]
        parts += [F.sum(F.when(inside, m.part(c, 1)).otherwise(zero)).alias(f"{r}Expense"), F.sum(F.when(inside, m.signed(c)).otherwise(zero)).alias(f"{r}Turnover"), F.sum(m.signed(c)).alias(f"{r}ClosingBalance")]
    if not split:
        return rows.groupBy(*m.kept).agg(*parts)
    # Movements before the interval form one bucket, which opens the running sums and is then dropped.
    keys = [n for n, _ in split]
    first = F.lit(None)
    bucketed = rows.groupBy(*m.dims, inside.alias("_inside"), *[F.when(inside, e).otherwise(first).alias(n) for n, e in split]).agg(*parts)
    w = Window.partitionBy(*m.dims).orderBy(F.col("_inside").asc(), *[F.col(k).asc_nulls_first() for k in keys])
    for r in m.resources:
        net = F.col(f"{r}OpeningBalance") + F.col(f"{r}Turnover")
        bucketed = bucketed.withColumn(f"{r}ClosingBalance", F.sum(net).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        bucketed = bucketed.withColumn(f"{r}OpeningBalance", F.col(f"{r}ClosingBalance") - net)
    out = bucketed.where("_inside").drop("_inside")
    if len(m.kept) == len(m.dims):
        return out
    names = [f"{r}{n}" for r in m.resources for n in ("OpeningBalance", "Receipt", "Expense", "Turnover", "ClosingBalance")]
    return out.groupBy(*m.kept, *keys).agg(*[F.sum(n).alias(n) for n in names])
