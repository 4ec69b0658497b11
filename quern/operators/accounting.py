"""Accounting registers: every record is folded into a debit and a credit entry, then aggregated.

Debit and credit parts of a balance are taken at the grain that the statement reads; the expanded
parts are summed from the finest grain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.registers import between


@dataclass
class Entries:
    """Folded movements: side (0 debit, 1 credit), account, corresponding account, dims, resources, period."""

    rows: DataFrame
    dims: list[str]  # Account, ExtDimension<k>, balance dimensions, and correspondents if asked for
    resources: list[str]
    kept: list[str]


def fold(rows: DataFrame, shared: list[str], two_sided: dict[str, tuple[str, str]], resources: dict[str, tuple[str, str]], correspondents: dict[str, tuple[str, str]], active: str | None) -> DataFrame:
    """One row a side. two_sided and resources: name -> (debit column, credit column); correspondents see the other side."""
    if active:
        rows = rows.where(F.col(active))

    def side(k: int) -> Column:
        parts = [F.lit(k).alias("side")]
        parts += [F.col(c[k]).alias(n) for n, c in {**two_sided, **resources}.items()]
        parts += [F.col(c[1 - k]).alias(n) for n, c in correspondents.items()]
        return F.struct(*parts)

    # One pass over the records: the two sides are exploded, not scanned twice.
    both = rows.select(*shared, F.explode(F.array(side(0), side(1))).alias("_e"))
    return both.select(*shared, "_e.*")


def _net(r: str, where: Column | None = None) -> Column:
    value = F.when(F.col("side") == 0, F.col(r)).otherwise(-F.col(r))
    return F.sum(value if where is None else F.when(where, value).otherwise(F.lit(0)))


def _parts(df: DataFrame, name: str, total: str) -> DataFrame:
    t = F.col(total)
    return df.withColumn(f"{name}Dr", F.when(t > 0, t).otherwise(F.lit(0))).withColumn(f"{name}Cr", F.when(t < 0, -t).otherwise(F.lit(0)))


def balance(e: Entries, period: str, before: Column | None) -> DataFrame:
    """<r>Balance, BalanceDr, BalanceCr, SplittedBalanceDr, SplittedBalanceCr."""
    rows = e.rows if before is None else e.rows.where(before)
    whole = rows.groupBy(*e.dims).agg(*[_net(r).alias(f"{r}Balance") for r in e.resources])
    some = F.lit(False)
    for r in e.resources:
        some = some | (F.col(f"{r}Balance") != 0)
    whole = whole.where(some)
    for r in e.resources:
        whole = _parts(whole, f"{r}SplittedBalance", f"{r}Balance")
    names = [f"{r}{n}" for r in e.resources for n in ("Balance", "SplittedBalanceDr", "SplittedBalanceCr")]
    out = whole.groupBy(*e.kept).agg(*[F.sum(n).alias(n) for n in names]) if len(e.kept) < len(e.dims) else whole
    for r in e.resources:
        out = _parts(out, f"{r}Balance", f"{r}Balance")
    return out


def turnovers(e: Entries, period: str, begin: Column | None, end: Column | None, split: list[tuple[str, Column]]) -> DataFrame:
    """<r>Turnover, TurnoverDr, TurnoverCr."""
    aggs = []
    for r in e.resources:
        aggs += [_net(r).alias(f"{r}Turnover"), *[F.sum(F.when(F.col("side") == k, F.col(r)).otherwise(F.lit(0))).alias(f"{r}Turnover{n}") for k, n in ((0, "Dr"), (1, "Cr"))]]
    return e.rows.where(between(period, begin, end)).groupBy(*e.kept, *[x.alias(n) for n, x in split]).agg(*aggs)


def balance_and_turnovers(e: Entries, period: str, begin: Column | None, end: Column | None) -> DataFrame:
    """Opening and closing balances with their parts, and turnovers, over the whole interval."""
    rows = e.rows if end is None else e.rows.where(F.col(period) < end)
    inside = F.lit(True) if begin is None else F.col(period) >= begin
    aggs = []
    for r in e.resources:
        aggs += [_net(r, ~inside).alias(f"{r}OpeningBalance"), _net(r, inside).alias(f"{r}Turnover"), _net(r).alias(f"{r}ClosingBalance")]
        aggs += [F.sum(F.when(inside & (F.col("side") == k), F.col(r)).otherwise(F.lit(0))).alias(f"{r}Turnover{n}") for k, n in ((0, "Dr"), (1, "Cr"))]
    whole = rows.groupBy(*e.dims).agg(*aggs)
    for r in e.resources:
        for n in ("Opening", "Closing"):
            whole = _parts(whole, f"{r}{n}SplittedBalance", f"{r}{n}Balance")
    sums = [f"{r}{n}" for r in e.resources for n in ("OpeningBalance", "Turnover", "ClosingBalance", "TurnoverDr", "TurnoverCr", "OpeningSplittedBalanceDr", "OpeningSplittedBalanceCr", "ClosingSplittedBalanceDr", "ClosingSplittedBalanceCr")]
    out = whole.groupBy(*e.kept).agg(*[F.sum(n).alias(n) for n in sums])
    for r in e.resources:
        for n in ("Opening", "Closing"):
            out = _parts(out, f"{r}{n}Balance", f"{r}{n}Balance")
    return out


def running_balances(e: Entries, period: str, begin: Column | None, end: Column | None, split: list[tuple[str, Column]]) -> DataFrame:
    """balance_and_turnovers by buckets of the interval: balances run from one bucket of a combination to the next."""
    rows = e.rows if end is None else e.rows.where(F.col(period) < end)
    inside = F.lit(True) if begin is None else F.col(period) >= begin
    keys = [n for n, _ in split]
    aggs = []
    for r in e.resources:
        aggs += [_net(r).alias(f"{r}Turnover"), *[F.sum(F.when(F.col("side") == k, F.col(r)).otherwise(F.lit(0))).alias(f"{r}Turnover{n}") for k, n in ((0, "Dr"), (1, "Cr"))]]
    whole = rows.groupBy(*e.dims, inside.alias("_inside"), *[F.when(inside, x).alias(f"_k{i}") for i, (_, x) in enumerate(split)]).agg(*aggs)
    w = Window.partitionBy(*e.dims).orderBy("_inside", *[F.col(f"_k{i}").asc_nulls_first() for i in range(len(keys))])
    for r in e.resources:
        whole = whole.withColumn(f"{r}ClosingBalance", F.sum(f"{r}Turnover").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        whole = whole.withColumn(f"{r}OpeningBalance", F.col(f"{r}ClosingBalance") - F.col(f"{r}Turnover"))
    whole = whole.where("_inside")
    for r in e.resources:
        for n in ("Opening", "Closing"):
            whole = _parts(whole, f"{r}{n}SplittedBalance", f"{r}{n}Balance")
    sums = [f"{r}{n}" for r in e.resources for n in ("OpeningBalance", "Turnover", "ClosingBalance", "TurnoverDr", "TurnoverCr", "OpeningSplittedBalanceDr", "OpeningSplittedBalanceCr", "ClosingSplittedBalanceDr", "ClosingSplittedBalanceCr")]
    out = whole.groupBy(*e.kept, *[F.col(f"_k{i}").alias(n) for i, n in enumerate(keys)]).agg(*[F.sum(n).alias(n) for n in sums])
    for r in e.resources:
        for n in ("Opening", "Closing"):
            out = _parts(out, f"{r}{n}Balance", f"{r}{n}Balance")
    return out


def dr_cr_turnovers(rows: DataFrame, kept: list[str], resources: dict[str, Column], period: str, begin: Column | None, end: Column | None, split: list[tuple[str, Column]], active: str | None) -> DataFrame:
    """Turnovers between pairs of accounts; records are not folded."""
    if active:
        rows = rows.where(F.col(active))
    aggs = [F.sum(c).alias(n) for n, c in resources.items()]
    return rows.where(between(period, begin, end)).groupBy(*kept, *[x.alias(n) for n, x in split]).agg(*aggs)


def ext_dimension_values(df: DataFrame, keep: list[str], levels: list[tuple]) -> DataFrame:
    """One row for each value: Correspond (0 of the debit side, 1 of the credit side), Kind, Value. levels: (kind, debit column, credit column)."""
    cells = [F.struct(F.lit(side).alias("Correspond"), F.lit(kind).alias("Kind"), F.col(column).alias("Value")) for kind, *both in levels for side, column in enumerate(both)]
    rows = df.select(*keep, F.explode(F.filter(F.array(*cells), lambda x: x["Value"].isNotNull())).alias("_cell"))
    return rows.select(*keep, "_cell.*")
