"""Calendar functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def begin_of(d: Column, unit: str) -> Column:
    """Start of the minute ... year that holds d; weeks start on Monday, ten-day parts on 1, 11 and 21."""
    if unit == "TENDAYS":
        return (F.date_trunc("MONTH", d) + F.make_dt_interval(F.least(F.floor((F.dayofmonth(d) - 1) / 10), F.lit(2)).cast("int") * 10)).cast(NTZ)
    if unit == "HALFYEAR":
        return F.when(F.month(d) > 6, F.date_trunc("YEAR", d) + F.expr("INTERVAL 6 MONTH")).otherwise(F.date_trunc("YEAR", d)).cast(NTZ)
    return F.date_trunc(unit, d).cast(NTZ)


def _step(unit: str) -> Column:
    return F.expr({"QUARTER": "INTERVAL 3 MONTH", "HALFYEAR": "INTERVAL 6 MONTH", "WEEK": "INTERVAL 7 DAY"}.get(unit, f"INTERVAL 1 {unit}"))


def end_of(d: Column, unit: str) -> Column:
    """The last second of the period that holds d."""
    second = F.expr("INTERVAL 1 SECOND")
    if unit == "TENDAYS":
        month_end = F.date_trunc("MONTH", d) + F.expr("INTERVAL 1 MONTH")
        return F.when(F.dayofmonth(d) > 20, month_end - second).otherwise(begin_of(d, unit) + F.expr("INTERVAL 10 DAY") - second).cast(NTZ)
    return (begin_of(d, unit) + _step(unit) - second).cast(NTZ)


def add(d: Column, unit: str, n: Column) -> Column:
    """Month ends clamp; n is rounded for short units and months, cut for the longer ones and ten-day parts."""
    whole = (F.round(n) if unit in ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH") else n).cast("int")
    if unit in ("SECOND", "MINUTE", "HOUR"):
        return (d + F.make_dt_interval(F.lit(0), *[whole if u == unit else F.lit(0) for u in ("HOUR", "MINUTE")], (whole if unit == "SECOND" else F.lit(0)).cast("decimal(18,6)"))).cast(NTZ)
    if unit in ("DAY", "WEEK", "TENDAYS"):
        return (d + F.make_dt_interval(whole * {"DAY": 1, "WEEK": 7, "TENDAYS": 10}[unit])).cast(NTZ)
    return (d + F.make_ym_interval(F.lit(0), whole * {"MONTH": 1, "QUARTER": 3, "HALFYEAR": 6, "YEAR": 12}[unit])).cast(NTZ)


def difference(a: Column, b: Column, unit: str) -> Column:
    """How many boundaries of the unit lie between a and b, with a sign."""
    if unit in ("SECOND", "MINUTE", "HOUR"):
        seconds = lambda d: F.unix_timestamp(F.date_trunc(unit, d).cast("timestamp"))
        return F.floor((seconds(b) - seconds(a)) / {"SECOND": 1, "MINUTE": 60, "HOUR": 3600}[unit]).cast("int")
    if unit == "DAY":
        return F.datediff(b, a)
    months = {"MONTH": lambda d: F.year(d) * 12 + F.month(d), "QUARTER": lambda d: F.year(d) * 4 + F.quarter(d), "YEAR": F.year}[unit]
    return months(b) - months(a)


def week(d: Column) -> Column:
    """The week that holds 1 January is the first; weeks start on Monday and the count restarts every year."""
    return F.floor((F.dayofyear(d) + F.weekday(F.date_trunc("YEAR", d)) - 1) / 7).cast("int") + 1


PARTS = {"YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "DAYOFYEAR": F.dayofyear, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": lambda d: F.second(d), "WEEKDAY": lambda d: F.weekday(d) + 1, "WEEK": week}
