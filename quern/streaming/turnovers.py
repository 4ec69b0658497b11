"""Turnovers over a stream of movements: calendar buckets behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_turnovers(movements: DataFrame, dims: list[str], resources: list[str], period: str = "Period", record_type: str | None = None, bucket: str = "1 day", late: str = "1 day", active: str | None = None) -> DataFrame:
    """Window, dims, <resource>Turnover (and Receipt, Expense with a record type); rows later than `late` are dropped."""
    rows = movements.where(F.col(active)) if active else movements
    rows = rows.withWatermark(period, late)
    aggs = []
    for r in resources:
        if record_type:
            receipt = F.col(record_type) == 0
            aggs += [F.sum(F.when(receipt, F.col(r)).otherwise(-F.col(r))).alias(f"{r}Turnover"), F.sum(F.when(receipt, F.col(r)).otherwise(F.lit(0))).alias(f"{r}Receipt"), F.sum(F.when(~receipt, F.col(r)).otherwise(F.lit(0))).alias(f"{r}Expense")]
        else:
            aggs.append(F.sum(r).alias(f"{r}Turnover"))
    grouped = rows.groupBy(F.window(period, bucket).alias("_w"), *dims).agg(*aggs)
    return grouped.select(F.col("_w.start").alias("Period"), *dims, *[c for c in grouped.columns if c not in ("_w", *dims)])
