"""Warm times of the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, beside those of DuckDB for the same SQL; prints one JSON line.

"queries" counts everything from the text to the last row: opening the tables, lowering, running.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import time

import duckdb
from pyspark.sql import SparkSession

from quern.catalog_queries import QUERIES, oracle_sql, queries
from quern.operators.totals import release
from quern.sample_model import engine

HEADLINE = ("select_top_orders", "dereference_deep", "joins", "in_query_correlated", "slice_last", "balance_at", "balance_pruned", "turnovers_month", "turnovers_auto", "balance_and_turnovers_day", "accounting_balance", "accounting_turnovers", "totals", "in_hierarchy", "batch_temp_tables")
RUNS = 3


def seconds_of(run) -> float:
    """The median of RUNS runs after one that warms up."""
    seconds = []
    for _ in range(RUNS + 1):
        began = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - began)
    return round(statistics.median(seconds[1:]), 4)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    known = queries()
    for name in HEADLINE:

        def run(name: str = name) -> None:
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            release()

        took[name] = seconds_of(run)
    con = duckdb.connect(config={"threads": int(cpus)})
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    beside = {name: seconds_of(lambda sql=oracle_sql()[name]: con.execute(sql).fetchall()) for name in HEADLINE}
    e = engine(spark, sf_dir)
    for name in HEADLINE:  # the tables are opened once for an engine
        e.query(*QUERIES[name][:2])
        e.temp.clear()
    began = time.perf_counter()
    for name in HEADLINE:
        text, params, _, _ = QUERIES[name]
        e.query(text, params)
        e.temp.clear()
    lowering = (time.perf_counter() - began) / len(HEADLINE)
    print(json.dumps({"metric": "warm_seconds_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "duckdb": beside, "lowering_sec_per_query": round(lowering, 4), "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
