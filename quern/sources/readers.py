"""Table readers: name -> DataFrame, for an Engine. All are lazy; filters and columns reach the scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{root}/{name}.parquet")


def orc(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.orc(f"{root}/{name}.orc")


def csv(spark: SparkSession, root: str, schemas: dict[str, str]) -> Callable[[str], DataFrame]:
    """Schemas are given, never inferred: inferring reads everything twice."""
    return lambda name: spark.read.schema(schemas[name]).csv(f"{root}/{name}.csv", header=True)


def jdbc(spark: SparkSession, url: str, partition: dict[str, tuple[str, int, int, int]] | None = None, **options: str) -> Callable[[str], DataFrame]:
    """partition: table -> (column, lower, upper, number of reads), so that a large table is read in parallel."""

    def read(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if partition and name in partition:
            column, low, high, n = partition[name]
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
        return reader.load()

    return read


def tables(spark: SparkSession, database: str = "default") -> Callable[[str], DataFrame]:
    return lambda name: spark.table(f"{database}.{name}")
