"""What the operators share: tables, the shared folder, lineage cuts, doc_id folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new one only where it is unset and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in the shared folder, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in the shared folder, for tables of which later steps read few columns."""
    path = f"{shared_dir(df.sparkSession)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with table, which has one row a key and the number of its rows in `count`, of `total` in all.

    Keys of very many rows would gather in one task each. There are few of them (at most BROADCAST_ROWS by the choice
    of the limit), so they are broadcast, and only the rows of the others are shuffled.
    """
    hot = max(1000, total // BROADCAST_ROWS)
    hubs, rest = F.broadcast(table.where(F.col(count) > hot)), table.where(F.col(count) <= hot)
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(rest, key))


def clean(spark: SparkSession) -> None:
    """Delete the tables that written() has left; results that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers; texts may be very long. Tighter bounds of the user's own stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def with_rid(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows, so that repeated rows stay apart; cut or write the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
