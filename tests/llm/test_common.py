from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quern.llm import common


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context))


def test_tighter_batches_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for before, after in (("10000", "1024"), ("0", "1024"), ("100", "100")):
            spark.conf.set(key, before)
            common.small_batches(spark)
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, was)


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    got = common.join_hot(rows, table, "k", "n", 5000)
    assert sorted(map(tuple, got.select("k", "v", "n", "m").collect())) == sorted(map(tuple, rows.join(table, "k").select("k", "v", "n", "m").collect()))
    assert common.join_hot(rows.limit(0), table, "k", "n", 0).count() == 0
