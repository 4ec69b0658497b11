"""Adjacency-list hierarchies by recursive common table expressions. A cycle ends a walk, it is no error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_LIMIT, DEFAULT = "spark.sql.cteRecursionRowLimit", "1000000"


def _unlimited(df: DataFrame) -> None:
    """Spark's limit of a million rows would fail large trees; it is read when the query runs. A limit of the user's own stays."""
    conf = df.sparkSession.conf
    if conf.get(ROW_LIMIT, DEFAULT) == DEFAULT:
        conf.set(ROW_LIMIT, "-1")


def descendants(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and everything below them; nodes under several seeds repeat. nodes: (id, parent); seeds: (node), distinct.

    As a node has one parent, a walk down can only come back to where it began, and stops there.
    """
    _unlimited(nodes)
    n, s = nodes.where(F.col("parent").isNotNull()), seeds.where(F.col("node").isNotNull())
    return nodes.sparkSession.sql("WITH RECURSIVE h(seed, node) AS (SELECT node, node FROM {s} UNION ALL SELECT h.seed, c.id FROM {n} c JOIN h ON c.parent = h.node AND c.id <> h.seed) SELECT node FROM h", n=n, s=s)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(leaf, node, steps) for every node and itself (0 steps) and all above it, each once."""
    _unlimited(nodes)
    return nodes.sparkSession.sql("WITH RECURSIVE h(leaf, node, steps, path) AS (SELECT id, id, 0, array(id) FROM {n} UNION ALL SELECT h.leaf, c.parent, h.steps + 1, array_append(h.path, c.parent) FROM h JOIN {n} c ON c.id = h.node WHERE c.parent IS NOT NULL AND NOT array_contains(h.path, c.parent)) SELECT leaf, node, steps FROM h", n=nodes)
