"""Totals rows: overall, then for each control point its subtotal before its rows, the detail last."""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.hierarchy import ancestors


def _ordered(rows: DataFrame, order: list, materialize=None) -> DataFrame:
    """Number the rows in the query's order: sorted ranges with offsets, never one task for all.

    The numbers are compared between the levels, which are separate branches of the plan, so the
    numbered rows are materialised, or persisted (lazily) by default: all branches see the same ones.
    Ties in the order go by all columns, so a part that is lost and computed anew gets the same numbers.
    The call's number keeps the plan of one call apart from that of another, so none reads what
    another has persisted.
    """
    rows = rows.where(F.lit(next(_calls)) > 0)
    ties = [c for c, kind in rows.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    numbered = rows.orderBy(*order, *ties).withColumn("__rn", F.monotonically_increasing_id())
    if materialize:
        return materialize(numbered)
    numbered = numbered.persist(StorageLevel.MEMORY_AND_DISK)
    held.append(numbered)
    return numbered


held: list[DataFrame] = []
_calls = itertools.count(1)


def release() -> None:
    """Drop the rows that totals have persisted; call it when their results have been read."""
    while held:
        held.pop().unpersist()


def totals(rows: DataFrame, order: list, points: list[str], sums: dict[str, tuple[str, str]], overall: bool, level: bool = False, materialize=None) -> DataFrame:
    """sums: output column -> (function, input column). Rows come in the order of the totals tree."""
    df = _ordered(rows, order, materialize)
    columns = [c for c in df.columns if c != "__rn"]
    out_columns = columns + [c for c in sums if c not in columns]
    agg = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "COUNT": F.count}

    def measures() -> list:
        return [agg[f](F.col(c) if c else F.lit(1)).alias(f"__t_{out}") for out, (f, c) in sums.items()]

    firsts = [F.min("__rn").over(Window.partitionBy(*points[: i + 1])) for i in range(len(points))]
    pieces = []
    kinds = dict(rows.dtypes)
    empty = lambda c: F.lit(None).cast(kinds[c]) if c in kinds else F.lit(None)
    ranks = range(len(points))
    if overall:
        total = df.groupBy().agg(F.count("*").alias("__n"), *measures()).where("__n > 0")
        pieces.append(total.select(*[F.col(f"__t_{c}").alias(c) if c in sums else empty(c).alias(c) for c in out_columns], *[F.lit(0).cast("long").alias(f"__g{i}") for i in ranks], *[F.lit(0).alias(f"__f{i}") for i in ranks], F.lit(-1).cast("long").alias("__rn"), F.lit(0).alias("__level")))
    for i in ranks:
        keys = points[: i + 1]
        group = df.groupBy(*keys).agg(F.min("__rn").alias("__first"), *measures())
        for j in range(i):
            group = group.withColumn(f"__p{j}", F.min("__first").over(Window.partitionBy(*points[: j + 1])))
        group = group.withColumn(f"__p{i}", F.col("__first"))
        shown = [F.col(f"__t_{c}").alias(c) if c in sums else F.col(c) if c in keys else empty(c).alias(c) for c in out_columns]
        pieces.append(group.select(*shown, *[(F.col(f"__p{j}") if j <= i else F.lit(0)).cast("long").alias(f"__g{j}") for j in ranks], *[F.lit(int(j < i)).alias(f"__f{j}") for j in ranks], F.lit(-1).cast("long").alias("__rn"), F.lit(i + 1).alias("__level")))
    detail = df.select(*[F.col(c) if c in columns else F.lit(None).alias(c) for c in out_columns], *[f.cast("long").alias(f"__g{i}") for i, f in enumerate(firsts)], *[F.lit(1).alias(f"__f{i}") for i in ranks], "__rn", F.lit(len(points) + 1).alias("__level"))
    pieces.append(detail)
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    # The overall row comes first, whatever the groups' ranks.
    out = out.orderBy((F.col("__level") > 0).asc(), *[x for i in ranks for x in (F.col(f"__g{i}").asc(), F.col(f"__f{i}").asc())], "__rn")
    return out.select(*out_columns, *(["__level"] if level else []))


def hierarchical(rows: DataFrame, order: list, point: str, nodes: DataFrame, sums: dict[str, tuple[str, str]], overall: bool, only: bool, level: bool = False, materialize=None) -> DataFrame:
    """One hierarchical control point: every folder gets a row with the sums of its own and lower records, parents first."""
    df = _ordered(rows, order, materialize)
    columns = [c for c in df.columns if c != "__rn"]
    kinds = dict(rows.dtypes)
    agg = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "COUNT": F.count}
    measures = lambda: [agg[f](F.col(c) if c else F.lit(1)).alias(f"__t_{out}") for out, (f, c) in sums.items()]
    chain = ancestors(nodes.where("id is not null"))
    depth = chain.groupBy("leaf").agg(F.max("steps").alias("depth"))
    up = df.join(chain, F.col(point) == F.col("leaf"))
    if only:
        up = up.where("steps > 0")
    groups = up.groupBy("node").agg(F.min("__rn").alias("__first"), *measures())
    ranked = groups.join(depth, F.col("node") == F.col("leaf")).drop("leaf")
    # A node's path: the ranks of all its ancestors, from the root on.
    first = ranked.select(F.col("node").alias("n2"), F.col("__first").alias("r2"))
    paths = chain.join(first, chain["node"] == F.col("n2")).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), F.lpad(F.col("r2").cast("string"), 20, "0").alias("r")))).alias("p"))
    paths = paths.select(F.col("leaf").alias("l2"), F.array_join(F.transform("p", lambda x: x["r"]), "/").alias("__path"))
    shown = ranked.join(paths, F.col("node") == F.col("l2"))
    empty = lambda c: F.lit(None).cast(kinds[c])
    group_rows = shown.select(*[F.col("node").cast(kinds[c]).alias(c) if c == point else F.col(f"__t_{c}").alias(c) if c in sums else empty(c).alias(c) for c in columns], "__path", F.lit(0).alias("__f"), F.lit(-1).cast("long").alias("__rn"), (F.col("depth") + 1).alias("__level"))
    detail = df.join(paths, F.col(point) == F.col("l2"), "left").join(depth, F.col(point) == F.col("leaf"), "left")
    detail = detail.select(*columns, "__path", F.lit(2).alias("__f"), "__rn", (F.coalesce("depth", F.lit(0)) + 2).alias("__level"))
    out = group_rows.unionByName(detail)
    if overall:
        total = df.groupBy().agg(F.count("*").alias("__n"), *measures()).where("__n > 0")
        out = out.unionByName(total.select(*[F.col(f"__t_{c}").alias(c) if c in sums else empty(c).alias(c) for c in columns], F.lit("").alias("__path"), F.lit(-1).alias("__f"), F.lit(-1).cast("long").alias("__rn"), F.lit(0).alias("__level")))
    out = out.orderBy("__path", "__f", "__rn")
    return out.select(*columns, *(["__level"] if level else []))
