"""Embedding near-duplicates by an exact metric range join.

Cosine at least t is an angle of at most theta = acos(t), and the angle is a metric. Pivots part
the unit vectors into cells (each vector belongs to its closest pivot). By the triangle inequality
a vector x of cell p can only link into cell q if angle(x, q) - angle(x, p) <= 2 theta and
angle(x, q) <= theta + radius(q); a pair is looked for in the lower-numbered of its two cells, so x is copied
to such cells with smaller numbers, and the cells join independently. A cell is dealt in blocks,
so that a hot cell is many tasks. Inside a block pair vectors are ordered by their angle to the
pivot, in rings: two rings that lie more than theta apart hold no pair. The others are multiplied in
single precision, all pairs near the threshold are decided in double precision, and what leaves the
task are link counts and spanning forests, not pairs.

Equal vectors collapse to one row with a count first, so copies are never multiplied out.

The pivots are a sample, chosen by hash, and only speed depends on them. How many there are grows
with the rows, up to their square root and PIVOTS: a second sample of SAMPLE vectors tells how often
a vector would be copied with more of them, and the number with the fewest bytes moved is taken. Where vectors
keep apart in clusters that is many, and each vector goes to few cells; where the triangle
inequality prunes nothing, few, and the join is one of blocks of all rows.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; null vec_ids count as larger than any id; repeated rows
are other vectors and link; an empty table gives an empty result; columns other than vec_id and
embedding are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, small_batches, with_rid
from quern.llm.components import components
from quern.llm.minhash import by_group, forest, spread_by

PIVOTS = 4096
SAMPLE = 2048
CELL = 8192  # vectors for each pivot, where more pivots do not pay
BLOCK = 8192  # vectors, and fewer where the tasks would not all have work
RING = 2048
SLACK = 1e-4  # over the error of single-precision products of unit vectors
ROUNDING = 1e-9  # over the error of angles in double precision


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def linked(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Boolean matrix of cosine >= t between rows, as in double precision."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    ux, uy = x / nx[:, None], y / ny[:, None]
    rough = ux.astype(np.float32) @ uy.astype(np.float32).T
    out = rough >= t + SLACK
    i, j = np.nonzero((rough >= t - SLACK) & ~out)
    for a in range(0, len(i), 65_536):
        ia, ja = i[a : a + 65_536], j[a : a + 65_536]
        c = (ux[ia] * uy[ja]).sum(axis=1)
        for k in np.flatnonzero(np.abs(c - t) < 1e-12):
            c[k] = exact_cosine(x[ia[k]], y[ja[k]])
        out[ia, ja] = c >= t
    return out


def matrix(column) -> np.ndarray:
    """Vectors as rows in double precision, scaled by powers of two, so that squares stay finite and nothing is rounded."""
    x = np.array(column.tolist(), float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reached(a: np.ndarray, cell: np.ndarray, radius: np.ndarray, theta: float) -> np.ndarray:
    """Which cells of smaller numbers each vector may link into. a: angles to the pivots."""
    own = a[np.arange(len(a)), cell]
    return (a - own[:, None] <= 2 * theta + ROUNDING) & (a <= theta + radius[None, :] + ROUNDING) & (np.arange(len(radius))[None, :] < cell[:, None])


def block_of(total: int, tasks: int) -> int:
    """Pairs of blocks should make at least so many tasks."""
    return min(BLOCK, max(512, math.ceil(total / math.ceil(math.sqrt(2 * tasks)))))


def pivots_for(total: int, chosen: np.ndarray, sample: np.ndarray, theta: float, block: int = BLOCK) -> np.ndarray:
    """As many of the chosen vectors as are expected to move the least: copies of a vector times the blocks that each meets."""
    best = None
    k = max(1, math.ceil(total / CELL))
    k = min(k, len(chosen))
    while True:
        a = np.arccos(np.clip(sample @ chosen[:k].T, -1, 1))
        cell = a.argmin(axis=1)
        radius = np.full(k, -np.inf)
        np.maximum.at(radius, cell, a[np.arange(len(a)), cell])
        copies = 1 + reached(a, cell, radius, theta).sum() / max(1, len(a))
        cost = copies * max(1.0, total / k / block)
        if best is None or cost < 0.9 * best[0]:
            best = (cost, k)
        if k >= len(chosen):
            return chosen[: best[1]]
        k = min(4 * k, len(chosen))


def _assigned(rows: DataFrame, pivots: np.ndarray, theta: float, kind: str) -> DataFrame:
    """node, cell, home, r, vec: each vector in its own cell, and copied to lower cells that it may link into; r is its angle to the cell's pivot."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def angles(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        a = np.arccos(np.clip(units(matrix(pdf["vec"])) @ sent.value.T, -1, 1))
        return a, a.argmin(axis=1)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, cell = angles(pdf)
                yield pd.DataFrame({"cell": cell, "radius": a[np.arange(len(a)), cell]}).groupby("cell", as_index=False)["radius"].max()

    radius = np.full(len(pivots), -np.inf)
    for r in rows.select("vec").mapInPandas(reach, "cell long, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # one row a pivot
        radius[r["cell"]] = r["radius"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a, cell = angles(pdf)
            i, q = np.nonzero(reached(a, cell, radius, theta))
            who, where = np.concatenate([np.arange(len(pdf)), i]), np.concatenate([cell, q])
            vecs = pdf["vec"].to_numpy()
            for at in range(0, len(who), 8192):
                w, c = who[at : at + 8192], where[at : at + 8192]
                yield pd.DataFrame({"node": pdf["node"].to_numpy()[w], "n": pdf["n"].to_numpy()[w], "vec": [vecs[k] for k in w], "cell": c, "home": cell[w] == c, "r": a[w, c]})

    return rows.mapInPandas(deal, f"node long, n long, vec array<{kind}>, cell long, home boolean, r double")


def _join_cells(dealt: DataFrame, sizes: list, t: float, block: int) -> DataFrame:
    """kind 0: (node, links found); kind 1: (node, another node of its component)."""
    spark, theta = dealt.sparkSession, math.acos(t)
    # At most two rows a pivot came to the driver: how many blocks a cell's own and copied vectors make.
    count = {(r["cell"], r["home"]): -(-r["count"] // block) for r in sizes}
    table = spark.createDataFrame([(c, count.get((c, True), 0), count.get((c, False), 0)) for c in sorted({c for c, _ in count})], "cell long, _h int, _r int")
    h, r = F.col("_h"), F.col("_r")
    at = F.pmod(F.xxhash64("node"), F.when(F.col("home"), h).otherwise(r)).cast("int")
    # Own blocks 0 .. h - 1 meet each other and the copies' blocks h .. h + r - 1; copies do not meet here.
    rows = dealt.join(F.broadcast(table), "cell").where(h > 0).withColumn("own", F.when(F.col("home"), at).otherwise(h + at).cast("int"))
    others = F.when(F.col("home"), F.sequence(F.lit(0), (h + r - 1).cast("int"))).otherwise(F.sequence(F.lit(0), (h - 1).cast("int")))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("cell", F.least("own", "other").alias("_i"), F.greatest("own", "other").alias("_j"), "own", "node", "n", "r", "vec")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, ["cell", "_i", "_j"]):
            i, j = int(group["_i"].iloc[0]), int(group["_j"].iloc[0])
            sides = [group[group["own"] == k].sort_values("r", kind="stable") for k in ((i,) if i == j else (i, j))]
            if not all(map(len, sides)):
                continue
            sides = [(s["node"].to_numpy(), s["n"].to_numpy(), s["r"].to_numpy(), matrix(s["vec"])) for s in sides]
            links = [np.zeros(len(s[0]), np.int64) for s in sides]
            edges: list[tuple[int, int]] = []
            one, two = sides[0], sides[-1]
            for a in range(0, len(one[0]), RING):
                for b in range(a if i == j else 0, len(two[0]), RING):
                    p, q = slice(a, a + RING), slice(b, b + RING)
                    if two[2][q][0] - one[2][p][-1] > theta + ROUNDING or one[2][p][0] - two[2][q][-1] > theta + ROUNDING:
                        continue
                    near = linked(one[3][p], two[3][q], t)
                    same = i == j and a == b
                    if same:
                        np.fill_diagonal(near, False)
                    if not near.any():
                        continue
                    links[0][p] += near @ two[1][q]
                    if not same:
                        links[-1][q] += near.T @ one[1][p]
                    edges += _forest_of(near, one[0][p], two[0][q], same)
            nodes, found = np.concatenate([s[0] for s in sides]), np.concatenate(links)
            if (some := found > 0).any():
                yield pd.DataFrame({"kind": 0, "a": nodes[some], "b": found[some]})
                yield pd.DataFrame([(1, int(x), int(y)) for x, y in edges], columns=["kind", "a", "b"])

    return spread_by(rows, "cell", "_i", "_j").mapInPandas(join, "kind int, a long, b long")


def _forest_of(near: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Spanning edges of the links between the rows and columns of a matrix."""
    k, m = near.any(axis=1), near.any(axis=0)
    if same:
        return forest(near[k][:, k], a[k])
    part = near[k][:, m]
    square = np.zeros((k.sum() + m.sum(),) * 2, bool)
    square[: k.sum(), k.sum() :] = part
    square[k.sum() :, : k.sum()] = part.T
    return forest(square, np.r_[a[k], b[m]])


def near_vectors(vectors: DataFrame, t: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of vectors (columns vec_id and embedding)."""
    spark, theta = vectors.sparkSession, math.acos(t)
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = with_rid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec")))
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    # + 0 makes -0.0 and 0.0 the same component.
    rows = cut(rows.withColumn("vec", F.when(sound, F.transform("vec", lambda v: v + F.lit(0).cast(kind)))))
    some = rows.where("vec is not null")
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("vec_id"), F.col("_rid").alias("rid")))
    keyed = some.withColumn("key", F.struct(F.size("vec").alias("d"), F.xxhash64(F.lit(1), F.col("vec")).alias("h1"), F.xxhash64(F.lit(2), F.col("vec")).alias("h2"), F.xxhash64(F.lit(3), F.reverse("vec")).alias("h3")))
    classes = cut(keyed.groupBy("key").agg(least.alias("first"), F.count("*").alias("n"), F.min("vec_id").alias("least")).select("key", F.col("first.rid").alias("node"), "n", "least"))
    named = cut(keyed.select("_rid", "vec_id", "key").join(classes.select("key", "node"), "key").select("_rid", "node"))
    reps = some.join(classes.select("node", "n"), F.col("_rid") == F.col("node")).select("node", "n", "vec")
    links = None
    for (dim,) in reps.select(F.size("vec")).distinct().collect():  # one row a vector length
        own = cut(reps.where(F.size("vec") == dim))
        total = own.count()
        most = min(PIVOTS, max(math.isqrt(total), math.ceil(total / CELL)))
        drawn = own.select("vec").orderBy(F.xxhash64("node")).limit(most + SAMPLE).toPandas()["vec"]  # at most PIVOTS + SAMPLE vectors
        drawn = units(matrix(drawn))
        block = block_of(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
        pivots = pivots_for(total, drawn[:most], drawn[most:], theta, block)
        dealt = cut(_assigned(own, pivots, theta, kind))
        found = _join_cells(dealt, dealt.groupBy("cell", "home").count().collect(), t, block)
        links = found if links is None else links.unionAll(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links)
    counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    groups = components(links.where("kind = 1"))
    found = classes.join(counts, "node", "left").join(groups, "node", "left")
    found = cut(found.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"), "least"))
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(ids, "component").join(named, "node").select("_rid", "n_links", "component_id", F.lit(True).alias("_found"))
    out = rows.join(found, "_rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
         THEN embedding::DOUBLE[] END AS e FROM embeddings),
 l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.e IS NOT NULL AND b.e IS NOT NULL AND list_cosine_similarity(a.e, b.e) >= 0.9),
 r AS (
  WITH RECURSIVE w(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a) SELECT a, min(b) AS c FROM w GROUP BY a)
SELECT r.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links, r.c AS component_id, r.a = r.c AS kept FROM r
"""
