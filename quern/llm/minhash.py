"""Near-duplicates by circulant MinHash.

Two permutations of the 32-bit universe make a whole signature: the first scatters the shingles,
the second, circularly shifted by k, gives coordinate k. Bands of coordinates deal documents into
buckets. Each step keeps the volume linear in the rows:

1. Documents with equal shingle sets collapse to one representative.
2. Inside a bucket (in blocks, if it is large) signatures are compared; pairs whose estimate lies
   less than five standard deviations under the threshold are connected, and a spanning forest is
   all that leaves the task. Its components are the candidate groups.
3. The full sets of each candidate group first meet the group's head, in chunks; members that link
   to it need not be compared with each other. Those that do not meet each other and the linked
   ones in blocks bounded by rows and bytes, which verify the exact Jaccard similarity of all pairs
   and again emit a spanning forest, so no link between groups is lost.
4. Components of the verified links are the result.

The one probabilistic step is banding with the signature screen: with the default parameters a
pair at exactly the threshold is missed with a probability under 1e-5.

Edge cases: null, empty and blank texts have no shingles and link with nothing; repeated rows fall
into one group; null doc_ids count as larger than any id, and each such row is a document of its own; an empty table gives an empty result;
columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, cut, join_hot, own_name, small_batches, with_rid, written
from quern.llm.components import components
from quern.llm.words import WordHashes, mix, shingles

ROWS = 4  # coordinates of a band
BUCKET_BLOCK = 1024
SET_BLOCK = 256
SET_BYTES = 16 << 20  # of the sets of a block, on average


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signature(found: np.ndarray, k: int) -> np.ndarray:
    """h_j = min over shingles of pi((sigma(s) + j) mod 2^32)."""
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    shift = np.arange(k, dtype=np.uint32)[:, None]
    for i in range(0, len(found), 1024):
        sigma = _mix32((found[i : i + 1024] & np.uint64(0xFFFFFFFF)).astype(np.uint32) + np.uint32(0x27D4EB2F))
        np.minimum(out, _mix32((sigma[None, :] + shift) ^ np.uint32(0x165667B1)).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return h.view(np.int64)


def forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges (least member, member) of the components of a symmetric boolean matrix."""
    left, out = np.ones(len(ids), bool), []
    for i in np.argsort(ids, kind="stable"):
        if not left[i]:
            continue
        left[i] = False
        edge = linked[i] & left
        while edge.any():
            left &= ~edge
            at = np.flatnonzero(edge)
            out += [(ids[i], x) for x in ids[at]]
            edge = linked[at].any(axis=0) & left
    return out


def by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by keys; only a group that spans batches is held back."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:]):
            yield pd.concat([*held, pdf.iloc[a:b]]) if held else pdf.iloc[a:b]
            held = []
        held.append(pdf.iloc[starts[-1] :])
    if held:
        yield pd.concat(held)


def spread_by(rows: DataFrame, *keys: str, then: str | None = None) -> DataFrame:
    """Deal groups to tasks by their keys, sorted within, by one more column if given. The number of tasks is set, as Spark would merge them by
    bytes, and their work grows with the square of a group."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *([then] if then else []))


def in_blocks(rows: DataFrame, key: str, blocks: Column, node: str, columns: list[str]) -> DataFrame:
    """Deal the members of every group to all pairs of its blocks, sorted by (key, _i, _j) within partitions."""
    own = F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread_by(dealt.select(key, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), *columns), key, "_i", "_j")


def fingerprints(docs: DataFrame, size: int, k: int, rid: str | None = None) -> DataFrame:
    """doc_id, _rid (the numbers in column rid, or new ones), n, set_key, keys, sig for every document; keys and sig
    are null without shingles."""
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                n, set_key, keys, sig = [], [], [], []
                for text in batch.column("text").to_pylist():
                    found = shingles(text, size, hashes)
                    n.append(len(found))
                    if len(found):
                        full = signature(found, k)
                        set_key.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        keys.append(band_keys(full))
                        sig.append((full & np.uint32(255)).astype(np.uint8).tobytes())
                    else:
                        set_key.append(None), keys.append(None), sig.append(None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_rid"), pa.array(n, pa.int64()), pa.array(set_key, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "_rid", "n", "set_key", "keys", "sig"])

    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("_rid"))
    return written(rows.mapInArrow(read, "doc_id long, _rid long, n long, set_key binary, keys array<long>, sig binary"))


def _bucket_edges(rows: DataFrame, least: float) -> DataFrame:
    """rows: key, node, sig, m (members of the bucket). Spanning forests of the pairs that may be similar."""

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, ["key", "_i", "_j"]):
            ids = group["node"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(ids), -1)
            need = least * sig.shape[1]
            linked = np.empty((len(ids), len(ids)), bool)
            step = max(1, (4 << 20) // sig.size)
            for a in range(0, len(ids), step):
                linked[a : a + step] = (sig[a : a + step, None, :] == sig[None, :, :]).sum(axis=2) >= need
            if edges := forest(linked, ids):
                yield pd.DataFrame(edges, columns=["a", "b"])

    return in_blocks(rows, "key", F.ceil(F.col("m") / F.lit(BUCKET_BLOCK)), "node", ["node", "sig"]).mapInPandas(screen, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by a blocked product of 0/1 matrices (exact in float32 up to 2^24)."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), c := len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [c, len(sets[1])]])
    where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[where]
    out = np.zeros((n, n), np.int64)
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    width = max(256, (8 << 20) // max(n, 1))
    for a in range(0, len(shared), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((n, min(width, len(shared) - a)), np.float32)
        m[who[lo:hi], column[lo:hi] - a] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _like(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def blocks_of(count: Column, shingles: Column) -> Column:
    """How many blocks sets make, by their number and the number of all their shingles."""
    return F.ceil(F.greatest(count / F.lit(SET_BLOCK), shingles * 8 / F.lit(SET_BYTES))).cast("int")


def _verified(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets: cluster (its least node), node, _blocks (of the cluster), shingles. Edges that connect whatever is connected
    by pairs with den * intersection >= num * union."""
    sets = written(sets)
    # Every member against the head; a large group in several chunks, each with a copy of the head.
    own = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")))
    dealt = sets.select("cluster", F.explode(own).alias("_i"), (F.col("node") != F.col("cluster")).alias("_member"), "node", "shingles")

    def against_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, head = None, None
        for pdf in batches:
            out = []
            for cluster, chunk, member, node, packed in pdf[["cluster", "_i", "_member", "node", "shingles"]].itertuples(index=False):
                found = np.frombuffer(packed, np.uint64)
                if not member:
                    last, head = (cluster, chunk), found
                else:
                    out.append((cluster, node, last == (cluster, chunk) and _like(head, found, num, den), len(found)))
            if out:
                yield pd.DataFrame(out, columns=["cluster", "node", "linked", "n"])

    met = cut(spread_by(dealt, "cluster", "_i", then="_member").mapInPandas(against_head, "cluster long, node long, linked boolean, n long"))
    edges = met.where("linked").select(F.col("cluster").alias("a"), F.col("node").alias("b"))
    # The others among themselves, and with all that the head has: how many blocks both make in each group.
    part = lambda c: (F.sum(F.when(c, 1).otherwise(0)), F.sum(F.when(c, F.col("n")).otherwise(0)))
    sizes = met.groupBy("cluster").agg(blocks_of(*part(~F.col("linked"))).alias("_l"), blocks_of(*part(F.col("linked"))).alias("_r"), F.count("*").alias("_m")).where("_l > 0")
    plan = cut(join_hot(met.select("cluster", "node", "linked"), cut(sizes), "cluster", "_m", met.count()).drop("_m"))
    n = plan.count()
    if not n:
        return edges
    rows = sets.select("cluster", "node", "shingles").join(F.broadcast(plan) if n <= BROADCAST_ROWS else plan, ["cluster", "node"])
    lone, linked = rows.where("not linked"), rows.where("linked and _l > 0")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, ["cluster", "_i", "_j"]):
            group = group.drop_duplicates("node")
            ids, lone = group["node"].to_numpy(), group["_lone"].to_numpy()
            found = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            size = np.array([len(x) for x in found])
            both = overlaps(found)
            like = den * both >= num * (size[:, None] + size[None, :] - both)
            like |= ~lone[:, None] & ~lone[None, :]  # they are connected by the head
            if edges := forest(like, ids):
                yield pd.DataFrame(edges, columns=["a", "b"])

    among = in_blocks(lone, "cluster", F.col("_l"), "node", ["node", "shingles"]).withColumn("_lone", F.lit(True))
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = lone.where("_r > 0").select("cluster", block("_l").alias("_i"), every("_r").alias("_j"), "node", "shingles", F.lit(True).alias("_lone"))
    right = linked.select("cluster", every("_l").alias("_i"), block("_r").alias("_j"), "node", "shingles", F.lit(False).alias("_lone"))
    across = spread_by(left.unionByName(right), "cluster", "_i", "_j")
    schema = "a long, b long"
    return edges.unionAll(among.mapInPandas(verify, schema)).unionAll(across.mapInPandas(verify, schema))


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cluster, node, _blocks, shingles for the wanted representatives (doc_id, set_key, cluster, node, _blocks), from their whole texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [shingles(text, size, hashes).tobytes() for text in batch.column("text").to_pylist()]
                keys = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "set_key", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = wanted.select("doc_id").distinct()
    few = ids.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(ids) if few else ids, rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = rows.mapInArrow(read, "doc_id long, set_key binary, shingles binary")
    wanted = wanted.select("set_key", "node", "cluster", "_blocks", F.col("doc_id").alias("_id"))
    found = sets.join(F.broadcast(wanted) if few else wanted, (sets["set_key"] == wanted["set_key"]) & sets["doc_id"].eqNullSafe(wanted["_id"]))
    return found.select("cluster", "node", "_blocks", "shingles")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, bands: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Documents link where den * intersection >= num * union of their sets of size-word shingles.
    """
    out = grouped(docs, size, num, den, bands)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, bands: int = 24, rid: str | None = None) -> DataFrame:
    """_rid, doc_id, n_shingles, component_id, head (the number of the first row of the component by doc_id, then by
    number; null without shingles); one row for each row of docs."""
    k, t = bands * ROWS, num / den
    least = t - 5 * (t * (1 - t) / k) ** 0.5
    all_rows = fingerprints(docs, size, k, rid)
    # 1. One representative for each distinct set.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_rid").alias("rid")))
    classes = all_rows.where("n > 0").groupBy("set_key").agg(first.alias("first"), F.min("doc_id").alias("least"), F.min("n").alias("size"))
    classes = cut(classes.select("set_key", F.col("first.rid").alias("node"), "first.doc_id", "least", "size"))
    reps = all_rows.where("n > 0").join(classes.select("node"), F.col("_rid") == F.col("node"), "left_semi").select(F.col("_rid").alias("node"), "keys", "sig")
    # 2. Buckets with several members, and the forests of their likely pairs.
    keyed = reps.select("node", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = cut(keyed.join(several, "key"))
    rows = members.join(reps.select("node", "sig"), "node")
    likely = components(_bucket_edges(rows, least))
    # 3. The exact check on full sets.
    members = cut(likely.withColumnRenamed("component", "cluster").join(classes, "node"))
    sizes = cut(members.groupBy("cluster").agg(blocks_of(F.count("*"), F.sum("size")).alias("_blocks"), F.count("*").alias("m")))
    wanted = cut(join_hot(members, sizes, "cluster", "m", members.count()))
    groups = components(cut(_verified(_sets_of(docs, wanted, size), num, den)))
    # 4. The smallest doc_id of each component, for all rows of all its classes.
    found = classes.join(groups, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), "least", "node")
    head = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("node").alias("rid")))
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"), head.alias("head"))
    named = cut(found.join(ids, "component").select("set_key", "component_id", F.col("head.rid").alias("head")))
    out = all_rows.join(named, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("_rid", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "head")


def thin(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay, one row of each group, with all their columns.

    Rows without words stay. The row with the smallest doc_id stays, a row with a null doc_id only where the group
    has no other; of rows with that same doc_id any one. What befalls a row depends on its group, not on other rows
    of its doc_id.
    """
    rid = own_name(docs, "_rid")
    rows = written(with_rid(docs, rid))
    found = cut(grouped(rows, rid=rid, **how))
    gone = found.where(F.col("_rid") != F.col("head")).select(F.col("_rid").alias("_gone"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, rows[rid] == gone["_gone"], "left_anti").drop(rid)
