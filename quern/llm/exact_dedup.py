"""Exact deduplication with static binary-fuse filters.

The rows arrive in batches. A finished batch becomes an immutable snapshot: its first-seen
digests, dealt into hash buckets, each bucket with a static binary-fuse filter. A later batch
groups its own duplicates first; one row for each new digest is screened by the filters of the
same bucket, and only positives are joined with the snapshot's exact digests.

Within one table (classify) batches are drawn by a hash of the doc_id, and bytes are checked where all texts of a
class pass by: its least and its greatest text must be the same (pre-aggregated on the map side);
texts that share a digest but differ are grouped anew by their whole text. Between runs, snapshot()
keeps a text for each digest and can be saved and loaded; screen() compares the texts of positives byte by byte at the join.

Edge cases: null text counts as empty; null doc_ids come in the last batch, never win against an
id, and a class of null ids alone has keep_id null; of rows that repeat doc_id and text, one (in
row order) is kept; an empty table gives an empty result; other columns are neither read nor
returned, whatever their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, join_hot, own_name, with_rid
from quern.llm.fuse import BinaryFuse8

SPACES = r"[\x20\x09-\x0D]+"
BUCKET_KEYS = 65_536
BROADCAST_KEYS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, digest=lambda t: F.sha2(t, 256)) -> DataFrame:
    """One narrow row a document: doc_id, _rid, sha, h64. The texts go no further than the scan."""
    rows = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")))
    return rows.select("doc_id", "_rid", digest(normalised(F.col("text"))).alias("sha")).withColumn("h64", F.xxhash64("sha"))


class Snapshot:
    """Digests first seen in one batch, and their filters by bucket."""

    def __init__(self, rows: DataFrame, buckets: int | None = None, filters: DataFrame | None = None):
        """rows: sha, h64, keep (struct), n, perhaps text; one row a digest."""
        if filters is not None:
            self.rows, self.buckets, self.filters = rows, buckets, filters
            return
        self.rows = cut(rows)
        self.buckets = max(32, math.ceil(self.rows.count() / BUCKET_KEYS))

        def build(part: pd.DataFrame) -> pd.DataFrame:
            blob = BinaryFuse8.build(part["h64"].to_numpy()).dump()
            return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "filter": [blob]})

        keyed = self.rows.select(F.pmod("h64", F.lit(self.buckets)).alias("bucket"), "h64")
        self.filters = cut(keyed.groupBy("bucket").applyInPandas(build, "bucket long, filter binary"))

    def save(self, path: str) -> None:
        """Write rows and filters as Parquet; a snapshot never changes, so the folder must be new."""
        self.rows.write.parquet(f"{path}/rows")
        self.filters.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/filters")

    @classmethod
    def load(cls, spark, path: str) -> "Snapshot":
        filters = spark.read.parquet(f"{path}/filters")
        first = filters.select("buckets").first()
        return cls(spark.read.parquet(f"{path}/rows"), first["buckets"] if first else 32, filters.drop("buckets"))

    def positives(self, rows: DataFrame) -> DataFrame:
        """sha of the rows (sha, h64) that the filters let through: all that are held, and one in 256 others."""

        def screen(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(new) or not len(held):
                return pd.DataFrame({"sha": pd.Series([], dtype=str)})
            return new.loc[BinaryFuse8.load(held["filter"].iloc[0]).holds(new["h64"].to_numpy()), ["sha"]]

        keyed = rows.select("sha", "h64", F.pmod("h64", F.lit(self.buckets)).alias("bucket"))
        return keyed.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(screen, "sha string")


def _grouped(rows: DataFrame) -> DataFrame:
    """Duplicates within a batch; null ids come last."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_rid").alias("rid")))
    return rows.groupBy("sha").agg(F.first("h64").alias("h64"), least.alias("keep"), F.count("*").alias("n"))


def _owners(rows: DataFrame, batches: int) -> DataFrame:
    """One row a digest over all batches: sha, keep, n."""
    batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    snapshots, later = [], []
    for i in range(batches):
        new = cut(_grouped(rows.where(batch == i)))
        for k, old in enumerate(snapshots):
            passed = old.positives(new)
            hits = cut(new.join(passed, "sha").join(old.rows.select("sha"), "sha", "left_semi"))
            later[k].append(hits)
            new = new.join(hits.select("sha"), "sha", "left_anti")
        snapshots.append(Snapshot(new) if i < batches - 1 else new)
        later.append([])
    out = None
    for old, hits in zip(snapshots, later):
        own = (old.rows if isinstance(old, Snapshot) else old).select("sha", "keep", "n")
        for more in hits:
            more = more.select("sha", F.col("keep").alias("keep2"), F.col("n").alias("n2"))
            own = own.join(more, "sha", "left").select("sha", F.least("keep", "keep2").alias("keep"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        out = own if out is None else out.unionAll(own)
    return cut(out)


def _texts_of(docs: DataFrame, classes: DataFrame, digest) -> DataFrame:
    """doc_id, sha, text of the documents in the classes; without a shuffle of all texts while the classes are few."""
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", text.alias("text")).withColumn("sha", digest(F.col("text")))
    keys = classes.select("sha")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "sha", "left_semi")


def classify(docs: DataFrame, batches: int = 2, digest=lambda t: F.sha2(t, 256)) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs (columns doc_id and text)."""
    rows = cut(digests(docs, digest))
    owners = _owners(rows, batches)
    several = owners.where("n > 1").select("sha")
    texts = _texts_of(docs, several, digest)
    # The byte check: a class is sound if its least and its greatest text are the same.
    unsound = cut(texts.groupBy("sha").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("sha"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "sha"]
    sound = join_hot(rows, owners, "sha", "n", rows.count()).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_rid") == F.col("keep.rid")).alias("kept"), "sha")
    if unsound.count():
        sound = sound.join(unsound, "sha", "left_anti").select(columns)
        whole = cut(with_rid(_texts_of(docs, unsound, digest)))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_rid").alias("rid")))
        exact = whole.groupBy("sha", "text").agg(least.alias("keep"), F.count("*").alias("n"))
        sound = sound.unionAll(whole.join(exact, ["sha", "text"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_rid") == F.col("keep.rid")).alias("kept"), "sha"))
    return sound.withColumnRenamed("sha", "text_sha256")


def snapshot(docs: DataFrame, digest=lambda t: F.sha2(t, 256)) -> Snapshot:
    """A snapshot of a table to screen later ones with: every different text once, with the row that stays."""
    rows = digests(docs, digest).select("doc_id", "_rid", "sha", "h64")
    texts = docs.select(normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("sha", digest(F.col("text"))).groupBy("sha").agg(F.min("text").alias("text"), F.max("text").alias("_most"))
    kept = _grouped(rows).join(texts, "sha")
    if kept.where(F.col("text") != F.col("_most")).limit(1).count():
        raise ValueError("different texts share a digest: choose a stronger one")
    return Snapshot(kept.drop("_most"))


def screen(docs: DataFrame, held: list[Snapshot], digest=lambda t: F.sha2(t, 256)) -> DataFrame:
    """doc_id, text_sha256, snapshot (the first of those that hold the text, from 0; null if none), keep_id; one row for each row of docs."""
    rows = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text")))
    rows = cut(rows.withColumn("sha", digest(F.col("text"))).withColumn("h64", F.xxhash64("sha")))
    new, total, found = cut(rows.groupBy("sha").agg(F.first("h64").alias("h64"), F.count("*").alias("_n"))), rows.count(), None
    for k, old in enumerate(held):
        passed = old.positives(new).join(new.select("sha", "_n"), "sha")
        same = old.rows.select("sha", F.col("text").alias("_held"), F.col("keep.doc_id").alias("keep_id")).join(passed, "sha")
        hits = join_hot(rows, same, "sha", "_n", total).where(F.col("text") == F.col("_held"))
        hits = hits.select("_rid", F.struct(F.lit(k).alias("k"), "keep_id").alias("hit"))
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        return rows.select("doc_id", F.col("sha").alias("text_sha256"), F.lit(None).cast("int").alias("snapshot"), F.lit(None).cast("long").alias("keep_id"))
    first = found.groupBy("_rid").agg(F.min("hit").alias("hit"))
    return rows.join(first, "_rid", "left").select("doc_id", F.col("sha").alias("text_sha256"), F.col("hit.k").alias("snapshot"), "hit.keep_id")


def deduplicate(docs: DataFrame, batches: int = 2) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that repeat doc_id and text leave one."""
    found = cut(classify(docs, batches))
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_again")).distinct()
    sha = own_name(docs, "_sha256")
    marked = docs.withColumn(sha, F.sha2(normalised(F.col("text")), 256))

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
        return rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(gone["_id"]) & (F.col(sha) == gone["_sha"]), "left_anti")

    again = cut(dropped.where("_again").select("_id", "_sha"))
    out = without(marked, dropped.where("not _again").select("_id", "_sha"))
    if n := again.count():
        again = F.broadcast(again) if n <= BROADCAST_KEYS else again
        repeated = out.join(again, F.col("doc_id").cast("long").eqNullSafe(again["_id"]) & (F.col(sha) == again["_sha"]), "left_semi")
        out = without(out, again).unionByName(repeated.dropDuplicates(["doc_id", sha]))
    return out.drop(sha)


OP1_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
