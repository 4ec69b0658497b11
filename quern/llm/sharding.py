"""Range sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, doc_id, row), so copies of a text lie together and every
key is distinct. Splitters are quantiles of a sample of keys in which a record is drawn in
proportion to its size; records are range-partitioned by them. Ranges that come out overfull are
subdivided by splitters sampled inside them. Exact running sums within the ranges, and the ranges'
exact totals, then place the shard boundaries to the byte, so the shards' sizes differ by about one
record at most and do not depend on the sample.

Edge cases: null text has size 1 and the checksum of the empty text; null doc_ids come first among
copies; repeated rows get places of their own; an empty table gives an empty result; columns other
than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, with_rid

SHARDS = 8
RANGE_ROWS = 500_000  # rows of a range, on average, at scale
MIN_RANGES, MAX_RANGES = 64, 4096
SAMPLES = 24  # for each range
OVERFULL = 2.0  # times the mean size

Key = tuple[int, int, int]


def _key() -> Column:
    return F.struct(F.col("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("_rid"))


def _literal(key: Key) -> Column:
    return F.struct(F.lit(key[0]).cast("long").alias("h"), F.lit(key[1]).cast("long").alias("d"), F.lit(key[2]).cast("long").alias("_rid"))


def _sample(rows: DataFrame, weight: Column, wanted: int) -> list[tuple[Key, int]]:
    """Keys drawn with a probability in proportion to their size, by a hash of the row; about `wanted` of them."""
    draw = F.pmod(F.xxhash64("_rid", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(draw < weight * wanted).select(_key().alias("k"), "size").collect()
    return sorted((tuple(r["k"]), r["size"]) for r in found)


def _quantiles(keys: list[tuple[Key, int]], parts: int) -> list[Key]:
    return sorted({keys[len(keys) * i // parts][0] for i in range(1, parts)}) if keys else []


def _range_of(splitters: list[Key]) -> Column:
    """How many splitters are not above a row's key: found in two steps of about the square root each."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    heads = F.array(*[_literal(g[0]) for g in groups])
    inner = F.array(*[F.array(*map(_literal, g)) for g in groups])
    key = F.col("_key")
    coarse = F.size(F.filter(heads, lambda x: x <= key))
    fine = F.size(F.filter(F.element_at(inner, F.greatest(coarse, F.lit(1))), lambda x: x <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    rows = cut(with_rid(rows).withColumn("_key", _key()))
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = min(MAX_RANGES, max(MIN_RANGES, n // RANGE_ROWS))
    splitters = _quantiles(_sample(rows, F.col("size") / float(total), ranges * SAMPLES), ranges)
    for _ in range(4):
        placed = rows.withColumn("_range", _range_of(splitters).cast("int"))
        sums = {r["_range"]: (r["s"], r["c"]) for r in placed.groupBy("_range").agg(F.sum("size").alias("s"), F.count("*").alias("c")).collect()}  # one row a range
        over = {k: s for k, (s, c) in sums.items() if c > 1 and (s > OVERFULL * total / ranges or c > max(1000, 4 * n / ranges))}
        if not over:
            break
        heavy = F.create_map(*[F.lit(x) for k, s in over.items() for x in (k, max(float(s), 1.0))])
        inside = placed.where(F.col("_range").isin(*over))
        # Half by size, half by rows, so that a crowd of tiny records is split too.
        crowd = F.create_map(*[F.lit(x) for k in over for x in (k, float(sums[k][1]))])
        found = _sample(inside, (F.col("size") / heavy[F.col("_range")] + 1 / crowd[F.col("_range")]) / 2, SAMPLES * 8)
        splitters = sorted({*splitters, *_quantiles(found, max(2, min(len(found), 8 * len(over))))})
    # Exact offsets of every range, then of every row within its range.
    before, bytes_so_far, rows_so_far = [], 0, 0
    for k in range(len(splitters) + 1):
        s, c = sums.get(k, (0, 0))
        before.append((bytes_so_far, rows_so_far))
        bytes_so_far, rows_so_far = bytes_so_far + s, rows_so_far + c
    offset = lambda i: F.element_at(F.array(*[F.lit(b[i]).cast("long") for b in before]), F.col("_range") + 1)
    w = Window.partitionBy("_range").orderBy("h", F.asc_nulls_first("doc_id"), "_rid")
    ordered = placed.withColumn("_sum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(w))
    # A record belongs to the shard that holds the middle of it.
    middle = 2 * (offset(0) + F.col("_sum")) - F.col("size")
    ordered = ordered.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)"))).cast("int"))
    ordered = cut(ordered.select("doc_id", "size", "text_crc32", "shard", (offset(1) + F.col("_row") - 1).alias("_place")))
    starts = {r["shard"]: r["p"] for r in ordered.groupBy("shard").agg(F.min("_place").alias("p")).collect()}  # one row a shard
    start = F.create_map(*[F.lit(x) for k, p in starts.items() for x in (k, p)])[F.col("shard")]
    return ordered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
