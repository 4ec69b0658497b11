"""Vector best-fit packing of tokenised documents into sequences.

Every open bin has a residual vector: tokens, documents and attention cost (a document of n tokens
costs n * n). Pieces go in falling order of length to the feasible bin with the smallest weighted
norm of what would remain, or with the greatest weighted dot product of piece and residual; no
capacity is ever exceeded. WEIGHTS weigh all three alike, so a piece joins the bin in which tokens,
attention and documents are the most spent together, which need not be the one with the fewest tokens
left. As that may cost a bin, the same pieces are also filled by tokens alone where tokens alone can
bind, and the fewest bins win, the steered ones on a tie.

Pieces that fill a sequence alone never meet others. The rest is dealt at random into groups of
about GROUP pieces that are packed independently, so the cost over one global packing is under one
sequence a group, and a task's memory does not depend on the input.

Edge cases: null text counts as empty and makes one piece, the end id; repeated rows are packed as
often as they occur; null doc_ids are packed and returned as null; an empty table gives an empty
result; columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import map_ids
from quern.llm.common import with_rid, written

SEQUENCE = 2048
GROUP = 20_000
END_ID = 0
WEIGHTS = (1.0, 1.0, 1.0)  # of tokens, documents, attention


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else full pieces after a shorter first one."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def best_fit(length: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple = WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece. A piece over a capacity on its own raises ValueError.

    If tokens alone can bind, pieces go in falling order of length. Else that order spends the other capacities
    badly, so the given order and one that alternates long and short pieces are tried too; the fewest bins win.
    """
    length = np.asarray(length, np.int64)
    if len(length) and (length.max() > tokens or length.max() ** 2 > attention or documents < 1):
        raise ValueError("a piece exceeds a capacity on its own")
    binds = (True, documents < tokens, attention < tokens * tokens)  # at most `tokens` documents fit, and their cost is at most tokens squared
    falling = np.argsort(-length, kind="stable")
    ways = [(falling, weights)]
    if any(binds[1:]):
        mixed = np.empty_like(falling)
        half = (len(falling) + 1) // 2
        mixed[0::2], mixed[1::2] = falling[:half], falling[half:][::-1]
        ways += [(order, w) for order in (falling, np.arange(len(length)), mixed) for w in (weights, tuple(map(float, binds)))][1:]
    else:
        ways.append((falling, (1.0, 0.0, 0.0)))
    found = [_fill(length, order, (tokens, documents, attention), binds, w, by) for order, w in ways]
    return min(found, key=lambda f: f[2])[:2]


def _fill(length: np.ndarray, order: np.ndarray, capacities: tuple, binds: tuple, weights: tuple, by: str) -> tuple[np.ndarray, np.ndarray, int]:
    capacity, w = np.array(capacities, float), weights
    used = [k for k in range(3) if w[k]]
    left = np.empty((3, 64))  # residuals of the open bins
    names, count, made = np.empty(64, np.int64), 0, 0
    bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    smallest = length.min() if len(length) else 0
    for i in order:
        n = length[i]
        need = (n, 1, n * n)
        r = left[:, :count]
        fits = r[0] >= n
        for k in (1, 2):
            if binds[k]:
                fits &= r[k] >= need[k]
        score = np.zeros(count)
        for k in used:
            x = r[k] / capacity[k]
            score += w[k] * (need[k] / capacity[k]) * x if by == "dot" else -w[k] * (x - need[k] / capacity[k]) ** 2
        score[~fits] = -np.inf
        at = int(score.argmax()) if count else -1
        if at < 0 or score[at] == -np.inf:
            if count == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            at, count = count, count + 1
            left[:, at], names[at] = capacity, made
            made += 1
        bins[i], offsets[i] = names[at], capacities[0] - left[0, at]
        left[:, at] -= need
        if left[0, at] < smallest or left[1, at] < 1:  # closed for good
            count -= 1
            left[:, at], names[at] = left[:, count], names[count]
    return bins, offsets, made


def pieces(docs: DataFrame, size: int, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most size ids."""

    def make(doc_ids, ids):
        rows = []
        for doc_id, found in zip(doc_ids, ids):
            found = np.append(found.astype("<u4"), np.uint32(END_ID)).astype("<u4")
            rows += [(doc_id, k, at, n, zlib.crc32(found[at : at + n].tobytes())) for k, (at, n) in enumerate(cuts(len(found), size))]
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_ids(docs, make, "doc_id long, piece int, start long, length long, ids_crc32 long", path)


def pack(docs: DataFrame, tokens: int = SEQUENCE, documents: int | None = None, attention: int | None = None, weights: tuple = WEIGHTS, by: str = "norm", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row for each piece.

    A long document is cut to what fits a sequence, by tokens and by attention cost.
    """
    documents, attention = documents or tokens, attention or tokens * tokens
    size = min(tokens, math.isqrt(attention))
    made = written(with_rid(pieces(docs, size, path)))
    whole = F.col("length") == tokens
    groups = max(1, math.ceil(made.where(~whole).count() / GROUP))

    def fill(group: pa.Table) -> pa.Table:
        bins, offsets = best_fit(group["length"].to_numpy(), tokens, documents, attention, weights, by)
        made = 2 * ((group["_group"].to_numpy() << 32) + bins)
        return group.drop_columns("_group").append_column("sequence_id", pa.array(made, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = made.where(whole).select(*out[:5], (F.col("_rid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(~whole).select(*out[:5], F.pmod(F.xxhash64("_rid"), F.lit(groups)).alias("_group"))
    filled = rest.groupBy("_group").applyInArrow(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return alone.unionByName(filled)
