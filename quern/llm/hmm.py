"""A hidden Markov language model over words, with a unigram base score.

Exact word counts of the training documents are gathered over all data. A word's class is itself
for about the TOP most frequent words and one of RARE hashed classes otherwise; the hidden states emit
classes, and a rare word's share of its class comes from the exact counts, so every word has a
probability. Every Baum-Welch round runs over all training documents, until one gains less than
TOLERANCE a token: each task turns its documents into expected counts, one row a class, and the rows
are summed across partitions. Nothing is learned from a sample unless START_TOKENS is set; then rounds
over documents drawn by hash, about that many tokens of them, choose where the rounds over all start.
Scoring runs the scaled forward recursion over whole documents, many side by side, and adds the rare
words' shares. The counts of the BAND most frequent words go along with the model; the words beyond
meet theirs in a join.

In training, sequences over STRETCH tokens are worked through stretch by stretch, with the forward
and backward vectors carried across, which bounds the memory and changes no sum. Sequences of like
length lie side by side, POOL_TOKENS at a time, as every position costs a step however few reach it.
The random start of the emissions is drawn from a fixed seed.

Edge cases: null text counts as empty and is one end token; without training documents N and V are 0;
a null doc_id falls in the fold of the empty text; repeated rows are counted and scored each; an
empty table gives an empty result; columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, id_fold, small_batches, with_rid, written

END = b""  # no word is empty
TOP = 8192
BAND = 131_072
RARE = 64
STATES = 12
TOLERANCE = 0.005  # nats a training token that a further round must gain
START_TOKENS: int | None = None  # tokens of a sample to start from; none: all rounds go over all documents
STRETCH = 500_000
BATCH_TOKENS = 1_000_000
WIDE, WIDE_TOKENS = 1024, 250_000  # as many sequences of as many tokens gain nothing from more beside them
POOL_TOKENS = 4_000_000  # held by a task to be sorted by length
NARROW = 256  # sequences side by side; below it the moves of many steps are summed at once
SCALED = 16  # steps between two scalings; a step shrinks the vectors by the least move at most, some 1e-11 at 30 GB
FLUSH = 200_000  # distinct words that a task gathers before it passes them on


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts (binary, with END), every token's place among them, and where each text's tokens end.

    A text's tokens are those of words() and one end. Arrow's ASCII functions know the same letters and white space; at
    the start and end of a text its split leaves empty parts.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = parts.flatten().dictionary_encode()
    distinct, at = found.dictionary.cast(pa.binary()), found.indices.to_numpy()
    end = pc.index(distinct, pa.scalar(END, pa.binary())).as_py()
    if end < 0:
        end, distinct = len(distinct), pa.concat_arrays([distinct, pa.array([END], pa.binary())])
    word = at != end
    ends = np.concatenate([[0], np.cumsum(word)])[parts.offsets.to_numpy()[1:]]
    return distinct, np.insert(at[word], ends, end), ends + np.arange(1, len(ends) + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; empty for the end), c, over all docs; summed within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            if batch.num_rows:
                distinct, at, _ = tokenised(batch.column("text"))
                found.update(dict(zip(distinct.to_numpy(zero_copy_only=False), np.bincount(at, minlength=len(distinct)).tolist())))
            if len(found) > FLUSH:
                yield _counted(found)
                found = Counter()
        if found:
            yield _counted(found)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def rare_class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, seed=42) & (RARE - 1)  # as Spark's xxhash64


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, c) of the most frequent words, at most `most` of them: all words above a count, chosen by a histogram.

    The histogram has a row for each count below 1,024 and 32 rows for each doubling beyond, so it is small whatever
    the input, and no task sends more than its share of the words.
    """
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2(F.col("c")) * 32) + 704).cast("long")
    rows = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = None, 0
    for s, more in rows:
        if n + more > most:
            break
        least, n = s, n + more
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


# -- the recursions ------------------------------------------------------------------------------
@dataclass
class Side:
    """Sequences side by side: position t of all of them lies together, the longest first."""

    order: np.ndarray
    start: np.ndarray  # of every t, and the end
    tokens: np.ndarray
    last: np.ndarray  # the last place of each of them

    @classmethod
    def of(cls, seqs: list[np.ndarray]) -> "Side":
        size = np.array([len(s) for s in seqs])
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(size.max()), side="left")  # sequences longer than t
        start = np.concatenate([[0], np.cumsum(active)])
        tokens = np.empty(start[-1], np.int64)
        for rank, i in enumerate(order):
            tokens[start[: size[i]] + rank] = seqs[i]
        return cls(order, start, tokens, start[size[order] - 1] + np.arange(len(seqs)))


    def runs(self, below: int, most: int = 16_384) -> Iterator[tuple[int, int, int]]:
        """(lo, hi, far): the places lo to hi are followed, in their sequences, by those `far` further on.

        They are all places whose next position has fewer than `below` sequences, joined over positions of one width.
        """
        width = np.diff(self.start)
        lo, far = self.start[:-2], width[:-1]
        first = np.searchsorted(-width[1:], -below, side="right")
        new = np.flatnonzero((lo[first + 1 :] != lo[first:-1] + width[first + 1 : -1]) | (far[first + 1 :] != far[first:-1])) + first + 1
        bounds = [first, *new.tolist(), len(lo)] if first < len(lo) else []
        for i, j in zip(bounds[:-1], bounds[1:]):
            end = int(lo[j - 1] + width[j])
            for at in range(int(lo[i]), end, most):
                yield at, min(at + most, end), int(far[i])


@dataclass
class Parameters:
    pi: np.ndarray  # states
    a: np.ndarray  # states x states
    b: np.ndarray  # classes x states
    log: float = 0.0  # of expected counts: the log likelihood of the sequences they come from

    @classmethod
    def none(cls, states: int, classes: int) -> "Parameters":
        """Counts to add to; the emissions lie as those of expected_counts do."""
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)).T)

    def __add__(self, other: "Parameters") -> "Parameters":
        return Parameters(self.pi + other.pi, self.a + other.a, self.b + other.b, self.log + other.log)

    def __iadd__(self, other: "Parameters") -> "Parameters":
        self.pi += other.pi
        self.a += other.a
        self.b += other.b
        self.log += other.log
        return self

    @cached_property
    def relative(self) -> tuple[np.ndarray, np.ndarray]:
        """states x classes: each class's emissions over the greatest of them, so that vectors shrink slowly; and its logs."""
        most = self.b.max(axis=1)
        return np.ascontiguousarray((self.b / most[:, None]).T), np.log(most)


def log_likelihood(seqs: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Natural log probability of every sequence, by the scaled forward recursion."""
    side = Side.of(seqs)
    b, most = p.relative
    log, alpha, move, ones = np.array([most[seqs[i]].sum() for i in side.order]), None, np.ascontiguousarray(p.a.T), np.ones(len(p.pi))
    widths = np.diff(side.start).tolist()
    for t, (lo, n, left) in enumerate(zip(side.start.tolist(), widths, [*widths[1:], 0])):
        e = np.take(b, side.tokens[lo : lo + n], axis=1)
        e *= p.pi[:, None] if alpha is None else move @ alpha[:, :n]
        alpha = e
        if t % SCALED == SCALED - 1:
            c = ones @ alpha
            alpha /= c
            log[:n] += np.log(c)
        if left < n:
            log[left:n] += np.log(ones @ alpha[:, left:])
    out = np.empty(len(seqs))
    out[side.order] = log
    return out


def expected_counts(seqs: list[np.ndarray], p: Parameters) -> Parameters:
    """Baum-Welch expectations over the sequences: starts, moves and emissions."""
    return _expected(Side.of(seqs), p, None, None)[0]


def _expected(side: Side, p: Parameters, before: np.ndarray | None, after: np.ndarray | None) -> tuple[Parameters, np.ndarray]:
    """The expectations, and emission times beta at the first places.

    before: the scaled forward vectors of the places before the first; after: emission times beta of the places after
    the last. Both are states x 1 and for one sequence alone.
    """
    s, whole = len(p.pi), before is None
    n = len(side.tokens)
    b, most = p.relative
    e = np.take(b, side.tokens, axis=1)  # states x places, so that long rows lie together
    alpha, log = np.empty((s, n)), float(np.bincount(side.tokens, minlength=len(most)) @ most)
    steps = list(zip(side.start[:-1].tolist(), side.start[1:].tolist()))
    move, ones = np.ascontiguousarray(p.a.T), np.ones(s)
    for t, (lo, hi) in enumerate(steps):
        now = alpha[:, lo:hi]
        np.multiply(p.pi[:, None] if before is None else move @ before[:, : hi - lo], e[:, lo:hi], out=now)
        if t % SCALED == SCALED - 1:
            c = ones @ now
            now /= c
            e[:, lo:hi] /= c
            log += float(np.log(c).sum())
        before = now
    c = ones @ alpha[:, side.last]
    alpha[:, side.last] /= c
    e[:, side.last] /= c
    log += float(np.log(c).sum())
    moves = np.zeros((s, s))
    for t, (lo, hi) in reversed(list(enumerate(steps))):
        now = e[:, lo:hi]  # becomes emission times beta
        if after is not None:
            m = after.shape[1]
            beta = p.a @ after
            if m >= NARROW or t == len(steps) - 1:
                moves += alpha[:, lo : lo + m] @ after.T
                alpha[:, lo : lo + m] *= beta  # now the chance of every state
            now[:, :m] *= beta
        after = now
    for lo, hi, far in side.runs(NARROW):
        then = e[:, lo + far : hi + far]
        moves += alpha[:, lo:hi] @ then.T
        alpha[:, lo:hi] *= p.a @ then
    first = alpha[:, : steps[0][1]].sum(axis=1) if whole else np.zeros(s)
    emitted = np.array([np.bincount(side.tokens, row, minlength=len(p.b)) for row in alpha]).T
    return Parameters(first, moves * p.a, emitted, log), after


def expected_counts_of_long(seq: np.ndarray, p: Parameters, stretch: int = STRETCH) -> Parameters:
    """The same sums for one sequence of any length, in the memory of one stretch."""
    parts = [seq[at : at + stretch] for at in range(0, len(seq), stretch)]
    entered: list[np.ndarray | None] = [None]
    for part in parts[:-1]:
        x = None if entered[-1] is None else entered[-1][:, 0]
        for t in part:
            x = (p.pi if x is None else x @ p.a) * p.b[t]
            x = x / x.sum()
        entered.append(x[:, None])
    total, after = Parameters.none(len(p.pi), len(p.b)), None
    for part, before in zip(reversed(parts), reversed(entered)):
        found, after = _expected(Side.of([part]), p, before, after)
        total += found
    return total


def normalised(p: Parameters) -> Parameters:
    """Smoothed, so that nothing becomes impossible."""
    pi, a, b = p.pi + 0.1, p.a + 0.1, p.b + 0.05
    return Parameters(pi / pi.sum(), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0, keepdims=True), p.log)


def first_guess(weights: np.ndarray, states: int) -> Parameters:
    rng = np.random.default_rng(20_250_101)
    b = weights[:, None] * rng.uniform(0.5, 1.5, (len(weights), states))
    a = np.full((states, states), 0.4 / states) + np.eye(states) * 0.6
    return normalised(Parameters(np.ones(states), a * weights.sum(), b))


def _pooled(seqs: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, n = [], 0
    for x in seqs:
        held.append(x)
        n += len(x[-1])
        if n >= POOL_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _alike(seqs: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Batches of sequences of like length; the longest first, so that what is left over is short."""
    for held in _pooled(seqs):
        held.sort(key=lambda x: -len(x[-1]))
        at = n = 0
        for i, x in enumerate(held):
            n += len(x[-1])
            if n >= BATCH_TOKENS or (i + 1 - at >= WIDE and n >= WIDE_TOKENS):
                yield held[at : i + 1]
                at, n = i + 1, 0
        if at < len(held):
            yield held[at:]


def _kind(classes: int) -> str:
    return "<u2" if classes <= 1 << 16 else "<u4"


def _round(encoded: DataFrame, p: Parameters) -> Parameters:
    """One Baum-Welch round, with the log likelihood before it; what reaches the driver is one row a class, state,
    start and likelihood, whatever the input."""
    states, classes = len(p.pi), len(p.b)
    sent = encoded.sparkSession.sparkContext.broadcast(p)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        total = Parameters.none(states, classes)

        def sequences():
            for batch in batches:
                for packed in batch.column("classes").to_pylist():
                    yield (np.frombuffer(packed, _kind(classes)),)

        some = False
        for group in _alike(sequences()):
            short = [x[0] for x in group if len(x[0]) <= STRETCH]
            if short:
                total += expected_counts(short, now)
            for (seq,) in group:
                if len(seq) > STRETCH:
                    total += expected_counts_of_long(seq, now)
            some = True
        if some:
            seen = np.flatnonzero(total.b.any(axis=1))
            keys = np.concatenate([seen, -1 - np.arange(states), [-1 - states, -2 - states]])
            values = np.concatenate([total.b[seen], total.a, total.pi[None, :], np.full((1, states), total.log)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(v) for v in values.T)], names=["key", *(f"v{k}" for k in range(states))])

    columns = [f"v{k}" for k in range(states)]
    rows = encoded.select("classes").mapInArrow(expect, "key long, " + ", ".join(f"{c} double" for c in columns))
    total = Parameters(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))
    for r in rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        values = [r[c] for c in columns]
        if r["key"] >= 0:
            total.b[r["key"]] = values
        elif r["key"] >= -states:
            total.a[-1 - r["key"]] = values
        elif r["key"] == -1 - states:
            total.pi[:] = values
        else:
            total.log = values[0]
    sent.unpersist()
    return normalised(total)


def trained(step: Callable[[Parameters], Parameters], p: Parameters, tokens: int, rounds: int | None = None) -> Parameters:
    """Rounds from p until one gains less than TOLERANCE a token, or the given number of rounds.

    From a nearly uniform start the gains first grow, so a small gain that is still growing ends nothing.
    """
    last, before, done = None, -math.inf, 0
    while rounds is None or done < rounds:
        p, done = step(p), done + 1
        if last is not None:
            gain = (p.log - last) / tokens
            if gain < TOLERANCE and gain <= max(before, 0.0):
                break
            before = gain
        last = p.log
    return p


def score(docs: DataFrame, states: int = STATES, rounds: int | None = None, top: int = TOP, band: int = BAND) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (id_fold(F.col("doc_id"), 7) == 2).alias("held_out"))
    counts = cut(word_counts(rows.where(~F.col("held_out"))))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = dict(frequent(counts, max(band, top)))  # at most `band` words
    if END not in known:  # however rare, it is a class of its own with its own count
        found = counts.where(F.col("word") == F.lit(END)).first()
        known[END] = found["c"] if found else 0
    names = sorted(known, key=lambda w: (-known[w], w))
    own = [w for i, w in enumerate(names) if w == END or i < top]
    class_of = {w: i for i, w in enumerate(own)}
    places = np.array([class_of.get(w, len(own) + rare_class(w)) for w in names] + [len(own) + k for k in range(RARE)], np.int64)
    log = np.concatenate([np.log10(np.array([known[w] + 1.0 for w in names])), np.zeros(RARE)])
    seen = np.concatenate([np.array([known[w] > 0 for w in names]), np.zeros(RARE, bool)])
    # Of every rare class: the sum of c + 1 over its words, and 1 for the unseen.
    weight = F.sum(F.col("c") + 1).alias("w")
    rare_weight = np.ones(RARE)
    for r in counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(RARE)).alias("k")).agg(weight).collect():  # RARE rows
        rare_weight[r["k"]] += r["w"]
    for w in own:
        rare_weight[rare_class(w)] -= known[w] + 1 if known[w] else 0
    # What is taken from a word's class probability: nothing for a class of its own.
    share = np.concatenate([np.where(places[: len(names)] < len(own), log[: len(names)], np.log10(rare_weight)[np.maximum(places[: len(names)] - len(own), 0)]), np.log10(rare_weight)])
    sent = sc.broadcast((names, places, log, seen, share))  # at most `band` words
    kind = _kind(len(own) + RARE)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places, log, seen, share = sent.value
        band, beyond = pa.array(names, pa.binary()), len(names)  # after the band's places come those of the rare classes
        for batch in batches:
            docs = batch.num_rows
            if not docs:
                continue
            distinct, at, ends = tokenised(batch.column("text"))
            place = pc.fill_null(pc.index_in(distinct, value_set=band), -1).to_numpy().astype(np.int64)
            new = np.flatnonzero(place < 0)
            place[new] = [beyond + rare_class(w) for w in distinct.take(pa.array(new)).to_numpy(zero_copy_only=False)]
            starts, n = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
            data, offsets = places[place].astype(kind)[at], np.concatenate([[0], ends]) * np.dtype(kind).itemsize
            packed = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            log_of, share_of, n_known = (np.add.reduceat(x[place][at], starts) for x in (log, share, seen.astype(np.int64)))
            # The words beyond the band, once a document.
            unmet = np.flatnonzero(place[at] >= beyond)
            pairs, times = np.unique(np.repeat(np.arange(docs), n)[unmet] * len(distinct) + at[unmet], return_counts=True)
            bounds = pa.array(np.searchsorted(pairs // len(distinct), np.arange(docs + 1)), pa.int32())
            rare = pa.ListArray.from_arrays(bounds, distinct.take(pa.array(pairs % len(distinct))))
            rare_n = pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_rid"), batch.column("held_out"), packed, pa.array(n, pa.int64()), pa.array(log_of, pa.float64()), pa.array(share_of, pa.float64()), pa.array(n_known, pa.int64()), rare, rare_n],
                names=["doc_id", "_rid", "held_out", "classes", "n_tokens", "log", "share", "known", "rare", "rare_n"],
            )

    encoded = written(with_rid(rows).mapInArrow(encode, "doc_id long, _rid long, held_out boolean, classes binary, n_tokens long, log double, share double, known long, rare array<binary>, rare_n array<long>"))
    # The words beyond the band meet their counts.
    pairs = encoded.select("_rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("_rid", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    met = pairs.join(counts, "word", "left")
    rare = met.groupBy("_rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))

    p = first_guess(np.concatenate([np.array([known[w] + 1.0 for w in own]), rare_weight]), states)
    if total:
        training = encoded.where(~F.col("held_out")).select("_rid", "classes", "n_tokens")
        if rounds is None and START_TOKENS and total > 2 * START_TOKENS:
            drawn = F.pmod(F.xxhash64("_rid"), F.lit(1 << 30)) < int(START_TOKENS / total * (1 << 30))
            start = written(training.where(drawn))
            if tokens := start.agg(F.sum("n_tokens")).first()[0]:
                p = trained(lambda q: _round(start, q), p, tokens)
        p = trained(lambda q: _round(training, q), p, total, rounds)
    model = sc.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequences():
            for batch in batches:
                for rid, packed in zip(batch.column("_rid").to_pylist(), batch.column("classes").to_pylist()):
                    yield rid, np.frombuffer(packed, kind)

        for group in _alike(sequences()):
            found = log_likelihood([x[1] for x in group], model.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in group], pa.int64()), pa.array(found)], names=["_rid", "hidden"])

    hidden = encoded.select("_rid", "classes").mapInArrow(run, "_rid long, hidden double")
    out = encoded.select("_rid", "doc_id", "held_out", "n_tokens", "log", "share", "known").join(hidden, "_rid").join(rare, "_rid", "left")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    logs = F.col("log") + rare_log
    base = logs - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + rare_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hidden") + logs - F.col("share")).alias("score"))
