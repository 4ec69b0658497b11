"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one; per language, its pieces get probabilities by
expectation-maximisation over word types. A text's score in a language is the sum over its words of
the log probability of the word, and that is a sum over all ways of cutting the word into pieces
(forward algorithm). Words repeat, so each Python worker scores a word type once and keeps it in a
bounded memo.

Fitting uses a bounded sample: about MAX_DOCS labelled documents a language (chosen by a hash
threshold, in expectation), and of these all words of all lengths. The expectations are summed
across partitions; what reaches the driver is one row a language and piece, whatever the input.
Predicting reads every whole text.

Beside the language, a text gets its evidence: the mean log probability of a byte of its words in
that language. The stage of the pipeline rejects a text with evidence under LEAST: one that the best
language explains worse than bytes drawn at random from the 128 of ASCII.

Edge cases: null, empty and letterless texts are `und` with score 0 and no evidence (characters of
the Unicode categories L count as letters, no numerals or marks); a null label is not learned from;
without any labelled text every prediction is `und`, and the stage then keeps what has letters;
ties between languages go to the first in alphabetical order; repeated rows are predicted each;
other columns pass untouched.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, id_fold, own_name, small_batches

MAX_DOCS = 1500
PIECES = "byte_bpe_multi_50k.tiktoken"
SHORT = 40  # bytes of a word that runs beside others, without rescaling
SCALE = 16.0  # a byte, against underflow
ROUNDS = 4
FLOOR = 0.01  # share of the uniform distribution in every language's pieces
LEAST = -math.log(128)  # prose lies over -2.5, a language akin to none learned at -4, base64 at -7.7, hex digits at -5.3
CHUNK = 1024  # words side by side
HELD = 20_000  # words that a task gathers before it works through them
_WORDLIKE = re.compile(r"[^\W\d_]+")


def letter_runs(token: str) -> list[str]:
    """Runs of letters; the pattern also takes numerals such as \u00bd, which end a run."""
    out = []
    for run in _WORDLIKE.findall(token):
        out += [run] if run.isalpha() else ["".join(g) for letters, g in itertools.groupby(run, str.isalpha) if letters]
    return out


def as_scored(run: str) -> bytes:
    return b" " + run.encode("utf-8", "surrogatepass")


class Vocabulary:
    """Pieces, numbered in the file's order, and a table of their rolling hashes."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {p: i for i, p in enumerate(base64.b64decode(line.split()[0]) for line in f if line.strip())}
        self.lengths = np.array([len(p) for p in self.ids])
        self.longest = int(self.lengths.max())
        hashes = np.zeros(len(self.ids), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                letters = np.frombuffer(b"".join(p for p in self.ids if len(p) == n), np.uint8).reshape(-1, n)
                for column in letters.T:
                    hashes[self.lengths == n] = hashes[self.lengths == n] * self.BASE + column + np.uint64(1)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.powers = [np.uint64(pow(int(self.BASE), n, 1 << 64)) for n in range(self.longest + 1)]

    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of a hash in the table, or the table's length where it is no piece's."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, len(self.hashes))

    def by_place(self, p: np.ndarray) -> np.ndarray:
        """Of probabilities (languages x pieces): scaled, in the table's order, and a zero for what is no piece."""
        return np.concatenate([(p * SCALE**self.lengths)[:, self.order], np.zeros((len(p), 1))], axis=1).T.copy()

    def spans(self, words: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(i, j, k, places) for words in order of length: bytes i to j of the words from k on, which reach j, by ends j."""
        size = np.array([len(w) for w in words])
        n = int(size[-1])
        letters = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
        prefix = [np.zeros(len(words), np.uint64)]
        with np.errstate(over="ignore"):
            for column in letters.T:
                prefix.append(prefix[-1] * self.BASE + column)
            for j in range(1, n + 1):
                k = int(np.searchsorted(size, j))
                for i in range(max(0, j - self.longest), j):
                    yield i, j, k, self.place(prefix[j][k:] - prefix[i][k:] * self.powers[j - i])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def in_chunks(words: list[bytes]) -> Iterator[list[int]]:
    """Numbers of words of at most SHORT bytes, in order of length."""
    order = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
    for a in range(0, len(order), CHUNK):
        yield order[a : a + CHUNK]


def expected_pieces(words: list[bytes], n: np.ndarray, p: np.ndarray, v: Vocabulary) -> np.ndarray:
    """How often each piece is expected in the words, the i-th taken n[i] times, over all segmentations."""
    out, scaled = np.zeros(len(v.ids) + 1), v.by_place(p[None, :])[:, 0]
    for part in in_chunks(words):
        chosen = [words[i] for i in part]
        size, who = np.array([len(w) for w in chosen]), np.arange(len(chosen))
        spans = list(v.spans(chosen))
        alpha = np.zeros((int(size[-1]) + 1, len(chosen)))
        beta = alpha.copy()
        alpha[0], beta[size, who] = 1, 1
        for i, j, k, at in spans:
            alpha[j, k:] += alpha[i, k:] * scaled[at]
        weight = n[part] / alpha[size, who]
        for i, j, k, at in reversed(spans):
            beta[i, k:] += beta[j, k:] * scaled[at]
        places = np.concatenate([at for *_, at in spans])
        out += np.bincount(places, np.concatenate([alpha[i, k:] * scaled[at] * beta[j, k:] * weight[k:] for i, j, k, at in spans]), minlength=len(out))
    found = np.zeros(len(v.ids))
    found[v.order] = out[:-1]
    for i, w in enumerate(words):
        if len(w) > SHORT:
            _expected_in_long(w, float(n[i]), np.log(p), v, found)
    return found


def _expected_in_long(word: bytes, n: float, log_p: np.ndarray, v: Vocabulary, into: np.ndarray) -> None:
    """The same for one word of any length, by logarithms."""
    ahead, edges = np.full(len(word) + 1, -np.inf), []
    ahead[0] = 0
    for j in range(1, len(word) + 1):
        own = [(i, k) for i in range(max(0, j - v.longest), j) if (k := v.ids.get(word[i:j])) is not None]
        i, k = np.array(own, np.int64).reshape(-1, 2).T
        edges.append((i, k))
        ahead[j] = np.logaddexp.reduce(ahead[i] + log_p[k])
    back = np.full(len(word) + 1, -np.inf)
    back[-1] = 0
    for j in range(len(word), 0, -1):
        i, k = edges[j - 1]
        np.add.at(into, k, n * np.exp(ahead[i] + log_p[k] + back[j] - ahead[-1]))
        back[i] = np.logaddexp(back[i], log_p[k] + back[j])


def smoothed(expected: np.ndarray) -> np.ndarray:
    return (1 - FLOOR) * expected / expected.sum() + FLOOR / len(expected)


def log_probability(word: bytes, p: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Of one word of any length, in all languages; rescaled as it goes."""
    alpha, shift = [np.ones(len(p))], np.zeros(len(p))
    for j in range(1, len(word) + 1):
        now = np.zeros(len(p))
        for i in range(max(0, j - v.longest), j):
            if (k := v.ids.get(word[i:j])) is not None:
                now += alpha[i - j] * p[:, k]
        alpha = [*alpha[-v.longest + 1 :], now]
        if j % 8 == 0 and (top := now.copy()).min() > 0:
            alpha = [a / top for a in alpha]
            shift += np.log(top)
    return np.log(np.maximum(alpha[-1], 1e-300)) + shift


class Places(dict):
    """Token -> row of its score; new tokens get the next rows and are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.new.append(token)
        return at


class Scorer:
    """Log probabilities of tokens in all languages, with a bounded memo of token types.

    New word types are scored many at a time: rolling hashes of all their substrings are looked up
    among the hashes of the pieces, and the forward sums run over a matrix of words of like length.
    """

    LIMIT = 100_000

    def __init__(self, path: str, p: np.ndarray):
        self.v, self.p = vocabulary(path), p
        self.scaled = self.v.by_place(p)
        self._forget()

    def _forget(self):
        self.place = Places()
        self.scores = np.zeros((1024, len(self.p)), np.float64)
        self.bytes = np.zeros(1024, np.int64)  # of the letters, with a space before each run

    def _words(self, words: list[bytes]) -> np.ndarray:
        """words: sorted by length, at most SHORT bytes."""
        size = np.array([len(w) for w in words])
        alpha = np.zeros((int(size[-1]) + 1, len(words), len(self.p)))
        alpha[0] = 1
        for i, j, k, at in self.v.spans(words):
            alpha[j, k:] += alpha[i, k:] * self.scaled[at]
        found = alpha[size, np.arange(len(words))]
        return np.log(np.maximum(found, 1e-300)) - size[:, None] * np.log(SCALE)

    def _learn(self, tokens: list[str]) -> None:
        number: dict[str, int] = {}
        owner, run_of = [], []
        for i, t in enumerate(tokens):
            for r in letter_runs(t):
                owner.append(i)
                run_of.append(number.setdefault(r, len(number)))
        words = [as_scored(r) for r in number]
        log = np.zeros((len(words), len(self.p)))
        for part in in_chunks(words):
            log[part] = self._words([words[i] for i in part])
        for i, w in enumerate(words):
            if len(w) > SHORT:
                log[i] = log_probability(w, self.p, self.v)
        need = len(self.place)
        if need > len(self.scores):
            more = max(need, 2 * len(self.scores)) - len(self.scores)
            self.scores = np.concatenate([self.scores, np.zeros((more, len(self.p)))])
            self.bytes = np.concatenate([self.bytes, np.zeros(more, np.int64)])
        owner, run_of = np.array(owner, np.int64) + need - len(tokens), np.array(run_of, np.int64)
        np.add.at(self.scores, owner, log[run_of])
        np.add.at(self.bytes, owner, np.array([len(w) for w in words], np.int64)[run_of])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every text in every language, and the bytes of its words (0 without letters)."""
        if len(self.place) > self.LIMIT:
            self._forget()
        rows, get = [], self.place.__getitem__
        for t in texts:
            tokens = t.lower().split() if t else []
            rows.append(np.fromiter(map(get, tokens), np.int64, len(tokens)))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        out, size = np.zeros((len(texts), len(self.p))), np.zeros(len(texts), np.int64)
        for i, at in enumerate(rows):
            if len(at):
                out[i] = self.scores[at].sum(axis=0)
                size[i] = self.bytes[at].sum()
        return out, size


@dataclass
class LanguageModel:
    languages: list[str]
    probabilities: np.ndarray  # languages x pieces
    path: str

    def predict(self, docs: DataFrame, text: str = "text") -> Column:
        """A struct column (lang_pred, score, evidence) over the whole text."""
        sc = docs.sparkSession.sparkContext
        small_batches(docs.sparkSession)
        languages, path = list(self.languages), self.path
        sent = sc.broadcast(self.probabilities)  # languages x fixed vocabulary

        @F.pandas_udf("lang_pred string, score double, evidence double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(path, sent.value) if languages else None
            for texts in batches:
                texts = [t if isinstance(t, str) else None for t in texts]
                if scorer is None:
                    yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "evidence": [None] * len(texts)})
                    continue
                log, size = scorer.score(texts)
                best = log.argmax(axis=1)
                share = 1 / np.exp(np.clip(log - log.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                evidence = [top / n if n else None for top, n in zip(log.max(axis=1).tolist(), size.tolist())]
                yield pd.DataFrame({"lang_pred": [languages[b] if x else "und" for b, x in zip(best, size)], "score": np.where(size > 0, share, 0.0), "evidence": pd.Series(evidence, dtype=object)})

        return run(docs[text].cast("string"))


def _words_of(chosen: DataFrame) -> DataFrame:
    """lang, word (as it is scored), n over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for token, n in Counter((text or "").lower().split()).items():
                    for run in letter_runs(token):
                        found[lang, as_scored(run)] += n
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    return chosen.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _round(words: DataFrame, p: dict[str, np.ndarray], path: str) -> dict[str, np.ndarray]:
    """One round of expectation-maximisation over the words of all languages."""
    sent = words.sparkSession.sparkContext.broadcast(p)  # languages x fixed vocabulary

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = vocabulary(path), defaultdict(lambda: np.zeros(len(vocabulary(path).ids)))
        own, held = defaultdict(list), 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    own[lang].append((word, n))
                held += batch.num_rows
            if batch is None or held >= HELD:
                for lang, rows in own.items():
                    total[lang] += expected_pieces([w for w, _ in rows], np.array([n for _, n in rows], float), sent.value[lang], v)
                own, held = defaultdict(list), 0
        for lang, found in total.items():
            k = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(found[k])], names=["lang", "piece", "n"])

    out = {lang: np.zeros_like(x) for lang, x in p.items()}
    rows = words.select("lang", "word", "n").mapInArrow(expect, "lang string, piece long, n double")
    for lang, k, n in rows.groupBy("lang", "piece").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False):
        out[lang][k] = n
    sent.unpersist()
    return {lang: smoothed(x) for lang, x in out.items()}


def fit(labelled: DataFrame, path: str | None = None, max_docs: int = MAX_DOCS) -> LanguageModel:
    """Learn from the columns text and lang; doc_id, with the row's number, only draws the sample."""
    path = path or public_tokenizers.path(PIECES)
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return LanguageModel([], np.zeros((0, 0)), path)
    limit = F.create_map(*[F.lit(x) for lang in sorted(sizes) for x in (lang, min(1.0, max_docs / sizes[lang]))])
    words = cut(_words_of(rows.where(F.pmod("h", F.lit(1 << 20)) < limit[F.col("lang")] * (1 << 20))))
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # one row a language
    size = len(vocabulary(path).ids)
    p = {lang: np.full(size, 1 / size) for lang in languages}
    for _ in range(ROUNDS if languages else 0):
        p = _round(words, p, path)
    return LanguageModel(languages, np.stack([p[x] for x in languages]) if languages else np.zeros((0, 0)), path)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, evidence; fitted on the documents outside the held-out fold."""
    held_out = id_fold(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out), path)
    found = docs.select("doc_id", held_out.alias("held_out"), model.predict(docs).alias("p"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "p.lang_pred", "p.score", "p.evidence")


def keep_identified(docs: DataFrame, path: str | None = None, least: float = LEAST, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs whose language is identified, with all their columns.

    A row goes if its text has no letters, if its evidence is under `least`, or if a list of languages is given and
    the one predicted is not in it. If no text is labelled, no language can be told, and whatever has letters stays.
    """
    model = fit(docs.where(id_fold(F.col("doc_id"), 4) != 2), path)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    name = own_name(docs, "_found")
    rows = docs.withColumn(name, model.predict(docs))
    sure = F.col(name)["evidence"] >= least
    if languages is not None:
        sure &= F.col(name)["lang_pred"].isin(list(languages))
    return rows.where(sure).drop(name)
