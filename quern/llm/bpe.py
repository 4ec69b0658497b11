"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is halved again and again, wherever the middle falls; the leaves are encoded apart, and
neighbours are joined: a window around the join is encoded anew and grows until the tokens at both of
its ends are the ones that the halves already had. In text of words the ends of the window lie where the vocabulary's own pattern
must split whatever stands around (a letter, digit or stop, then a space or line feed), and one
further such stretch at either end shows that both sides agree. A run without such a place for
longer than LEAF characters is cut by the pattern itself; of a piece that the pattern does not
split at all, windows are counted in tokens, and two encodings agree across an edge exactly if the
two tokens at it are encoded together as just these two.

Documents over LONG characters are dealt to parallel tasks by parts; shorter ones run through the
same tree inside one task.

Ordinary pieces run through the rank table of the same vocabulary (read from its JSON file).
Text with characters outside the blocks on which all versions of Unicode agree goes to the
tokenizers library itself, which is also what the tests compare with.

Edge cases: null text counts as empty and gives no ids; the special token's string in a text is
the special token, as in the library; repeated rows stay; an empty table gives an empty result;
columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.common import small_batches, with_rid, written

BYTE_BPE = "byte_bpe_50k.json"
LEAF = 4096  # characters that are encoded in one go
PART = 16_384  # characters of a long document that one task encodes
LONG = 65_536  # characters of a document from which its parts are dealt to tasks
WINDOW = 64  # characters on each side of a join that are looked at first
_PLAIN = re.compile(r"[^\x00-ɏ‐-‧‰-›€]")
_SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?])[ \n]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by their rule: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return letters


class Codec:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.ranks = tiktoken.Encoding("quern", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)  # of every token
        for piece, i in ranks.items():
            self.bytes[i] = len(piece)
        for text, i in self.special.items():
            self.bytes[i] = len(text.encode())
        self.joins = 0  # of texts, for the tests
        self.strings = [str(i) for i in range(max([*ranks.values(), *self.special.values()]) + 1)]

    # -- pieces ------------------------------------------------------------------------------
    def _run(self, run: str) -> np.ndarray:
        """One run of bounded length, by the library's rules."""
        if _PLAIN.search(run):
            return np.array(self.library.encode(run, add_special_tokens=False).ids, np.uint32)
        return self.ranks.encode_to_numpy(run, allowed_special="all")

    def _unsplit(self, piece: str) -> bool:
        """True if the pattern leaves the piece whole, so that its ids come from merges alone."""
        return len(self.library.pre_tokenizer.pre_tokenize_str(piece)) == 1

    def merge_bytes(self, piece: bytes) -> list[int]:
        """Merges over one unsplit piece given as bytes (a window may start inside a character)."""
        return self.ranks._encode_single_piece(piece)

    def compatible(self, a: int, b: int) -> bool:
        both = self.ranks.decode_single_token_bytes(a) + self.ranks.decode_single_token_bytes(b)
        return self.merge_bytes(both) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two unsplit halves, from the ids of both."""
        if not left or not right:
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = b"".join(map(self.ranks.decode_single_token_bytes, left[a:] + right[:b]))
            new = self.merge_bytes(window)
            if (a == 0 or self.compatible(left[a - 1], new[0])) and (b == len(right) or self.compatible(new[-1], right[b])):
                return left[:a] + new + right[b:]
            width *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Join neighbours pairwise until one list is left."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def _long(self, piece: str) -> list[int]:
        if len(piece) <= LEAF:
            return self.merge_bytes(piece.encode("utf-8"))
        half = len(piece) // 2
        return self.join(self._long(piece[:half]), self._long(piece[half:]))

    # -- texts -------------------------------------------------------------------------------
    def units(self, text: str) -> Iterator[tuple[bool, str]]:
        """(long, unit): units that the pattern keeps apart; long ones are single unsplit pieces over LEAF characters."""
        start = at = 0
        for cut in [*[m.start() for m in _SAFE.finditer(text)], len(text)]:
            if cut - at > LEAF:  # a run without a safe place
                if start < at:
                    yield False, text[start:at]
                yield from self._units_of_run(text[at:cut])
                start = cut
            at = cut
        if start < len(text):
            yield False, text[start:]

    def _units_of_run(self, run: str) -> Iterator[tuple[bool, str]]:
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", run) if self.special else [run]:
            if part in self.special or len(part) <= LEAF:
                if part:
                    yield False, part
                continue
            start = 0  # the offsets of the library's own splitting; short neighbours go together
            for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part):
                if b - a > LEAF:
                    if start < a:
                        yield False, part[start:a]
                    yield True, part[a:b]
                    start = b
            if start < len(part):
                yield False, part[start:]

    def halves(self, text: str) -> np.ndarray:
        """Ids of a unit that is not long, by halves."""
        if len(text) <= LEAF:
            return self._run(text)
        half = len(text) // 2
        return self.join_texts(text[:half], text[half:], self.halves(text[:half]), self.halves(text[half:]))

    def join_texts(self, a: str, b: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a + b, from the ids of both."""
        self.joins += 1
        width = WINDOW
        while True:
            whole_a, whole_b = width >= len(a), width >= len(b)
            tail, head = a[-width:], b[:width]
            before = [len(tail) - m.start() for m in _SAFE.finditer(tail)][-2:]  # characters of a from the place on
            after = [m.start() for m in _SAFE.finditer(head)][:2]
            if (len(before) == 2 or whole_a) and (len(after) == 2 or whole_b):
                found = self._joined_at(a, b, left, right, before if len(before) == 2 else [len(a)], after if len(after) == 2 else [len(b)])
                if found is not None or (whole_a and whole_b):
                    return self._run(a + b) if found is None else found
            width *= 2

    def _joined_at(self, a: str, b: str, left: np.ndarray, right: np.ndarray, before: list[int], after: list[int]) -> np.ndarray | None:
        """The window runs from the first place of before to the last of after; None unless the outer stretches agree."""
        size = [len(a[len(a) - n :].encode("utf-8", "surrogatepass")) for n in before]
        old = [self._count(left[::-1][: size[0]], n) for n in size]  # tokens of the left side from each place on
        size = [len(b[:n].encode("utf-8", "surrogatepass")) for n in after]
        new = [self._count(right[: size[-1]], n) for n in size]
        if None in old or None in new:
            return None
        window = self._run(a[len(a) - before[0] :] + b[: after[-1]])
        kept_left, kept_right = old[0] - old[-1], new[-1] - new[0]
        if len(window) < kept_left + kept_right or not np.array_equal(window[:kept_left], left[len(left) - old[0] : len(left) - old[-1]]) or not np.array_equal(window[len(window) - kept_right :], right[new[0] : new[-1]]):
            return None
        return np.concatenate([left[: len(left) - old[0]], window, right[new[-1] :]])

    def _count(self, ids: np.ndarray, size: int) -> int | None:
        """How many of the ids make up so many bytes; None if none end there."""
        if size == 0:
            return 0
        ends = np.cumsum(self.bytes[ids])
        k = int(np.searchsorted(ends, size))
        return k + 1 if k < len(ends) and ends[k] == size else None

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= LEAF:
            return self._run(text)
        parts = [np.array(self._long(u), np.uint32) if long else self.halves(u) for long, u in self.units(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        return self.ranks.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> str:
        return ",".join(map(self.strings.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary(path: str | None = None) -> str:
    return path or public_tokenizers.path(BYTE_BPE)


def _spread(docs: DataFrame, path: str) -> DataFrame:
    """Deal documents to tasks by parts, and join the parts' ids. Gives _rid, ids (packed 32-bit little-endian)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for rid, text in zip(batch.column("_rid").to_pylist(), batch.column("text").to_pylist()):
                rows = []
                for i, (long, unit) in enumerate(c.units(text)):
                    step = LEAF if long else PART
                    rows += [(rid, i, k, long, unit[k : k + step]) for k in range(0, len(unit), step)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["_rid", "unit", "leaf", "long", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.array(c.merge_bytes(p.encode()), "<u4") if long else c.halves(p) for long, p in zip(batch.column("long").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("_rid", "unit", "leaf", "long", "part")] + [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["_rid", "unit", "leaf", "long", "part", "ids"])

    def concatenate(pdf):
        import pandas as pd

        c, out = codec(path), []
        for _, unit in pdf.sort_values(["unit", "leaf"]).groupby("unit", sort=True):
            found = [np.frombuffer(x, "<u4") for x in unit["ids"]]
            if unit["long"].iloc[0]:
                out.append(np.array(c.tree([x.tolist() for x in found]), "<u4"))
                continue
            texts = unit["part"].tolist()
            while len(found) > 1:
                pairs = range(0, len(found), 2)
                found = [c.join_texts(texts[i], texts[i + 1], found[i], found[i + 1]) if i + 1 < len(found) else found[i] for i in pairs]
                texts = ["".join(texts[i : i + 2]) for i in pairs]
            out.append(found[0])
        return pd.DataFrame({"_rid": [pdf["_rid"].iloc[0]], "ids": [np.concatenate(out).astype("<u4").tobytes()]})

    dealt = docs.mapInArrow(parts, "_rid long, unit long, leaf long, long boolean, part string").repartition(F.col("_rid"), F.col("unit"), F.col("leaf"))
    return dealt.mapInArrow(encode, "_rid long, unit long, leaf long, long boolean, part string, ids binary").groupBy("_rid").applyInPandas(concatenate, "_rid long, ids binary")


def map_ids(docs: DataFrame, make, schema: str, path: str | None = None) -> DataFrame:
    """Apply make(doc_id list, list of id arrays) -> record batch to all documents; make runs in the Python workers.

    Documents over LONG characters take the parallel way of _spread().
    """
    path = vocabulary(path)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    huge = F.length("text") > LONG

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield make(batch.column("doc_id").to_pylist(), [c.encode(t) for t in batch.column("text").to_pylist()])

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch.column("doc_id").to_pylist(), [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()])

    out = rows.where(~huge).mapInArrow(short, schema)
    few = written(with_rid(rows.where(huge)))  # most tables have none
    if few.isEmpty():
        return out
    return out.unionByName(few.select("doc_id", "_rid").join(_spread(few, path), "_rid").mapInArrow(done, schema))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def make(doc_ids, ids):
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_ids(docs, make, "doc_id long, ids array<int>", path)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; special tokens are kept as their strings."""
    path = vocabulary(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.uint32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(read, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    where = vocabulary(path)

    def make(doc_ids, ids):
        c, sha = codec(where), lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        columns = [pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(c.joined(x)) for x in ids]), pa.array([sha(c.decode(x)) for x in ids])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_ids(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)
