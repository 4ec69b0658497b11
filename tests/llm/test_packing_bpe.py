import hashlib
import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe, packing
from tests.llm.edge import documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


TEXTS = ["", "a", " ", "<|endoftext|>x <|endoftext|>", "a" * 20_000, " " * 9000 + "b", "ab " * 5000, "x<|endoftext|>" * 900, "é" * 9000, "日本語" * 3000, "1234567890" * 900, "!?" * 5000, "it's" * 3000, "\n" * 9000 + "x", "🙂" * 5000, "a" * 5000 + " " * 5000 + "b1" * 4000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_same_ids_as_the_library(library, text):
    c = bpe.codec(bpe.vocabulary())
    want = library.encode(text, add_special_tokens=False).ids
    got = c.encode(text)
    assert got.tolist() == want
    assert c.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_texts_join_at_any_cut(library):
    """Words, contractions, runs of white space, special tokens and other scripts around the join."""
    import random

    c, rng = bpe.codec(bpe.vocabulary()), random.Random(4)
    bits = ["it's", "don't", "  ", "\n\n", " \n ", "\t", "12345", "99.9", "word", "Über", "naïve", "日本", "🙂", "<|endoftext|>", "x" * 30, "!!!", "...", " a", ",b", "\u00a0", "\u2003", "'", "_", "-"]
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n", ". "]) for _ in range(rng.randint(2, 60)))
        cut = rng.randint(1, len(text) - 1)
        a, b = text[:cut], text[cut:]
        want = library.encode(text, add_special_tokens=False).ids
        assert c.join_texts(a, b, c._run(a), c._run(b)).tolist() == want, (a, b)


def test_the_tree_runs_over_the_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 200)
    c = bpe.codec(bpe.vocabulary())
    joins = c.joins
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert c.encode(r.text).tolist() == c.library.encode(r.text, add_special_tokens=False).ids
    assert c.joins - joins > 1000
    assert any(len(r.text) > bpe.LEAF for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())


def test_join_agrees_at_any_cut(library):
    c, text = bpe.codec(bpe.vocabulary()), "internationalisationofunbreakablehippopotamusses" * 4
    want = library.encode(text, add_special_tokens=False).ids
    for cut in range(0, len(text), 7):
        halves = [c.merge_bytes(x.encode()) if x else [] for x in (text[:cut], text[cut:])]
        assert c.join(*halves) == want


def test_round_trip_of_tables(spark, sf, library):
    more = spark.createDataFrame([(100, "z" * 200_000), (101, "qwertyuiop" * 20_000), (102, "é" * 100_000 + " x"), (103, "so it goes, doesn't it?  \n" * 9000), (104, "日本 a" * 20_000), (105, "word <|endoftext|>" * 8000 + "z" * 9000 + " end." * 9000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(documents(spark).select("doc_id", "text")).unionAll(more)
    got = sorted((tuple(r) for r in bpe.round_trip(docs).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    texts = bpe.decode_documents(bpe.encode_documents(docs))
    assert sorted((r.text for r in texts.collect())) == sorted(r.text or "" for r in docs.collect())


def laid_out(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return by


def test_pack(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(documents(spark).where("doc_id <> 13").select("doc_id", "text"))
    docs = docs.dropDuplicates(["doc_id"])
    rows = packing.pack(docs).collect()
    by = laid_out(rows, 2048)
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 2048) + 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        ids = np.array(library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        found.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in found] == packing.cuts(len(ids), 2048)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in found)


def test_pack_edges(spark):
    docs = documents(spark)
    rows = packing.pack(docs).collect()
    laid_out(rows, 2048)
    assert sum(r.piece == 0 for r in rows) == docs.count()
    assert packing.pack(docs.limit(0)).count() == 0


def test_large_ids_beside_nulls_stay_whole(spark):
    ids = [9007199254740993, 9007199254740995, None, -9007199254740993, None]
    rows = packing.pack(spark.createDataFrame([(i, f"word {k}") for k, i in enumerate(ids)], "doc_id long, text string")).collect()
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, ids))


def test_pack_keeps_all_capacities(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, tokens=512, documents=3, attention=100_000).collect()
    by = laid_out(rows, 512)
    assert all(len(x) <= 3 and sum(n * n for _, n in x) <= 100_000 for x in by.values())
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    need = max(sum(r.length for r in rows) / 512, len(rows) / 3, sum(r.length**2 for r in rows) / 100_000)
    assert len(by) <= 1.15 * need + 2


def test_documents_and_attention_decide_between_like_bins_and_cost_no_sequence():
    """The weights move pieces between bins, and never make more bins than tokens alone."""
    rng = np.random.default_rng(5)
    length = np.minimum(2048, rng.lognormal(5, 1.3, 6000).astype(int) + 1)
    attention = {}
    for w in ((1.0, 0.0, 0.0), packing.WEIGHTS):
        b = packing.best_fit(length, 2048, 2048, 2048**2, w)[0]
        attention[w] = (b.max() + 1, np.bincount(b, length.astype(float) ** 2))
    scalar, steered = attention[(1.0, 0.0, 0.0)], attention[packing.WEIGHTS]
    assert steered[0] <= scalar[0] <= math.ceil(length.sum() / 2048) + 1
    assert not np.array_equal(np.sort(steered[1]), np.sort(scalar[1]))


@pytest.mark.parametrize("weights", [packing.WEIGHTS, (1, 0, 0)])
@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_holds(by, weights):
    length = np.random.default_rng(1).integers(1, 900, 2000)
    bins, offset = packing.best_fit(length, 2048, 4, 1_000_000, weights, by)
    for b in set(bins.tolist()):
        own = length[bins == b]
        assert own.sum() <= 2048 and len(own) <= 4 and (own**2).sum() <= 1_000_000
    assert len(set(bins.tolist())) <= 1.15 * max(length.sum() / 2048, len(length) / 4, (length**2).sum() / 1e6) + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([3000]), 2048, 4, 10**9)
