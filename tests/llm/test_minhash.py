import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import minhash
from quern.llm.words import WordHashes, shingles
from tests.llm.edge import documents


def brute(rows, size, num, den):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, shared = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    for v in index.values():
        shared.update((a, b) for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), c in shared.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("how", [{"size": 3, "num": 85, "den": 100, "bands": 18}, {}])
def test_whole_table(spark, sf, how):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, **how).collect()), key=repr)
    assert got == brute(docs.collect(), how.get("size", 5), how.get("num", 80), 100)


def test_members_apart_from_their_head(spark, monkeypatch):
    """A candidate group in which few link to the head: chains, and pairs of their own, in several blocks."""
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for k in range(30):  # every text shares most with the next, less with the one after
        texts[k] = " ".join(words[k * 2 : k * 2 + 60])
    for k in range(30):
        texts[100 + k] = texts[k] + " end"
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=3, num=85, den=100, bands=18).collect()), key=repr)
    assert got == brute(docs.collect(), 3, 85, 100)
    rows = docs.collect()
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        sets = [(0, r.doc_id, 15, bytearray(shingles(r.text, 3, hashes).tobytes())) for r in rows]
    edges = minhash._verified(spark.createDataFrame(sets, "cluster long, node long, _blocks int, shingles binary"), 95, 100)
    parent = {i: i for _, i, _, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges.collect():
        parent[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    assert sorted((r.doc_id, find(r.doc_id)) for r in rows) == sorted((i, c) for i, _, c in brute(rows, 3, 95, 100))


def test_a_hub_of_many_neighbours(spark, monkeypatch):
    from quern.llm import components as module

    monkeypatch.setattr(module, "HOT", 10)
    edges = [(0, i) for i in range(1, 200)] + [(i, 1000 + i) for i in range(1, 200)] + [(1500, 1501), (1501, 1502), (7, 7), (None, 3)]
    got = {r.node: r.component for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{1000 + i: 0 for i in range(1, 200)}, 1500: 1500, 1501: 1500, 1502: 1500}


def test_edges(spark):
    docs = documents(spark)
    got = minhash.near_duplicates(docs, size=3, num=85, den=100, bands=18).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(docs.collect(), 3, 85, 100)
    assert {r.component_id for r in got if r.doc_id == 9} == {8}
    assert all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    kept = minhash.thin(docs)
    assert kept.columns == docs.columns and {5, 6, 7} <= {r.doc_id for r in kept.collect()}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_thinning_goes_by_rows(spark):
    body = "the quick brown fox jumps over the lazy dog while seven wizards quickly vex the jolly dwarf and then run back home again"
    other = body.translate(str.maketrans("abcdefghij", "klmnopqrst"))
    rows = [
        (1, body), (None, body + " now"), (None, "unrelated and clean"), (None, ""), (None, None),
        (2, "one id with two texts"), (2, body), (3, other), (3, other + " now"), (3, other + " then"),
        (None, f"x {other} y z"), (None, body.upper() * 2), (None, body.upper() * 2 + " end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_rid", F.lit("clash"))
    kept = minhash.thin(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "-")[:20].lower(), len(r.text or "") > 150) for r in kept.collect()), key=repr)
    want = [(1, body[:20], False), (None, "unrelated and clean", False), (None, "-", False), (None, "-", False), (2, "one id with two texts"[:20], False), (3, other[:20], False), (None, body[:20], True)]
    assert got == sorted(want, key=repr)


def test_blocks_give_the_same_forest():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(60)]
    both = minhash.overlaps(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60))


def test_signature_estimates_similarity():
    h = WordHashes()
    with np.errstate(over="ignore"):
        a, b = shingles(" ".join(map(str, range(1000))), 3, h), shingles(" ".join(map(str, range(100, 1100))), 3, h)
        x, y = minhash.signature(a, 512), minhash.signature(b, 512)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.08
