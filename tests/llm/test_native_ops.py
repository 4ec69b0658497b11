import math
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import embeddings, licenses, sharding
from tests.llm.edge import documents
from tests.oracle import check


def checked_shards(docs):
    rows = sharding.shard(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(((t.doc_id, len((t.text or "").encode()) + 1, zlib.crc32((t.text or "").encode())) for t in texts), key=repr)
    by = {}
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    return rows, by


def test_shards(spark, sf):
    rows, by = checked_shards(spark.read.parquet(f"{sf}/documents.parquet"))
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    assert all(abs(sum(r.size for r in by.get(k, [])) - total / 8) <= most for k in range(8))


def test_shard_edges(spark):
    checked_shards(documents(spark))
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows, by = checked_shards(hot.unionAll(hot.where("doc_id < 100")))
    assert max(sum(r.size for r in v) for v in by.values()) - min(sum(r.size for r in v) for v in by.values()) <= 10
    assert sharding.shard(hot.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (sharding.shard(docs), licenses.scan_documents(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_licence_oracle(spark, sf):
    check(licenses.scan_documents(spark.read.parquet(f"{sf}/documents.parquet")), licenses.OP7_SQL, sf)


def test_licences_and_inheritance(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "print(1)"), (3, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "a//b/c/d/y.py", ""), (5, "z/q.txt", None), (6, None, "x"), (7, "top.py", "# Licensed under CC BY-NC 4.0. foo bar"), (7, "top.py", "# Licensed under CC BY-NC 4.0. foo bar"), (None, "a/k.txt", "a warranty of nothing at all, by any licence known to the people of this land")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("_rid", F.lit("clash")).withColumn("dir", F.lit(1))
    got = sorted(((r.doc_id, r.licence, r.origin, r.origin_dir) for r in licenses.scan(files).collect()), key=repr)
    want = [(1, "MIT", "file", None), (2, "MIT", "inherited", "a"), (3, "GPL-3.0", "file", None), (4, "GPL-3.0", "inherited", "a/b/c"), (5, None, "none", None), (6, None, "none", None), (7, "CC-BY-NC-4.0", "header", None), (7, "CC-BY-NC-4.0", "header", None), (None, "MIT", "inherited", "a")]
    assert got == sorted(want, key=repr)
    assert licenses.scan(files.limit(0)).count() == 0


def test_wrapped_notices_and_tags(spark):
    import textwrap

    rows, want = [], {}
    for n, (licence, text) in enumerate(licenses.TEMPLATES):
        for k, (mark, width) in enumerate((("", 72), ("# ", 72), (" * ", 60), ("// ", 79))):
            rows.append((n * 10 + k, f"src/{n}_{k}.c", "int a;\n" * 3 + "\n" * (not mark) + textwrap.indent(textwrap.fill(text, width), mark) + "\n" * (1 if mark else 2) + "int main() {}\n" * 40))
            want[n * 10 + k] = licence
    for n, (tag, licence) in enumerate((("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("BSD-3-Clause", "BSD-3-Clause"), ("GPL-3.0-or-later", "GPL-3.0"), ("Nobody-1.0", None))):
        rows.append((1000 + n, f"src/t{n}.py", f"# SPDX-License-Identifier: {tag}\nprint(1)\n"))
        want[1000 + n] = licence
    got = {r.doc_id: r.licence for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {i: (got[i], x) for i, x in want.items() if got[i] != x} == {}


def test_licence_scores_against_brute_force(spark):
    import re
    from collections import Counter

    bags = [re.findall(licenses.TERM, t.lower()) for _, t in licenses.TEMPLATES]
    idf = lambda t: math.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1
    vec = lambda b: {t: n * idf(t) for t, n in Counter(b).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    body = "This file is licensed under the Apache License, Version 2.0."
    v = vec(re.findall(licenses.TERM, body.lower()))
    best = max(sum(v.get(t, 0) * w for t, w in u.items()) / norm(u) / norm(v) for u in map(vec, bags))
    units = spark.createDataFrame([(1, (-1, 0, 9), re.findall(licenses.TERM, body.lower()))], "_rid long, unit struct<k: int, start: int, n: int>, terms array<string>")
    assert abs(licenses.best_licence(units, licenses.Vectors()).first().score - best) < 1e-6


def test_every_window_over_the_threshold_is_found(spark):
    """Against all windows of all templates' lengths at all places, without anchors or bounds."""
    import random
    from collections import Counter

    v, rng = licenses.Vectors(), random.Random(7)
    words = sorted(v.idf)
    texts = []
    for n in range(60):
        bag = list(rng.choice(v.bags))
        for _ in range(rng.randint(0, len(bag) // 2)):  # words changed, dropped and put in
            i = rng.randrange(len(bag))
            bag[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(words)], ["other"], [bag[i]]])
        texts.append(" ".join(rng.choices(["so", "the", "apple", "use", "version"], k=12) + bag + rng.choices(["any", "pear", "of", "free"], k=12)))
    docs = spark.createDataFrame([(i, "x.c", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.score) for r in licenses.scan(docs).collect()}
    anchors = v.anchors()
    for k, w in enumerate(v.weights):
        left = w.keys() - {t for t, own, _ in anchors if own == k}
        assert left <= licenses.COMMON or sum(w[t] ** 2 for t in left) < licenses.THRESHOLD**2
    found = 0
    for i, t in enumerate(texts):
        own, best = t.split(), (0, "")
        for k, (bag, w) in enumerate(zip(v.bags, v.weights)):
            starts = {j - o for j, x in enumerate(own) for y, kk, o in anchors if kk == k and y == x}
            for start in starts:
                window = Counter(own[max(start, 0) : start + len(bag)])
                norm = math.sqrt(sum((n * v.idf.get(x, v.rare)) ** 2 for x, n in window.items()))
                score = round(min(sum(n * v.idf[x] * w[x] for x, n in window.items() if x in w) / norm, 1.0), 6)
                best = min(best, (-score, v.names[k]))
        want = (best[1], -best[0]) if -best[0] >= licenses.THRESHOLD else (None, None)
        found += want[0] is not None
        assert got[i] == want or abs(got[i][1] - want[1]) < 2e-6
    assert 20 < found


def test_patterns_of_words():
    import re

    words = sorted({t for t, _, _ in licenses.Vectors().anchors()} | {"a", "ab", "abc", "b"})
    pattern = re.compile(f"(?<![a-z0-9]){licenses.one_of(words)}(?![a-z0-9])")
    assert all(pattern.fullmatch(w) for w in words)
    assert not any(pattern.search(w) for w in ("ac", "abcd", "xmit", "apachee", "b2", ""))


def test_licence_documents_pass_their_licence_on(spark):
    rows = [(1, "s", "en", "Released under the MIT License."), (2, "s", "en", "nothing said"), (3, "s", "de", "nichts gesagt"), (4, "t", None, "This work is licensed under the GNU General Public License, version 3. " + "and much more is said " * 9), (5, "t", None, None)]
    docs = spark.createDataFrame([(i, src, lang, text, 1) for i, src, lang, text in rows], "doc_id long, source string, lang string, text string, dir int")
    got = sorted((r.doc_id, r.licence, r.origin, r.origin_dir) for r in licenses.scan_documents(docs).collect())
    assert got == [(1, "MIT", "file", None), (2, "MIT", "inherited", "s/en"), (3, None, "none", None), (4, "GPL-3.0", "header", None), (5, None, "none", None)]


def test_vectors(spark, sf):
    check(embeddings.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")), embeddings.OP8_SQL, sf)


def test_vectors_in_many_cells_and_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 60)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    monkeypatch.setattr(embeddings, "RING", 16)
    check(embeddings.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")), embeddings.OP8_SQL, sf)


def test_clustered_vectors_move_little(spark):
    """Clusters that keep apart: a vector goes to a few cells, where blocks of all rows would copy it to hundreds."""
    import numpy as np

    copies = {}
    for n in (6000, 24_000):
        rng = np.random.default_rng(3)
        centres = rng.normal(size=(n // 100, 16))
        x = embeddings.units(np.repeat(centres, 100, axis=0) + 0.02 * rng.normal(size=(n, 16)))
        order = rng.permutation(n)
        most = max(math.isqrt(n), 1)
        pivots = embeddings.pivots_for(n * 100, x[order[:most]], x[order[most : most + 2048]], math.acos(0.9))
        a = np.arccos(np.clip(x @ pivots.T, -1, 1))
        cell = a.argmin(axis=1)
        radius = np.full(len(pivots), -np.inf)
        np.maximum.at(radius, cell, a[np.arange(n), cell])
        copies[n] = 1 + embeddings.reached(a, cell, radius, math.acos(0.9)).sum() / n
        assert len(pivots) > 30
    assert copies[6000] < 4 and copies[24_000] < 10 < 24_000 * 100 / embeddings.BLOCK / 20


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0, 0.0]), (None, [1.0, 0.1]), (9, [1.0, None]), (10, [-0.0, 0.0]), (11, [float("inf"), 1.0]), (12, []), (13, [1e200, 1e190]), (13, [1e200, 1e190])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 9, 10, 11, 12)]
    assert got == sorted([(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (None, 5, 1, False), (13, 5, 1, False), (13, 5, 1, False), *alone], key=repr)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
