import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup
from quern.llm.fuse import BinaryFuse8
from tests.llm.edge import documents
from tests.oracle import check


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_oracle(spark, sf):
    check(exact_dedup.classify(spark.read.parquet(f"{sf}/documents.parquet")), exact_dedup.OP1_SQL, sf)


@pytest.mark.parametrize("batches", [1, 3])
def test_edges(spark, batches):
    docs = documents(spark)
    got = exact_dedup.classify(docs, batches).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(docs.collect())
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})  # exactly one of each class


def test_colliding_digests_are_told_apart(spark):
    docs = documents(spark)
    got = exact_dedup.classify(docs, digest=lambda t: F.lit("same")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == sorted((x[:3] for x in brute(docs.collect())), key=repr)


def test_stage_keeps_one_row_of_each_text(spark):
    docs = documents(spark)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({x[3] for x in brute(docs.collect())})


def test_empty(spark):
    docs = documents(spark).limit(0)
    assert exact_dedup.classify(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 20_000])
def test_filter_holds_all_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    f = BinaryFuse8.load(BinaryFuse8.build(keys).dump())
    assert f.holds(keys).all()
    assert f.holds(rng.integers(-(2**63), 2**63 - 1, 50_000)).mean() < 0.01


def test_snapshots_screen_later_runs(spark, tmp_path):
    from quern.llm import exact_dedup

    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda t: F.substring(F.sha2(F.substring(t, 1, 3), 256), 1, 16)  # noqa: E731  # equal for texts that begin alike
    exact_dedup.snapshot(table([(5, "one  two"), (3, "one two"), (7, None), (None, "lone")])).save(f"{tmp_path}/a")
    exact_dedup.snapshot(table([(1, "one two"), (2, "three")])).save(f"{tmp_path}/b")
    held = [exact_dedup.Snapshot.load(spark, f"{tmp_path}/{x}") for x in "ab"]
    new = table([(10, "one\ttwo"), (11, "three"), (12, "four"), (13, ""), (14, "lone"), (None, "three"), (15, "four")])
    got = sorted(((r.doc_id, r.snapshot, r.keep_id) for r in exact_dedup.screen(new, held).collect()), key=repr)
    assert got == sorted([(10, 0, 3), (11, 1, 2), (12, None, None), (13, 0, 7), (14, 0, None), (None, 1, 2), (15, None, None)], key=repr)
    assert exact_dedup.screen(new, []).where("snapshot is null").count() == 7 and exact_dedup.screen(new.limit(0), held).count() == 0
    # A shared digest is no proof: the bytes decide.
    one = exact_dedup.snapshot(table([(1, "abc"), (2, "xyz")]), weak)
    assert [(r.doc_id, r.snapshot) for r in exact_dedup.screen(table([(4, "abcd"), (5, "abc")]), [one], weak).orderBy("doc_id").collect()] == [(4, None), (5, 0)]


def test_an_outlying_id_leaves_both_batches_filled(spark):
    from quern.llm import exact_dedup

    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(80)] + [(2**62, "t1"), (-(2**62), "t2")], "doc_id long, text string")
    seen = []
    was = exact_dedup.Snapshot.positives
    exact_dedup.Snapshot.positives = lambda self, rows: seen.append((self.rows.count(), rows.count())) or was(self, rows)
    try:
        got = exact_dedup.classify(docs).collect()
    finally:
        exact_dedup.Snapshot.positives = was
    assert len(got) == 82 and {r.doc_id for r in got if r.kept} == {0, 1, *range(3, 40), -(2**62)}
    assert all(a > 10 and b > 10 for a, b in seen) and seen
