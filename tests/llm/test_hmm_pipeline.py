import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from quern.llm import hmm
from quern.llm.words import words
from tests.llm.edge import documents


def brute(rows):
    words = lambda t: (t or "").encode().lower().split() + [b""]
    key = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter(w for r in rows if not key(r.doc_id) for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    return sorted(((r.doc_id, key(r.doc_id), len(words(r.text)), sum(counts[w] > 0 for w in words(r.text)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r.text)), 6)) for r in rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


def test_base_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(hmm.score(docs, top=500, band=900, rounds=1)) == brute(docs.collect())


def test_a_rare_end_keeps_its_count(spark):
    texts = [f"a a a a b b b c c c d{i} a b c " * 3 for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for top, band in ((3, 3), (1, 4), (0, 0)):
        assert got(hmm.score(docs, top=top, band=band)) == brute(docs.collect())


def by_loops(rows, states, rounds, top, band):
    """Scores by plain loops over documents: the same classes and start, but one sequence at a time and no tables."""
    words = lambda t: (t or "").encode().lower().split() + [b""]
    training = [words(r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    counts = collections.Counter(w for t in training for w in t)
    least = next((c for c in sorted(set(counts.values())) if sum(n >= c for n in counts.values()) <= max(top, band)), math.inf)
    own = sorted((w for w, c in counts.items() if c >= least), key=lambda w: (-counts[w], w))[:top]
    own += [] if b"" in own else [b""]
    own.sort(key=lambda w: (-counts[w], w))
    classes = {w: i for i, w in enumerate(own)}
    number = lambda w: classes.get(w, len(own) + hmm.rare_class(w))
    rare = [1 + sum(c + 1 for w, c in counts.items() if number(w) == len(own) + k) for k in range(hmm.RARE)]
    p = hmm.first_guess(np.array([counts[w] + 1.0 for w in own] + [float(x) for x in rare]), states)
    for _ in range(rounds):
        total = None
        for t in training:
            e = hmm.expected_counts([np.array([number(w) for w in t])], p)
            total = e if total is None else total + e
        p = hmm.normalised(total)
    out = []
    for r in rows:
        alpha, log = None, 0.0
        for w in words(r.text):
            k = number(w)
            alpha = [(p.pi[z] if alpha is None else sum(alpha[y] * p.a[y, z] for y in range(states))) * p.b[k, z] for z in range(states)]
            log += math.log10(sum(alpha)) + (math.log10((counts[w] + 1) / rare[k - len(own)]) if k >= len(own) else 0)
            alpha = [x / sum(alpha) for x in alpha]
        out.append((r.doc_id, round(log, 6)))
    return sorted(out)


def test_scores_equal_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    found = hmm.score(docs, states=3, rounds=2, top=100, band=300)
    assert sorted((r.doc_id, round(r.score, 6)) for r in found.collect()) == by_loops(docs.collect(), 3, 2, 100, 300)


def test_long_sequences_in_stretches_give_the_same_sums():
    rng = np.random.default_rng(1)
    p = hmm.normalised(hmm.Parameters(rng.random(3), rng.random((3, 3)), rng.random((7, 3))))
    for n, stretch in ((50, 7), (49, 7), (8, 7), (30, 1)):
        seq = rng.integers(0, 7, n)
        whole, parted = hmm.expected_counts([seq], p), hmm.expected_counts_of_long(seq, p, stretch)
        assert all(np.allclose(getattr(whole, x), getattr(parted, x)) for x in ("pi", "a", "b", "log"))


def test_held_out_documents_gain_from_training(spark, sf):
    own = [r for r in hmm.score(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    own = [r for r in hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    base, full, n = (sum(r[c] for r in own) for c in ("base_score", "score", "n_tokens"))
    print(base / n, full / n)
    assert full > base + 0.15 * n


def test_rounds_over_a_sample_only_set_the_start(spark, sf, monkeypatch):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    monkeypatch.setattr(hmm, "START_TOKENS", 5000)
    was = hmm._round
    monkeypatch.setattr(hmm, "_round", lambda encoded, p: seen.append(encoded.count()) or was(encoded, p))
    found = hmm.score(docs).collect()
    everything = sum(zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in found)
    assert 0 < seen[0] < everything / 2 and seen[-1] == seen[-2] == everything  # at least two rounds over all
    own = [r for r in found if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_every_round_goes_over_all_training_documents(spark, monkeypatch):
    """4.3 million training tokens, more than a sample ever held; half of each document is of one of two sets of words."""
    some = [" ".join(f"{'xy'[i % 2]}{(i * j) % 97} z{j % 13}" for j in range(500)) for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    seen, was, starts = [], hmm._round, []
    first = hmm.first_guess
    monkeypatch.setattr(hmm, "first_guess", lambda weights, states: starts.append(first(weights, states)) or starts[0])
    monkeypatch.setattr(hmm, "_round", lambda encoded, p: seen.append((encoded.count(), p)) or was(encoded, p))
    found = hmm.score(docs, states=2)
    training = found.where("not held_out").count()
    assert found.first().train_tokens == 1001 * training > 4_000_000
    assert {n for n, _ in seen} == {training}
    assert seen[0][1] is starts[0]  # the first guess, from the counts of all words


def test_tokens_of_a_batch_are_the_words_and_an_end():
    texts = ["", None, " a  B\x0b\x0cc\x1c\x1dd\x85e\u00a0f\u2003 \r\n", "\x1f", "É ÀZ a\0b", "\t", "x a X"]
    for some in (texts, texts[4:5], texts[:2], []):
        distinct, at, ends = hmm.tokenised(pa.array([None, "skipped "] + some, pa.string()).slice(2))
        got = [[distinct[int(i)].as_py() for i in at[lo:hi]] for lo, hi in zip([0, *ends], ends)]
        assert got == [words(t) + [hmm.END] for t in some] and len(at) == sum(map(len, got))


def test_training_ends_when_gains_end():
    logs = iter([-70.0, -69.9999, -69.99, -65.0, -62.0, -61.9999, -61.0])
    end = hmm.trained(lambda p: hmm.Parameters(p.pi, p.a, p.b, next(logs)), hmm.first_guess(np.ones(5), 3), 10)
    assert end.log == -61.9999


def test_edges(spark):
    docs = documents(spark)
    out = hmm.score(docs)
    assert got(out) == brute(docs.collect())
    assert all(math.isfinite(r.score) for r in out.collect())
    assert hmm.score(docs.limit(0)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    alone = hmm.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in alone)


def test_forward_is_the_sum_over_state_paths():
    p = hmm.first_guess(np.array([3.0, 1.0, 2.0]), 2)
    seqs = [np.array([0, 1, 2, 1]), np.array([2]), np.array([1, 1, 0])]
    for q, log in zip(seqs, hmm.log_likelihood(seqs, p)):
        total = sum(np.prod([(p.pi[z[0]] if i == 0 else p.a[z[i - 1], z[i]]) * p.b[q[i], z[i]] for i in range(len(q))]) for z in itertools.product(range(2), repeat=len(q)))
        assert abs(math.log(total) - log) < 1e-12


def test_expectations_add_up_and_raise_the_likelihood():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 5, rng.integers(1, 40)) for _ in range(50)]
    p = hmm.first_guess(np.ones(5), 3)
    e = hmm.expected_counts(seqs, p)
    assert np.isclose(e.pi.sum(), 50) and np.isclose((e.a * 1).sum(), sum(len(s) - 1 for s in seqs)) and np.isclose(e.b.sum(), sum(map(len, seqs)))
    before = hmm.log_likelihood(seqs, p).sum()
    for _ in range(8):
        p = hmm.normalised(hmm.expected_counts(seqs, p))
    assert hmm.log_likelihood(seqs, p).sum() > before


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], sf).cache())
        assert seen[-1].columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in seen[2].collect()]
    assert len(texts) == len(set(texts))
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in seen[-1].collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(last)


def test_pipeline_against_brute_force(spark, sf):
    """Every stage on all that its predecessor kept, against plain loops."""
    import public_tokenizers

    import corpus_pipeline
    from quern.llm import langid, pii
    from tests.llm.test_langid_pii import naive_scores
    from tests.llm.test_minhash import brute as near_brute
    from tests.llm.test_packing_bpe import laid_out

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500")
    noise = spark.createDataFrame([(10**6 + i, "zxq vkwj qqxz jjkv xwzq vvkj zzxq wkvj qxjz kvwz " * 9 + str(i), None, "s", 1) for i in range(3)] + [(10**7, None, "en", "s", 0), (10**7 + 1, "12 34 !", "de", "s", 7)], docs.schema)
    docs = docs.unionByName(noise).cache()
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, sf).cache()
    evidence = naive_scores(docs.collect(), langid.vocabulary(public_tokenizers.path(langid.PIECES)))
    want = {i for i, (_, _, e) in evidence.items() if e is not None and e >= langid.LEAST}
    assert {r.doc_id for r in first.collect()} == want and not {10**6, 10**7, 10**7 + 1} & want
    second = stages["exact_dedup"](spark, first, sf).cache()
    seen = {}
    for r in sorted(first.collect(), key=lambda r: r.doc_id):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in second.collect()} == set(seen.values())
    third = stages["near_dedup"](spark, second, sf).cache()
    assert {r.doc_id for r in third.collect()} == {i for i, n, c in near_brute(second.collect(), 5, 80, 100) if n == 0 or i == c}
    fourth = stages["pii"](spark, third, sf).cache()
    assert {r.doc_id: r.text for r in fourth.collect()} == {r.doc_id: pii.redacted(r.text) for r in third.collect()}
    last = stages["packing"](spark, fourth, sf).collect()
    by = laid_out(last, 2048)
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth.collect()} and len(by) <= math.ceil(sum(r.length for r in last) / 2048) + 1


def test_pipeline_on_the_edge_table(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    for docs in (documents(spark), documents(spark).withColumn("lang", F.lit(None).cast("string")), documents(spark).limit(0)):
        seen = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, "").cache()
            assert seen.columns == docs.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, seen, "").collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in seen.collect()}
        if docs.count():
            assert {8, 15} <= {r.doc_id for r in rows} and not {5, 6, 7, 14} & {r.doc_id for r in rows}
