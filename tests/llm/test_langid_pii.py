import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, pii
from tests.llm.edge import documents


def test_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)


def test_edges(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (5, 6, 7, 14))
    assert got[10].lang_pred != "und"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {5, 6, 7, 14} & {r.doc_id for r in kept.collect()}
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    path = public_tokenizers.path(langid.PIECES)
    v = langid.vocabulary(path)
    ids = v.ids
    p = np.random.default_rng(0).dirichlet(np.ones(len(ids)), 2)
    for word in (b" the", b" caf\xc3\xa9", b"a"):
        total = np.zeros(2)
        for marks in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, m in enumerate([*marks, 1]):
                if m:
                    parts.append(word[at : i + 1])
                    at = i + 1
            if all(x in ids for x in parts):
                total += np.prod([p[:, ids[x]] for x in parts], axis=0)
        assert np.allclose(langid.log_probability(word, p, v), np.log(total))
        assert np.allclose(langid.Scorer(path, p)._words([word])[0], np.log(total))


def test_expected_pieces_by_all_segmentations(monkeypatch):
    v = langid.vocabulary(public_tokenizers.path(langid.PIECES))
    p = np.random.default_rng(0).dirichlet(np.ones(len(v.ids)))
    words, n = [b" caf\xc3\xa9", b" a", b" there", b" as"], np.array([3.0, 1.0, 2.0, 5.0])
    want = np.zeros(len(v.ids))
    for word, times in zip(words, n):
        found = []
        for marks in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, m in enumerate(marks) if m] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            if all(x in v.ids for x in parts):
                k = [v.ids[x] for x in parts]
                found.append((np.prod(p[k]), k))
        total = sum(x for x, _ in found)
        for x, k in found:
            for i in k:
                want[i] += times * x / total
    assert np.allclose(langid.expected_pieces(words, n, p, v), want)
    monkeypatch.setattr(langid, "SHORT", 3)  # the longer ones by logarithms
    assert np.allclose(langid.expected_pieces(words, n, p, v), want)


def naive_scores(rows, v):
    """All predictions by plain loops, learning from all labelled documents outside the held-out fold."""
    runs = lambda t: ["".join(g) for ok, g in itertools.groupby(t or "", lambda c: c.isalpha()) if ok]
    words = lambda t: [b" " + r.encode() for token in (t or "").lower().split() for r in runs(token)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    counts = {}
    for r in rows:
        if r.lang is not None and fold(r.doc_id) != 2:
            counts.setdefault(r.lang, {})
            for w in words(r.text):
                counts[r.lang][w] = counts[r.lang].get(w, 0) + 1

    def forward(w, p):
        edges = [[(i, k) for i in range(max(0, j - v.longest), j) if (k := v.ids.get(w[i:j])) is not None] for j in range(len(w) + 1)]
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * p[k] * 16.0 ** (j - i) for i, k in edges[j])
        return a, edges

    models = {}
    for lang, found in sorted(counts.items()):
        p = [1 / len(v.ids)] * len(v.ids)
        for _ in range(langid.ROUNDS):
            e = [0.0] * len(v.ids)
            for w, n in found.items():
                a, edges = forward(w, p)
                b = [0.0] * len(w) + [1.0]
                for j in range(len(w), 0, -1):
                    for i, k in edges[j]:
                        x = p[k] * 16.0 ** (j - i)
                        e[k] += n * a[i] * x * b[j] / a[-1]
                        b[i] += x * b[j]
            total = sum(e)
            p = [(1 - langid.FLOOR) * x / total + langid.FLOOR / len(e) for x in e]
        models[lang] = p
    out, memo = {}, {}
    for r in rows:
        own = words(r.text)
        logs = []
        for lang, p in models.items():
            for w in own:
                if (lang, w) not in memo:
                    memo[lang, w] = math.log(forward(w, p)[0][-1]) - len(w) * math.log(16)
            logs.append(sum(memo[lang, w] for w in own))
        best = max(range(len(logs)), key=logs.__getitem__)
        share = 1 / sum(math.exp(max(x - logs[best], -700)) for x in logs)
        out[r.doc_id] = (list(models)[best], round(share, 6), round(logs[best] / sum(map(len, own)), 6)) if own else ("und", 0.0, None)
    return out


def test_predictions_equal_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500")
    want = naive_scores(docs.collect(), langid.vocabulary(public_tokenizers.path(langid.PIECES)))
    got = {r.doc_id: (r.lang_pred, round(r.score, 6), None if r.evidence is None else round(r.evidence, 6)) for r in langid.identify(docs).collect()}
    assert len(got) > 40 and got == want


def test_letters_by_category(spark):
    texts = ["½ ² ③ Ⅷ ⒈", "12 !? _", "é", "½a", "ª", "", None]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, "plain words", "en") for i in range(20)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(len(texts))] == ["und", "und", "en", "en", "en", "und", "und"]


def test_a_small_language_keeps_its_words_beside_a_large_one(spark):
    rng = random.Random(1)
    many = [(i, " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(80)), "aa") for i in range(300)]
    few = [(1000 + i, "zwyx vuts " * 3, "zz") for i in range(6)]
    long = [(2000 + i, "klmnop" * 40, "ll") for i in range(8)]  # words over SHORT bytes alone
    docs = spark.createDataFrame(many + few + long, "doc_id long, text string, lang string")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_the_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    noise = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(4000)]
    junk = [(10**6 + i, " ".join(noise[40 * i : 40 * i + 40]), None, "s", 1) for i in range(100)]
    more = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in langid.keep_identified(more).collect()}
    assert not {r[0] for r in junk} & kept
    assert {r.doc_id for r in docs.where("lang is not null and length(text) > 200").collect()} <= kept
    only = {r.lang for r in langid.keep_identified(docs, languages=["de", "fr"]).collect()}
    assert {"de", "fr"} <= only and "es" not in only


def test_without_labels_the_stage_keeps_what_has_letters(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.where("text rlike '[a-zA-Z]'").count()


def brute(t):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for k, (name, p) in enumerate(kinds):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if name == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns(spark, sf):
    random.seed(1)
    for _ in range(4000):
        t = "".join(random.choice("a1.@+- 2(9)x0é") for _ in range(random.randint(0, 60)))
        assert brute(t) == pii.base_spans(t)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert brute(r.text) == pii.base_spans(r.text)


@pytest.mark.parametrize("text, kind, found", [
    ("mail joe [at] ex [dot] com now", "email", "joe [at] ex [dot] com"), ("joe at ex dot com", "email", "joe at ex dot com"), ("joe(at)ex.com", "email", "joe(at)ex.com"), ("jоe@exаmple.com", "email", "jоe@exаmple.com"),
    ("ｊｏｅ＠ｅｘ．ｃｏｍ x", "email", "ｊｏｅ＠ｅｘ．ｃｏｍ"), ("joe@ex​am.com", "email", "joe@ex​am.com"), ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"), ("4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
    ("ruf plus vier neun eins fünf eins zwei drei vier fünf sechs sieben an", "phone", "plus vier neun eins fünf eins zwei drei vier fünf sechs sieben"), ("au plus trois trois un deux trois quatre cinq six sept huit neuf, merci", "phone", "plus trois trois un deux trois quatre cinq six sept huit neuf"),
    ("al más tres cuatro cero uno dos tres cuatro cinco seis siete ocho", "phone", "más tres cuatro cero uno dos tres cuatro cinco seis siete ocho"), ("vier 111 1111 1111 eins eins eins eins", "card", "vier 111 1111 1111 eins eins eins eins"),
    ("john at example.com", "email", "john at example.com"), ("write to john at example.com, please", "email", "john at example.com"), ("so jo.ex at example.co.uk has it", "email", "jo.ex at example.co.uk"), ("joe at ex[dot]com", "email", "joe at ex[dot]com"),
    ("juan arroba ejemplo punto es y luego", "email", "juan arroba ejemplo punto es"), ("jean arobase exemple point fr", "email", "jean arobase exemple point fr"), ("hans at beispiel punkt de", "email", "hans at beispiel punkt de"),
])
def test_disguises(text, kind, found):
    base = pii.base_spans(text)
    assert (pii.KINDS.index(kind), found) in [(k, text[a:b]) for a, k, b in pii.added_spans(text, base)]


@pytest.mark.parametrize("text, out", [
    ("joe@ex[dot]com", "[EMAIL]"), ("joe@ex(dot)com", "[EMAIL]"), ("joe@ex [dot] com", "[EMAIL]"), ("joe@ex_dot_com", "[EMAIL]"), ("joe@ex-dot-com", "[EMAIL]"), ("joe@ex[.]com", "[EMAIL]"), ("joe@ex{ PUNKT }com", "[EMAIL]"), ("joe@ex<punto>com", "[EMAIL]"), ("10.0.0[.]1", "[IP]"),
])
def test_a_disguised_dot_is_enough(text, out):
    assert pii.redacted(f"see {text} now") == f"see {out} now"


def test_the_quick_look_misses_nothing():
    rng = random.Random(3)
    words = ["at", "AT", "arroba", "chez", "@", "dot", "Dot", "point", "po\u0131nt", "punkt", "pun\u212at", "punto", "."]
    marks = [*(a + x + w + x + b for a, b in ("[]", "()", "{}", "<>") for x in ("", " ") for w in words), *(a + w + a for a in " _-" for w in words), "@", ".", " @ ", " at ", " dot ", " arroba ", " arobase ", " punkt ", " punto ", " point ", "&#64;", "&#46;", "%40", "\uff0e", "\u200b."]
    digits = ["vier ", "F\u00fcnf, ", "un ", "uno ", "dos-", "neuf ", "one ", "Two ", "three, ", "f\u0131ve-", "\u017fix ", "seven.", "4 ", "11", "plus ", "+1", "0.", "zero "]
    seen = 0
    for _ in range(20_000):
        parts = [rng.choice(["joe", "x"]), rng.choice(marks), "ex", rng.choice(marks), "com"] if rng.random() < 0.4 else [rng.choice(["joe@ex", "10.0.0", "a.b", "10.0"]), rng.choice(marks), rng.choice(["com", "1", "0.1"])] if rng.random() < 0.5 else [rng.choice(digits) for _ in range(rng.randint(8, 17))]
        text = "".join(parts)
        base = pii.base_spans(text)
        spans = pii.rewritten_spans(text, base)
        seen += bool(spans)
        assert pii.added_spans(text, base) == spans, text
    assert seen > 2000


@pytest.mark.parametrize("text", ["meet me at the dot", "we at home dot", "one of three things", "a.b, c.d", "at (the) end", "the price: 5.6 at 7", "", "they looked at example.com for it", "we stood at vantage point today", "home at last.Then he left", "uno dos y tres", "un deux, trois", "null, eins"])
def test_clean_text_is_left_alone(text):
    assert pii.redacted(text) == text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1.1." * 80_000, "+1" * 100_000, "one " * 50_000):
        pii.redacted(text)


def test_the_query_counts_as_the_patterns_do(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).where("doc_id <> 13").select("doc_id", "text"))
    docs = docs.withColumn("doc_id", F.monotonically_increasing_id())
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        base = brute(r.text or "")
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == counts and got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(got[r.doc_id].spans.split(",")) or not base


def test_find_and_redact(spark):
    docs = documents(spark).unionByName(documents(spark).limit(1).selectExpr("99L doc_id", "'x a@b.co, 10.0.0.1, +1 (499) 555-6503' text", *[c for c in documents(spark).columns if c not in ("doc_id", "text")]))
    r = pii.find(docs).where("doc_id = 99").first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1) and r.spans == "email:2:8,ip:10:18,phone:20:37"
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.where("doc_id = 99").first().text == "x [EMAIL], [IP], [PHONE]"
    assert out.where("doc_id = 5").first().text is None
