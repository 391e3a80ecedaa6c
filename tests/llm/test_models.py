"""Operators 2 and 5: held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pytest

from quadrille.llm import langid, quality
from quadrille.llm.common import table

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_language_odd_rows(make_docs):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(50, "le chat et la souris", "fr"), (51, "the cat and the mouse", "en"), (52, "12 34", None), (None, "the", "de"), (51, "the cat", "en")]
    got = langid.identify(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 2, 52)] == ["und"] * 4 and by[0].score == 0
    assert by[None].held_out is False and {r.lang_pred for r in got} <= {"und", "en", "fr"}
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "no label")])).collect()} == {"und"}
    assert langid.identify(make_docs([])).count() == 0


def test_ngrams_do_not_cross_texts():
    alone = [sorted(np.concatenate(langid.ngrams([t], 1 << 12)[0]).tolist()) for t in ("ab", "", "cde", "f")]
    together, lengths = langid.ngrams(["ab", "", "cde", "f"], 1 << 12)
    assert sorted(np.concatenate(together).tolist()) == sorted(x for a in alone for x in a)
    assert [len(h) for h in together] == [int(s.sum()) for s in lengths]


def test_quality_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    good, bad = [r.score for r in got if truth[r.doc_id]], [r.score for r in got if not truth[r.doc_id]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [*enumerate(ODD), (5, "twice"), (None, "no id")]
    got = quality.classify(make_docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.classify(make_docs(rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(make_docs([]), labels).count() == 0


def test_collapsed_scores_are_the_network():
    c = quality.Classifier()
    texts = ["good words here", "bad bad bad bad!!", "other good words", "bad!! bad!!"] * 5
    c.fit(texts, np.array([1, 0, 1, 0] * 5))
    got = quality.score(c.collapsed(), [*texts[:4], ""])
    for text, s in zip([*texts[:4]], got, strict=False):
        codes, distinct, at, again = quality._words([text])
        bucket, by = quality._word_buckets(distinct)
        vectors = np.concatenate([c.vectors[bucket[by[w] : by[w + 1]]] for w in codes] + [c.vectors[[quality.REPEAT]]] * int(again.sum()))
        logits = c.layer @ vectors.mean(axis=0) + c.bias
        assert s == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])), abs=1e-4)


def test_language_against_plain_naive_bayes(spark):
    """Counts, smoothing, log-probabilities and posteriors, text by text."""
    import math
    from collections import Counter, defaultdict

    docs = table(spark, SF, "documents").filter("doc_id < 250")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    grams = {i: Counter(np.concatenate(langid.ngrams([t], langid.MAX_BUCKETS)[0]).tolist()) for i, t, _ in rows}
    counts, number = defaultdict(Counter), Counter()
    for i, _, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang] += grams[i]
            number[lang] += 1
    total = {lang: sum(c.values()) + 0.1 * langid.MAX_BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t):
            continue
        logs = {lang: math.log(number[lang] / sum(number.values())) + sum(n * math.log((counts[lang][g] + 0.1) / total[lang]) for g, n in grams[i].items()) for lang in counts}
        best = max(sorted(logs), key=logs.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(max(x - logs[best], -700)) for x in logs.values()), abs=1e-2)


def test_training_against_plain_descent(monkeypatch):
    """The same steps, word by word and n-gram by n-gram."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    texts, labels = ["good words here", "bad bad text", "", "more good words words", "bad"], [1, 0, 0, 1, 0]
    c = quality.Classifier()
    vectors, layer, bias = c.vectors.astype(np.float64), c.layer.astype(np.float64), c.bias.astype(np.float64)
    c.fit(texts, np.array(labels))
    rng = quality.Classifier().rng
    rng.uniform(-1, 1, 0)
    steps = 0
    for _ in range(2):
        for i in rng.permutation(len(texts)):
            rate, steps = quality.RATE * (1 - steps / 10), steps + 1
            features, split = [], texts[i].split()
            for k, w in enumerate(split):
                bucket, at = quality._word_buckets([w])
                features += bucket[at[0] : at[1]].tolist() + [quality.REPEAT] * (k > 0 and split[k - 1] == w)
            often = {f: features.count(f) / len(features) for f in features}
            mean = sum((vectors[f] * n for f, n in often.items()), np.zeros(quality.DIM))
            logits = layer @ mean + bias
            error = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            error[labels[i]] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= rate * error
            for f, n in often.items():
                vectors[f] -= rate * n / max(often.values()) * back
    assert np.allclose(c.layer, layer, atol=1e-4) and np.allclose(c.bias, bias, atol=1e-4) and np.allclose(c.vectors, vectors, atol=1e-4)


def test_features_of_a_sample_are_held_narrow():
    """The driver holds six bytes at most for each feature of usual texts, in one array for many texts; counts that need more get more."""
    words = [f"word{k}" for k in range(3000)]
    texts = [" ".join(words[k : k + 300]) for k in range(0, 2700, 30)]
    held = quality._features(texts)
    index, count = held[0]
    assert index.dtype == np.int32 and count.dtype.itemsize <= 2
    assert index.base is held[-1][0].base and count.base is held[-1][1].base
    assert [len(i) for i, _ in held] == [len(c) for _, c in held]
    _, often = quality._features(["a " * 70000])[0]
    assert often.max() >= 69999
