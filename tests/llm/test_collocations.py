"""Operator 11 against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadrille.llm import bitmaps, collocations

from .conftest import ODD


def brute(rows, least, top):
    """rows: (text, lang)."""
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(a, inside[p[i : i + m]])
        best = []
        for p, a in found.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def mined(spark, rows, least, top=2000, automaton=collocations.AUTOMATON):
    docs = spark.createDataFrame([(i, t, lang, "x", 0) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, rank int")
    return sorted(tuple(r) for r in collocations.mine(docs, least, top, automaton).collect())


def texts(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Aa", "é", "中文", "x\x00y", "a\x1cb"]
    phrases = [" ".join(rng.choices(words, k=rng.randrange(2, 6))) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(0, 40))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!? "]) for p in parts), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + rows[:5]


@pytest.mark.parametrize("seed,least,top", [(1, 5, 2000), (2, 12, 7)])
def test_collocations(spark, seed, least, top):
    rows = texts(seed) + [(t, "en") for t in ODD]
    want = brute(rows, least, top)
    assert len(want) > 20
    assert mined(spark, rows, least, top) == want


def test_narrow_sketch_and_small_blocks(spark, monkeypatch):
    """A sketch whose counters are all heavy, many automata and early flushes change nothing."""
    monkeypatch.setattr(collocations, "BUCKETS", 17)
    monkeypatch.setattr(bitmaps, "BLOCK", 9)
    monkeypatch.setattr(collocations, "WORD_BITS", 16)
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "MEMO", 20)
    monkeypatch.setattr(collocations, "SPAN", 100)
    rows = texts(3, 60)
    assert mined(spark, rows, 4, automaton=900) == brute(rows, 4, 2000)


def test_overlaps_and_wide_numbers(spark):
    """a a a counts twice; ties of cuts go to the first; a very long text is one piece."""
    rows = [("a a a a b. A A", "x"), ("z " * 300_000, "y"), (None, None), ("", "x")]
    assert mined(spark, rows, 2) == brute(rows, 2, 2000)


def test_nothing_common(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [("a b c", "x")], 2) == []


@pytest.mark.parametrize("known", [collocations.KNOWN, 500])
def test_common_phrases_are_listed_by_few_tasks(spark, monkeypatch, known):
    """Each of 64 tasks holds all phrases: what two of them have listed isn't listed again, and no phrase is lost."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices("abcdefgh", k=30)), "en") for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(64)
    listed, counts = collocations._listed, []

    def counted(*args):
        out = listed(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(collocations, "_listed", counted)
    monkeypatch.setattr(collocations, "KNOWN", known)
    found = sorted(tuple(r) for r in collocations.mine(docs, 20).collect())
    assert found == brute(rows, 20, 2000)
    assert len(counts) == 2
    if known > 500:
        assert sum(counts) < 5000  # some 27000 if each task lists all that it has


def test_counts_leave_tasks_as_counters(spark):
    """32 tasks that hold 64 phrases each give a row a task, not one for each phrase."""
    docs = spark.createDataFrame([(" ".join(f"a{k} b" for k in range(64)), "en")] * 640, "text string, lang string").repartition(32)
    phrases = spark.sparkContext.broadcast([f"a{k} b" for k in range(64)])
    assert collocations._places(docs, phrases).count() <= 32
    assert sorted(tuple(r) for r in collocations._occurrences(docs, phrases).collect()) == sorted(("en", p, 640) for p in phrases.value)


def test_one_scan_counts_all_candidates(spark, monkeypatch):
    """Candidates of many automata are counted at once."""
    scans, rows = [], texts(4, 60)
    monkeypatch.setattr(collocations, "_occurrences", lambda *_: scans.append(1))
    assert mined(spark, rows, 4, automaton=900) == brute(rows, 4, 2000)
    assert not scans


@pytest.mark.parametrize("hashed", [6, 64])
def test_phrases_that_share_a_hash(spark, monkeypatch, hashed):
    """With hashes of few bits nearly all candidates are counted by their words."""
    monkeypatch.setattr(collocations, "HASHED", hashed)
    monkeypatch.setattr(bitmaps, "SUMMED", 3)
    rows = texts(5, 60)
    assert mined(spark, rows, 4, automaton=2000) == brute(rows, 4, 2000)


def test_long_words_and_zero_bytes(spark):
    """Words of more than eight bytes, and words that differ by their length or by zero bytes alone."""
    rows = [("a a\x00 b a\x00\x00 b\x01 abcdefghi abcdefghij abcdefgh\x00 abcdefgh " * k, "x") for k in (1, 2, 5)]
    assert mined(spark, rows, 2) == brute(rows, 2, 2000)


def test_blocks_of_bits_are_made_in_one_job(spark):
    """The driver reads what tasks have written, and doesn't run the 64 tasks one after the other."""
    rows = bitmaps.merged(spark.range(100).mapInArrow(lambda batches: (bitmaps.counter_rows(b["id"].to_numpy() << 21) for b in batches), bitmaps.COUNTERS), 1, 28)
    spark.sparkContext.setJobGroup("bits", "bits")
    bits = bitmaps.bitmap(rows, 28)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [k for k in range(128) if bitmaps.bit(bits, np.array([k << 21]))[0]] == list(range(100))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bits")) < 32
