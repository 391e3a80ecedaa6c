"""Operators 8 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quadrille.llm import components, simhash, substring_dedup

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(rows):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    long = [" ".join(rng.choices(words, k=rng.randrange(40, 140))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(2)]
        if rng.random() < 0.7:
            part = rng.choice(long).split()
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            parts.insert(1, " ".join(part[rng.randrange(0, 5) :]))
        if rng.random() < 0.2:
            parts.append("rep " * rng.randrange(45, 70))
        rows.append((i * 3 % n, rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows + [(i + n, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 2, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(make_docs, monkeypatch, seed, group):
    """Anchors with more segments than group go through all lengths of anchors; the result is the same."""
    monkeypatch.setattr(substring_dedup, "INDEX_WORDS", 300)
    rows = passages(seed) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1007, ODD[6]), (None, ODD[6]), (7, None)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(make_docs(rows), group).collect()]
    assert sorted(got, key=str) == brute_dedup(rows)


def test_common_passage(make_docs):
    """One passage in the middle of many different texts: many segments share its anchors."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(70)]
    rows = [(i, " ".join([*rng.choices("abcdefgh", k=rng.randrange(30, 60)), *passage[: rng.randrange(48, 71)], *rng.choices("abcdefgh", k=rng.randrange(30))])) for i in range(80)]
    for group in (substring_dedup.GROUP, 8):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(make_docs(rows), group).collect()]
        assert sorted(got, key=str) == brute_dedup(rows)


def test_repeated_rows_count_once(make_docs):
    """A text that is repeated under one id has the same spans as one row of it, and each row gets them."""
    rng = random.Random(6)
    text = " ".join(rng.choices([f"w{k}" for k in range(500)], k=3000))
    once = substring_dedup.with_spans(make_docs([(1, text), (2, text)])).filter("doc_id = 2").first()["_spans"]
    many = substring_dedup.with_spans(make_docs([(1, text)] * 3 + [(2, text)] * 200)).filter("doc_id = 2").collect()
    assert len(many) == 200 and {len(r["_spans"]) for r in many} == {len(once)}


def test_long_text_and_clashing_columns(make_docs):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    text = " ".join(rng.choices([f"w{k}" for k in range(5000)], k=60_000))
    rows = [(1, text), (2, "new words before " + text), (3, " ".join(text.split()[30_000:30_060]))]
    docs = make_docs(rows).withColumn("_id", F.lit("x")).withColumn("_KEY", F.lit("y")).withColumn("keeper", F.lit(0)).withColumn("wanted", F.lit(0))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(docs).collect()]
    assert sorted(got, key=str) == brute_dedup(rows)
    assert [(r["_id"], r["_KEY"]) for r in substring_dedup.with_spans(docs).select("_id", "_KEY").distinct().collect()] == [("x", "y")]


def test_substring_dedup_empty(make_docs):
    assert substring_dedup.deduplicate(make_docs([])).count() == 0


def test_index_counts_occurrences():
    rng = np.random.default_rng(0)
    parts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(30)]
    index = substring_dedup.FMIndex(parts, np.arange(30))
    for _ in range(200):
        pattern = rng.integers(1, 5, rng.integers(1, 6))
        low, high = np.array([0]), np.array([index.n])
        for code in pattern[::-1]:
            low, high = index.extend(np.array([code]), low, high)
        holders = [k for k, p in enumerate(parts) for i in range(len(p) - len(pattern) + 1) if (p[i : i + len(pattern)] == pattern).all()]
        assert high[0] - low[0] == len(holders)
        if holders:
            assert index.documents[index.owners.least(low, high)[0]] == min(holders)


def test_text_without_spans_keeps_the_rest():
    text = " a  b\tc d\n e "
    assert substring_dedup.without_spans(text, [{"a": 1, "b": 3}]) == " a d\n e "
    assert substring_dedup.without_spans(text, None) == text


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius=3):
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f"{f:016x}", least[find(f)]) for i, f in pairs}


def test_simhash_query(make_docs):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(0, 200, 4):
        base = rng.choices(words, k=rng.randrange(1, 300))
        for j in range(4):
            own = list(base)
            if j > 1:
                own[rng.randrange(len(own))] = "Edit"
            rows.append((i + j, " ".join(own)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1])]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs([*rows, (None, "x y")])).collect()}
    assert (None, f"{brute_fingerprint('x y'):016x}", None) in got
    assert {g for g in got if g[0] is not None} == brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert simhash.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize(("blocks", "tile"), [(4, 1024), (4, 16), (5, 16), (6, 8)])
def test_near_links_find_all(spark, blocks, tile):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {0}
    for c in centres.tolist() + [0] * 60:  # chains from centres, and one crowd that shares blocks
        x = int(c)
        for _ in range(6):
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    pairs = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in pairs], "fp long, rep long")
    reach = {r.id: r.component for r in components.components(simhash.near_links(df, 3, blocks, tile)).collect()}
    assert {(i, f"{f:016x}", reach.get(i, i)) for i, f in pairs} == brute_components(pairs)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 100), (7, 7), (200, 150)]
    got = {(r.id, r.component) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(90, 90), (100, 90), (150, 150), (200, 150)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
