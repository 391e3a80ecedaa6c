"""The near-copy stage against brute force over sets of shingles."""

import random

import pytest

import corpus_pipeline
from quadrille.llm import similar

SF = "/root/testdata/sf0.01"


def brute_kept(rows):
    """(id, text) of the rows that stay, once each, over texts with words and rows with ids."""
    least = {}
    for i, t in rows:
        least[t] = min(least.get(t, i), i)
    texts = sorted(least)
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    return {min(least[texts[i]] for i in g) for g in groups.values()}


def edited(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.randrange(1, 200))
        rows.append((i * 7 % n, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [similar.TILE, 4])
def test_edited_copies(make_docs, tile):
    rows = edited(1)
    got = [r.doc_id for r in similar.without_copies(make_docs(rows), tile).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_kept(rows)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()} == brute_kept(rows)


def test_many_near_copies(make_docs):
    """In tiles of 16 a large group still comes together."""
    base = [f"b{k}" for k in range(120)]
    rows = [(k + 1, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for k in range(100)] + [(500, "alone in the world of words")]
    assert {r.doc_id for r in similar.without_copies(make_docs(rows), 16).collect()} == {1, 500}


def test_ids_and_texts(make_docs):
    long = " ".join(f"t{k}" for k in range(60))
    rows = [(1, long), (2, long + " more"), (2, "a text of its own under the same id"), (3, "again and again"), (3, "again and again"), (None, long), (4, ""), (5, " \n")]
    got = sorted(((r.doc_id, r.text) for r in similar.without_copies(make_docs(rows)).collect()), key=str)
    assert got == sorted([(1, long), (2, "a text of its own under the same id"), (3, "again and again"), (None, long), (4, "")], key=str)


def test_pairs_found(spark):
    """Of all pairs of texts with a similarity of 0.8 or more, found by comparing all: at least 0.99 are candidates or linked already."""
    import numpy as np

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").select("text").distinct().collect()]
    extra = []
    rng = random.Random(3)
    for t in texts:
        w = t.split()
        if len(w) > 40:
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            extra.append(" ".join(w))
    both = texts + extra
    sets = similar.sets(both)
    pairs = [(i, len(texts) + k) for k, i in enumerate(i for i, t in enumerate(texts) if len(t.split()) > 40)]
    near = [(a, b) for a, b in pairs if similar.similar(sets[a], sets[b])]
    hashes, at = similar.shingles(both)[0]
    cells = similar.bands(hashes, at)
    three = similar.majority(*similar.shingles(both, (3,))[0])
    found = [(cells[a] == cells[b]).any() and np.bitwise_count(three[a] ^ three[b]) <= similar.RADIUS for a, b in near]
    assert len(near) > 500 and np.mean(found) >= 0.99


def test_unlike_members_of_a_large_cluster(make_docs):
    """Texts of one pattern that are mostly below 0.8 to each other, in tiles of 8."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    want = brute_kept(rows)
    assert 3 < len(want) < 80
    for tile in (similar.TILE, 8):
        assert {r.doc_id for r in similar.without_copies(make_docs(rows), tile).collect()} == want


def test_shingles_of_short_texts():
    a = similar.sets(["one two", "ONE  two", "one two three four five", "", "one two three four five six"])
    assert [len(x) for x in a] == [1, 1, 1, 0, 2] and a[0][0] == a[1][0] and a[2][0] in a[4]


def test_clashing_columns(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(1, "some words here"), (2, "some words here"), (3, None)])
    for c in ("_id", "_key", "_n", "key", "cell", "fp", "size", "least", "component"):
        docs = docs.withColumn(c, F.lit("kept"))
    out = similar.without_copies(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r["_id"], r["_n"]) for r in out.collect()) == [(1, "kept", "kept"), (3, "kept", "kept")]
