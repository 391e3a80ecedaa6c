"""Operator 12: external induced sorting against sorted(), and what it removes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quadrille.llm import induced, substring_dedup, suffix_dedup
from quadrille.llm.common import mix64

from .conftest import ODD


def plain_order(text, ends, cap):
    t = text.tolist()
    order = sorted((i for i in range(len(t)) if t[i] >= ends), key=lambda i: t[i:])
    common = [0] * len(order)
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        while t[i + common[k]] == t[j + common[k]] and common[k] < cap:
            common[k] += 1
    return order, common


@pytest.mark.parametrize("memory,inside", [(4, False), (16, True), (64, False), (1 << 19, False), (1 << 19, True)])
def test_induced_sorting(memory, inside):
    """Texts many times the queue's memory: runs on disk, recursion to the last name, common prefixes up to a cap."""
    rng = random.Random(memory)
    for _ in range(60):
        letters, cap = rng.choice([1, 2, 3, 26]), rng.choice([3, 7, 100])
        strings = [bytes(rng.choices(range(97, 97 + letters), k=rng.choice([0, 1, 5, 20, 60]))) for _ in range(rng.choice([1, 2, 5, 12]))]
        strings += [strings[0] + b"ab", strings[-1]] if rng.random() < 0.5 else []
        text, _ = induced.joined(strings)
        got = list(induced.sort(text, len(strings), cap, memory, inside=inside))
        order = np.concatenate([np.zeros(0, int), *(p for p, _ in got)]).tolist()
        common = np.concatenate([np.zeros(0, int), *(c for _, c in got)]).tolist()
        assert (order, common) == plain_order(text, len(strings), cap)


def test_runs_go_to_disk():
    rng = random.Random(1)
    text, _ = induced.joined([bytes(rng.choices(b"abcd", k=3000)) for _ in range(4)])
    scratch = induced.Scratch(2000)
    sum(len(p) for p, _ in induced.sort(text, 4, 100, 256, scratch))
    assert scratch.files > 20


def brute(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 99):
            first.setdefault(b[k : k + 100], (i, k))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if i is not None and first[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def run(make_docs, rows, group=suffix_dedup.GROUP):
    return sorted((tuple(r) for r in suffix_dedup.deduplicate(make_docs(rows), group).collect()), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(30)]
    long = [" ".join(rng.choices(words, k=rng.randrange(20, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(2)]
        if rng.random() < 0.7:
            part = rng.choice(long)
            at = rng.randrange(len(part))
            parts.insert(1, part[:at] + rng.choice(["", "#"]) + part[at:])
        if rng.random() < 0.3:
            parts.append(rng.choice(["x", "ab", "abc "]) * rng.randrange(40, 160))
        rows.append((i * 7 % n, "\n".join(parts)))
    return rows + [(i + n, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize("seed,group", [(1, suffix_dedup.GROUP), (2, 2), (3, 1)])
def test_suffix_dedup(make_docs, monkeypatch, seed, group):
    """Small shards and anchors that are dealt again change nothing."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 3000)
    monkeypatch.setattr(suffix_dedup, "SPAN", 4000)
    rows = texts(seed) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, ODD[6]), (None, None)]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 30
    assert run(make_docs, rows, group) == want


def test_repeated_rows_are_one_document(make_docs):
    text = texts(4, 5)[0][1] + "y" * 300
    once = run(make_docs, [(1, text), (2, text)])
    assert run(make_docs, [(1, text), (2, text), (2, text)]) == sorted([*once, once[1]], key=str)


def test_group_of_copies_and_empty_table(make_docs):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(i, text) for i in range(300)] + [(500 + i, f"{i} {text} {i}") for i in range(40)]
    assert run(make_docs, rows, 8) == brute(rows)
    assert run(make_docs, []) == []


def test_hashes_of_runs_share_their_powers():
    """Powers are made once for all batches of a task, and hashes by them are those of plain sums; no run of bytes is built beyond its length."""
    rng = np.random.default_rng(3)
    powers, m = substring_dedup.Powers(), 1 << 64
    base, inverse = int(substring_dedup.BASE), pow(int(substring_dedup.BASE), -1, 1 << 64)
    for n in (50, 7, 80):
        mixed = mix64(rng.integers(1, 257, n).astype(np.uint64))
        prefix = substring_dedup.Prefix(mixed, powers)
        a, b = np.array([0, 2, n // 2]), np.array([n, 5, n])
        want = [sum(int(mixed[i]) * pow(base, i, m) for i in range(x, y)) * pow(inverse, x, m) + (y - x) * int(substring_dedup.BASE2) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert prefix(a, b).tolist() == mix64(np.array([w % m for w in want], np.uint64)).tolist()
    assert powers(60) is powers(7) and len(powers(60)[0]) == 81
    h = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for n in (1, 2, 3, 24, 31, 40):
        want = [sum(int(h[i + j]) * pow(base, n - 1 - j, m) for j in range(n)) % m for i in range(40 - n + 1)]
        assert substring_dedup.run_hashes(h, n, substring_dedup.BASE).tolist() == mix64(np.array(want, np.uint64)).tolist()
