"""Operator 13 against plain Python that runs every order."""

import random
import re
from itertools import permutations

import pytest

from quadrille.llm import filter_audit

from .conftest import ODD

LABELS = "doc_id bigint, quality int, toxic int, part string"


def brute(rows, labels):
    """rows: (doc_id, text, source)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        good = any(x[0] == i and x[1] == 1 for x in labels if i is not None)
        toxic = any(x[0] == i and x[2] == 1 for x in labels if i is not None)
        fails.append((source or "", {k for k, v in f.items() if v}, good, toxic))
    out, removed = {}, {}
    for part in {x[0] for x in fails}:
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                own = [x for x in fails if x[0] == part and f in x[1]]
                out[part, "".join(order), step] = [len(left), len(lost), len(own) - len(lost), sum(x[1] == {f} for x in own), sum(x[2] for x in lost), sum(x[3] for x in lost)]
                removed[part, f] = removed.get((part, f), 0) + len(lost)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, part string, n bigint")
    got = filter_audit.audit(docs, spark.createDataFrame([(*x, "y") for x in labels], LABELS)).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got}


def test_all_orders(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)] + ["The", "A#", "LOUD", "5%"]
    rows = []
    for i in range(120):
        t = " ".join(rng.choices(words[: rng.choice([20, 300, 404])], k=rng.choice([3, 150, 210, 400])))
        rows.append((i, t, rng.choice(["s1", "s2", "s1", None])))
    rows += [(500 + i, rows[rng.randrange(120)][1], "s1") for i in range(30)]  # copies
    rows += [(600 + i, t, "odd") for i, t in enumerate(ODD)]
    rows += [(None, rows[0][1], "s2"), (None, None, None), rows[5], rows[5], (7, "another text under one id", "s2"), (0, None, "s3")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 600, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(2, "a B", "x"), (1, "a B", "x")]])
def test_small(spark, rows):
    assert run(spark, rows, []) == brute(rows, [])


def test_one_group_of_copies(spark):
    """A text that a third of all rows have, among them very long texts."""
    long = "word Word " * 200_000
    rows = [(i, "one and the same & more", "hot") for i in range(200)] + [(300 + i, f"{long}{i}", "long") for i in range(2)] + [(400 + i, f"text {i}", "cold") for i in range(50)]
    assert run(spark, rows, [(3, 1, 0)]) == brute(rows, [(3, 1, 0)])


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id bigint, text string, source string")
    plan = filter_audit.word_totals(filter_audit._keyed(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
