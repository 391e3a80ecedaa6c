"""Running values over ranges of one order, and the packed tree, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import packed_tree, scans


@pytest.fixture(scope="module", autouse=True)
def several_ranges(spark):
    """Else ranges this small would be joined into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    return [(k, rng.randrange(-5, 6), rng.choice([None, None, 1, 2, 3])) for k in rng.sample(range(10_000), 700)]


def test_running_values(spark, rows):
    df = spark.createDataFrame(rows, "at bigint, v bigint, w bigint").repartition(7)
    placed = scans.placed(df, "at")
    assert placed.select(scans.RANGE).distinct().count() > 1
    out = scans.running(placed, s=("sum", F.col("v"), False), m=("max", F.col("v"), True), l=("last", F.col("w"), True), b=("last", F.col("w"), False))
    total, most, last = 0, None, None
    for r in sorted(out.collect(), key=lambda r: r.at):
        assert (r.s, r.b) == (total, last)
        total, most, last = total + r.v, r.v if most is None else max(most, r.v), last if r.w is None else r.w
        assert (r.m, r.l) == (most, last)
    ranks = {r.at: r["rank"] for r in scans.ranked(df, "at").collect()}
    assert ranks == {at: k for k, at in enumerate(sorted(r[0] for r in rows))}


def test_no_single_partition(spark, rows):
    """Only a row for each range goes to one task."""
    out = scans.running(scans.placed(spark.createDataFrame(rows, "at bigint, v bigint, w bigint"), "at"), s=("sum", F.col("v"), True))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window" in line and scans.RANGE not in line]
    assert not whole
    assert scans.ranked(spark.createDataFrame([], "at bigint"), "at").count() == 0


def test_sequences(spark):
    rng = random.Random(3)
    values = [(g, k, rng.choice([None, "a", "b"])) for g in range(3) for k in range(200)]
    got = sorted(tuple(r) for r in scans.fill_runs(spark.createDataFrame(values, "g int, at bigint, v string"), ["g"], "at", "v").select("g", "v", "start", "length").collect())
    want = []
    for g in range(3):
        for _, k, v in (r for r in values if r[0] == g and r[2] is not None):
            if want and want[-1][:2] == [g, v]:
                want[-1][3] = k - want[-1][2] + 1
            else:
                want.append([g, v, k, 1])
    assert got == sorted(map(tuple, want))
    parts = [(g, s, s + rng.randrange(0, 12)) for g in range(3) for s in rng.sample(range(900), 120)]
    merged, cost = [], {g: 0 for g in range(3)}
    for g, s, e in sorted(parts):
        if merged and merged[-1][0] == g and s <= merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([g, s, e])
    df = spark.createDataFrame(parts, "g int, s bigint, e bigint")
    assert sorted(tuple(r) for r in scans.merge_intervals(df, ["g"]).collect()) == sorted(map(tuple, merged))
    proper = [p for p in parts if p[1] < p[2]]
    for g, s, _ in proper:
        cost[g] += sum(a < s < b for h, a, b in proper if h == g)
    assert {r.g: r.cost for r in scans.sweep_cost(spark.createDataFrame(proper, "g int, s bigint, e bigint"), ["g"]).collect()} == cost


@pytest.mark.parametrize("n", [1, 5, 17, 400])
def test_packed_tree(spark, tmp_path, n):
    rng = random.Random(n)
    boxes = [(k, x, y, x + rng.randrange(0, 30), y + rng.randrange(0, 9)) for k in range(n) for x, y in [(rng.randrange(-200, 200), rng.randrange(0, 300))]]
    tree = packed_tree.load(spark.createDataFrame(boxes, "id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"), 4)
    packed_tree.write(tree, str(tmp_path / "t"))
    tree = packed_tree.read(spark, str(tmp_path / "t"), 4)
    nodes = tree.nodes.collect()
    assert max(r.n for r in nodes if r.level == 0) <= 4 and [r.n for r in nodes if r.level == tree.levels - 1] == [n]
    windows = [(0, -50, 50, 60, 120), (1, -10**6, -10**6, 10**6, 10**6), (2, 999, 999, 1000, 1000)] + [(10 + k, *b[1:]) for k, b in enumerate(boxes[:5])]
    got = {tuple(r) for r in packed_tree.search(tree, spark.createDataFrame(windows, "q int, x1 bigint, y1 bigint, x2 bigint, y2 bigint")).collect()}
    assert got == {(q, b[0]) for q, x1, y1, x2, y2 in windows for b in boxes if b[1] <= x2 and x1 <= b[3] and b[2] <= y2 and y1 <= b[4]}
    if n == 400:
        packed = sum(r.overlap for r in packed_tree.sibling_overlap(tree).collect())
        order = rng.sample(boxes, n)  # leaves of boxes that happen to follow each other are worse
        loose = [[min(b[1] for b in p), min(b[2] for b in p), max(b[3] for b in p), max(b[4] for b in p)] for p in (order[k : k + 4] for k in range(0, n, 4))]
        share = sum(max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1])) for k in range(0, len(loose), 4) for i, a in enumerate(loose[k : k + 4]) for b in loose[k : k + 4][i + 1 :])
        assert packed < share / 2
