"""Repeated ids in operator 3."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import topk


@pytest.mark.parametrize("tile", [4096, 8])
def test_copies_of_one_id(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-8, 8, 4) / 8]) for i in range(60)]
    rows += [(1000, [float(k), 1.0, 1.0, 1.0]) for k in range(15)] + [(1001, [9.0, 9.0, 9.0, 3e8])] * 15
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    want = []
    for i, v in rows[:60:20]:
        best = {}
        for j, w in rows:
            if j != i:
                s = sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(v, w, strict=True))
                best[j] = max(best.get(j, s), s)
        want += [(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10])]
    assert sorted(map(tuple, topk.search(df, (F.col("vec_id") < 60) & (F.col("vec_id") % 20 == 0)).collect())) == sorted(want)
