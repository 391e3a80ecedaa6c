"""What encoders write, decoders read; moves of cells."""

import random

import numpy as np
import pandas as pd
import pytest

from quadrille.sources import binary, encoders

SIDES = {0: (10, 30), 1: (8, 32)}


@pytest.mark.parametrize("version", (0, 1))
@pytest.mark.parametrize("n", (0, 1, 40, 3000))
def test_body_round_trip(version, n):
    size, side = SIDES[version]
    low, high = (0, 3) if version == 0 else (-2, 2)
    rng = random.Random(n)
    places = {(rng.randrange(size * side), rng.randrange(size * side), rng.randrange(low, high)) for _ in range(n)}
    if n > 1:
        places |= {(0, 0, low), (size * side - 1, size * side - 1, high - 1), (0, 1, low), (size - 1, size - 1, high - 1)}  # no gap before, after or between
    rows = [(*p, room, k, rng.randrange(99)) for p in places for room in [rng.randrange(-1, 5)] for k in range(rng.randrange(1, 4))]
    columns = ["sx", "sy", "layer", "room", "pos", "code"]
    frame = pd.DataFrame(rows, columns=columns, dtype=np.int64).sample(frac=1, random_state=1)
    got = binary.body(encoders.body(version, low, high, frame), version, low, high)
    assert sorted(zip(*(got[c].tolist() for c in columns), strict=True)) == sorted(rows)


def test_square_outside():
    with pytest.raises(ValueError, match="outside"):
        encoders.body(1, 0, 1, pd.DataFrame([[256, 0, 0, 0, 0, 0]], columns=["sx", "sy", "layer", "room", "pos", "code"]))


@pytest.mark.parametrize("version", (0, 1))
def test_header_round_trip(version):
    side = SIDES[version][1]
    room = {"id": 0, "name": b"hall", "layer": -1 if version else 0, "rects": [{"x": 1, "y": 2, "w": 3, "h": 4}, {"x": -5, "y": 0, "w": 1, "h": 1}], "objects": [{"type": 7, "x": 1, "y": 2}]}
    h = {"version": version, "tiles": ["a_1", "b ü"], "width": 8, "height": 9, "minlayer": -2 if version else 0, "maxlayer": 3, "rooms": [room, room | {"id": 1, "rects": [], "objects": []}], "buildings": [{"id": 0, "rooms": [0, 1]}], "zpop": [[(i * j) % 256 for j in range(side)] for i in range(side)]}
    assert binary.header(encoders.header(h)) == h


def test_moves(spark):
    got = encoders.moves(spark, [(4, 5), {"src": (0, 0), "offset": [-2, 3], "size": (2, 1)}, {"src": (1, 1), "dst": (9, 9)}]).collect()
    assert sorted(map(tuple, got)) == [(0, 4, 5, 4, 5), (1, 0, 0, -2, 3), (1, 1, 0, -1, 3), (2, 1, 1, 9, 9)]
    for item in ({"src": (0, 0), "dst": (1, 1), "offset": (1, 1)}, {"src": (0, 0), "size": (0, 1)}, {"src": (1,)}, {"dst": (1, 1)}):
        with pytest.raises(ValueError):
            encoders.moves(spark, [item])


def test_last_item_with_a_file_stays(spark):
    files = spark.createDataFrame([(f"/a/{n}", n, n.encode()) for n in ("world_1_1.lotpack", "1_1.lotheader", "world_2_2.lotpack", "streets.xml")], encoders.FILE)
    got = encoders.moved(files, encoders.moves(spark, [{"src": (1, 1), "dst": (7, 7)}, {"src": (2, 2), "dst": (7, 7)}, {"src": (3, 3), "dst": (7, 7)}]), "/b")
    assert {r.path: bytes(r.content) for r in got.collect()} == {"/b/world_7_7.lotpack": b"world_2_2.lotpack", "/b/7_7.lotheader": b"1_1.lotheader"}
