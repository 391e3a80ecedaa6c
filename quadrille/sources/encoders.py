"""Cells written as files, and maps made of moved cells: the decoders of `binary` the other way round."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import BLOCK_SIZE, CELL_BLOCKS
from .binary import BODY_MAGIC, FORMATS, HEADER_MAGIC

FILE = "path string, name string, content binary"


def _ints(*values: int) -> bytes:
    return struct.pack(f"<{len(values)}I", *(v & 0xFFFFFFFF for v in values))


def header(h: dict) -> bytes:
    """The bytes of a cell header, as `binary.header` reads them."""
    new = h["version"] > 0
    parts = [HEADER_MAGIC if new else b"", _ints(h["version"], len(h["tiles"])), *(t.encode() + b"\n" for t in h["tiles"]), b"" if new else b"\0"]
    parts.append(_ints(h["width"], h["height"], *((h["minlayer"], h["maxlayer"] - 1) if new else (h["maxlayer"],)), len(h["rooms"])))
    for r in h["rooms"]:
        parts += [r["name"], b"\n", _ints(r["layer"], len(r["rects"]), *(q[c] for q in r["rects"] for c in "xywh"), len(r["objects"]), *(o[c] for o in r["objects"] for c in ("type", "x", "y")))]
    parts.append(_ints(len(h["buildings"]), *(v for b in h["buildings"] for v in (len(b["rooms"]), *b["rooms"]))))
    return b"".join([*parts, *(bytes(column) for column in h["zpop"])])


def body(version: int, low: int, high: int, squares: pd.DataFrame) -> bytes:
    """The bytes of a cell's body, as `binary.body` reads them; squares (sx, sy within the cell, layer, room, pos, code).

    Each block's words are laid out at once: where a square's words begin follows from running sums of their numbers.
    """
    size, side = BLOCK_SIZE[FORMATS[version]], CELL_BLOCKS[FORMATS[version]]
    end = (high - low) * size * size
    sx, sy, layer, room, pos, code = (squares[c].to_numpy(np.int64) for c in ("sx", "sy", "layer", "room", "pos", "code"))
    if len(sx) and not (min(sx.min(), sy.min()) >= 0 and max(sx.max(), sy.max()) < size * side and layer.min() >= low and layer.max() < high):
        raise ValueError("a square lies outside of its cell")
    block, at = sx // size * side + sy // size, ((layer - low) * size + sx % size) * size + sy % size
    order = np.lexsort((pos, at, block))
    block, at, room, code = block[order], at[order], room[order], code[order]
    first = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(at) != 0))) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(at)))
    block, at, room = block[first], at[first], room[first]
    fresh = np.append(True, np.diff(block) != 0)[: len(block)]
    gap = at - np.where(fresh, -1, np.append(-1, at[:-1])[: len(at)]) - 1
    own = np.where(gap > 0, 2, 0) + 2 + count
    tail = np.full(side * side, end)
    np.minimum.at(tail, block, end - 1 - at)
    used = np.bincount(block, own, side * side).astype(np.int64) + np.where(tail > 0, 2, 0)
    start = np.cumsum(used) - used
    before = np.cumsum(own) - own
    p = start[block] + before - (before[fresh][np.cumsum(fresh) - 1] if len(block) else 0)
    words = np.zeros(used.sum(), "<i4")
    some = gap > 0
    words[p[some]], words[p[some] + 1] = -1, gap[some]
    p = p + np.where(some, 2, 0)
    words[p], words[p + 1] = count + 1, room
    words[np.repeat(p + 2, count) + np.arange(len(code)) - np.repeat(first, count)] = code
    rest = np.flatnonzero(tail > 0)
    words[start[rest] + used[rest] - 2], words[start[rest] + used[rest] - 1] = -1, tail[rest]
    head = (BODY_MAGIC + _ints(version) if version else b"") + _ints(side * side)
    table = np.zeros((side * side, 2), "<u4")
    table[:, 0] = len(head) + table.nbytes + 4 * start
    return head + table.tobytes() + words.tobytes()


def encoded(squares: DataFrame, headers: DataFrame, folder: str = "/maps") -> DataFrame:
    """Files (path, name, content) of cells: a header and a body each.

    `squares` are named ones (cx, cy, sx and sy in the world, layer, room, pos, tile); `headers` are decoded. A cell's
    dictionary is made anew from the names on its squares, wherever these come from; it is read from no header. Squares
    without a name, or of cells without header, are left out; cells without squares get a body of gaps. A cell is one
    task's, and bounded by its format.
    """
    heads = headers.filter("error is null").drop("error", "tiles")
    named = squares.filter("tile is not null").drop("code")
    words = named.groupBy("cx", "cy").agg(F.array_sort(F.collect_set("tile")).alias("tiles"))
    codes = named.join(words.select("cx", "cy", F.posexplode("tiles").alias("code", "tile")), ["cx", "cy", "tile"]).select("cx", "cy", "sx", "sy", "layer", "room", "pos", "code")
    full = heads.join(words, ["cx", "cy"], "left").withColumn("tiles", F.coalesce("tiles", F.array().cast("array<string>")))

    def head_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in batch.to_pylist():
                name = f"{h['cx']}_{h['cy']}.lotheader"
                yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "name": name, "content": header(h)}])

    def body_file(head: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if head.empty:
            return pd.DataFrame({"path": [], "name": [], "content": []})
        h = head.iloc[0]
        cell = BLOCK_SIZE[FORMATS[h.version]] * CELL_BLOCKS[FORMATS[h.version]]
        name = f"world_{h.cx}_{h.cy}.lotpack"
        local = rows.assign(sx=rows["sx"] - h.cx * cell, sy=rows["sy"] - h.cy * cell)
        return pd.DataFrame({"path": [f"{folder}/{name}"], "name": [name], "content": [body(int(h.version), int(h.minlayer), int(h.maxlayer), local)]})

    sizes = heads.select("cx", "cy", "version", "minlayer", "maxlayer").groupBy("cx", "cy")
    bodies = sizes.cogroup(codes.groupBy("cx", "cy")).applyInPandas(body_file, FILE)
    return full.mapInArrow(head_files, FILE).unionByName(bodies)


def moves(spark: SparkSession, items: Sequence) -> DataFrame:
    """(ord, cx, cy, tx, ty) of the cells that items name, in their order.

    An item is a cell (x, y), which stays where it is, or a dictionary of src, dst or offset (not both; neither: it
    stays) and size, by default one cell. A ValueError says what is wrong with one.
    """

    def pair(value, field: str) -> tuple[int, int]:
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ValueError(f"{field} takes two numbers, not {value!r}")
        return int(value[0]), int(value[1])

    rows = []
    for k, item in enumerate(items):
        item = item if isinstance(item, dict) else {"src": item}
        if "dst" in item and "offset" in item:
            raise ValueError(f"an item takes dst or offset: {item!r}")
        (x, y), (w, h) = pair(item.get("src"), "src"), pair(item.get("size", (1, 1)), "size")
        if w < 1 or h < 1:
            raise ValueError(f"size takes numbers from 1 on, not {item['size']!r}")
        dx, dy = pair(item["offset"], "offset") if "offset" in item else (0, 0)
        if "dst" in item:
            dx, dy = (b - a for a, b in zip((x, y), pair(item["dst"], "dst"), strict=True))
        rows.append((k, x, y, w, h, dx, dy))
    frame = spark.createDataFrame(rows, "ord int, x int, y int, w int, h int, dx int, dy int")
    cells = frame.withColumn("cx", F.explode(F.expr("sequence(x, x + w - 1)"))).withColumn("cy", F.explode(F.expr("sequence(y, y + h - 1)")))
    return cells.select("ord", "cx", "cy", (F.col("cx") + F.col("dx")).alias("tx"), (F.col("cy") + F.col("dy")).alias("ty"))


NAME = r"^(world_|biomemap_|)(\d+)_(\d+)(\.\w+)$"


def moved(files: DataFrame, moves_: DataFrame, folder: str = "/maps") -> DataFrame:
    """Files (path, name, content) under the names of the cells that they move to.

    Of files that come to one name, the last item's stays; an item whose source has no such file changes nothing. Sources
    are settled on names, before contents travel. Files of other names drop out.
    """
    part = lambda i: F.regexp_extract("name", NAME, i)
    known = files.filter(F.col("name").rlike(NAME)).select("name", part(1).alias("kind"), part(2).try_cast("int").alias("cx"), part(3).try_cast("int").alias("cy"), part(4).alias("ending"))
    target = F.format_string("%s%d_%d%s", "kind", "tx", "ty", "ending")
    last = known.join(moves_, ["cx", "cy"]).groupBy(target.alias("to")).agg(F.max_by("name", "ord").alias("name"))
    return files.join(last, "name").select(F.concat(F.lit(f"{folder}/"), "to").alias("path"), F.col("to").alias("name"), "content")
