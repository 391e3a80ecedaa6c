"""Binary world files as DataFrames (S1-S10, S16-S18): headers, cell bodies, prefabs, texture packs, save chunks.

Files are listed and read by Spark's binaryFile source, so that any file system works and a file is the unit of
parallel work; decoding runs batch-wise on the executors. A file that can't be decoded gives one row with its error and
no content (K11), and the rest goes on.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import BLOCK_SIZE, CELL_BLOCKS, LAYERS

# fixed values: magic numbers, and the mark that ends a version-0 page image
HEADER_MAGIC, BODY_MAGIC, PREFAB_MAGIC, PACK_MAGIC = b"LOTH", b"LOTP", b"PZBY", b"PZPK"
PAGE_END = b"\xef\xbe\xad\xde"
FORMATS = {0: "B41", 1: "B42"}

RECT = "struct<x:int,y:int,w:int,h:int>"
HEADER = f"cx int, cy int, version int, tiles array<string>, width bigint, height bigint, minlayer int, maxlayer int, rooms array<struct<id:int,name:binary,layer:int,rects:array<{RECT}>,objects:array<struct<type:int,x:int,y:int>>>>, buildings array<struct<id:int,rooms:array<bigint>>>, zpop array<array<int>>, error string"
SQUARES = "cx int, cy int, sx int, sy int, layer int, room int, pos int, code int, error string"
PREFAB = "path string, bx int, by int, x int, y int, layer int, attribute int, pos int, tile string, error string"
PAGE = "path string, page_no int, page string, has_alpha int, textures array<struct<name:string,x:int,y:int,w:int,h:int,ox:int,oy:int,ow:int,oh:int>>, png binary, error string"
PACK = "path string, page string, has_alpha int, name string, x int, y int, w int, h int, ox int, oy int, ow int, oh int, png binary, error string"


class Cursor:
    """Reads values one after another from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError(f"the file ends at {len(self.data)}, {n} bytes are due at {self.at}")
        self.at += n
        return out

    def ints(self, n: int, kind: str = "i") -> tuple[int, ...]:
        return struct.unpack(f"<{n}{kind}", self.take(4 * n))

    def int(self) -> int:
        return self.ints(1)[0]

    def uint(self) -> int:
        return self.ints(1, "I")[0]

    def until(self, mark: bytes) -> bytes:
        end = self.data.find(mark, self.at)
        if end < 0:
            raise ValueError(f"no {mark!r} after {self.at}")
        out, self.at = self.data[self.at : end], end + len(mark)
        return out

    def sized(self) -> bytes:
        return self.take(self.uint())

    def magic(self, mark: bytes) -> bool:
        if self.data[self.at : self.at + len(mark)] != mark:
            return False
        self.at += len(mark)
        return True

    def names(self) -> list[str]:
        return [self.until(b"\n").decode().strip() for _ in range(self.uint())]


def _rooms(c: Cursor) -> list[dict]:
    out = []
    for i in range(c.uint()):
        name, layer = c.until(b"\n"), c.int()
        rects = [dict(zip("xywh", c.ints(4), strict=True)) for _ in range(c.uint())]
        objects = [dict(zip(("type", "x", "y"), c.ints(3), strict=True)) for _ in range(c.uint())]
        out.append({"id": i, "name": name, "layer": layer, "rects": rects, "objects": objects})
    return out


def _buildings(c: Cursor) -> list[dict]:
    return [{"id": i, "rooms": list(c.ints(c.uint(), "I"))} for i in range(c.uint())]


def start(c: Cursor) -> dict:
    """The start of a cell header of either version, up to its layers, which are held to what the version allows."""
    c.magic(HEADER_MAGIC)  # files of the first version begin with its number
    version = c.uint()
    form = FORMATS[version]
    tiles = c.names()
    if version == 0:
        c.take(1)
    width, height = c.uint(), c.uint()
    low, high = (0, c.int()) if version == 0 else (c.int(), c.int() + 1)
    return {"version": version, "tiles": tiles, "width": width, "height": height, "minlayer": max(low, LAYERS[form][0]), "maxlayer": min(high, LAYERS[form][1])}


def header(data: bytes) -> dict:
    """A cell header of either version."""
    c = Cursor(data)
    out = start(c)
    side = CELL_BLOCKS[FORMATS[out["version"]]]
    return out | {"rooms": _rooms(c), "buildings": _buildings(c), "zpop": [list(c.take(side)) for _ in range(side)]}


def block(c: Cursor, size: int, layers: tuple[int, int], payload: Callable) -> Iterator[tuple[int, int, int, object]]:
    """(layer, x, y, payload) of a run-length coded block.

    Squares come in one order, by layer, x and y. A count of -1 is followed by how many squares to pass over, this one
    included; a count of 1 or less has no payload; any other has one of count - 1 items.
    """
    at, end = 0, (layers[1] - layers[0]) * size * size
    while at < end:
        count = c.int()
        if count == -1:
            at += max(c.int(), 1)
            continue
        if count > 1:
            rest = at % (size * size)
            yield layers[0] + at // (size * size), rest // size, rest % size, payload(c, count - 1)
        at += 1


def body(data: bytes, version: int, low: int, high: int) -> dict[str, np.ndarray]:
    """sx, sy (within the cell), layer, room, pos and code of all tiles of a cell's squares, as columns.

    Where a token of the run-length code ends depends on what it holds, so that tokens of all blocks are found by
    doubling: from the first 2^k tokens of each block, jumps over 2^k tokens lead to the next as many. What a token covers
    adds up to its square.
    """
    c = Cursor(data)
    own = c.uint() if c.magic(BODY_MAGIC) else 0
    if own != version:
        raise ValueError(f"header version {version}, body version {own}")
    size, side = BLOCK_SIZE[FORMATS[version]], CELL_BLOCKS[FORMATS[version]]
    blocks = c.uint()
    c.take(8 * blocks)
    starts = np.frombuffer(data, "<u4", 2 * blocks, c.at - 8 * blocks)[::2].astype(np.int64)
    if (starts % 4).any() or (starts > len(data)).any():
        raise ValueError("a block's offset is wrong")
    words = np.frombuffer(data, "<i4", len(data) // 4).astype(np.int64)
    n, end, square = len(words), (high - low) * size * size, size * size
    behind = np.append(words[1:], 1)
    step = np.where(words == -1, 2, np.where(words > 1, words + 1, 1))
    jump = np.append(np.minimum(np.arange(n) + step, n), n)  # the place behind the file leads to itself
    covers = np.append(np.where(words == -1, np.maximum(behind, 1), 1), 0)
    place = (starts // 4)[:, None]
    while end and blocks:
        done = covers[place].sum(axis=1) >= end
        if done.all():
            break
        if (~done & (place[:, -1] == n)).any():
            raise ValueError("the file ends within a block")
        place, jump = np.concatenate([place, jump[place]], axis=1), jump[jump]
    before = np.cumsum(covers[place], axis=1) - covers[place]
    held = (before < end) & (np.append(words, 0)[place] > 1)
    block, _ = np.nonzero(held)
    at, p = before[held], place[held]
    count = words[p] - 1
    if (p + count + 1 >= n).any():
        raise ValueError("the file ends within a square")
    token = np.repeat(np.arange(len(p)), count)
    pos = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
    own_at, own_block = at[token], block[token]
    inner = own_at % square
    return {"sx": own_block // side * size + inner // size, "sy": own_block % side * size + inner % size, "layer": low + own_at // square, "room": words[p + 1][token], "pos": pos, "code": words[p[token] + 2 + pos]}


def prefab(data: bytes) -> Iterator[tuple]:
    """(bx, by, x, y, layer, attribute, pos, tile) of a building prefab (S9); attributes give a row without pos and tile."""
    c = Cursor(data)
    if not c.magic(PREFAB_MAGIC):
        raise ValueError("no prefab")
    c.uint()
    tiles = c.names()
    width, height, layers = c.ints(3)
    _rooms(c), _buildings(c)
    table = c.at
    for k in range(width * height):
        own = Cursor(data, Cursor(data, table + 8 * k).uint())
        by, bx = divmod(k, width)
        for layer, x, y, attribute in block(own, 8, (0, layers), lambda c, n: c.int()):  # one value whatever the count
            yield bx, by, x, y, layer, attribute, None, None
        for layer, x, y, codes in block(own, 8, (0, layers), lambda c, n: c.ints(n)):
            for pos, code in enumerate(codes):
                yield bx, by, x, y, layer, None, pos, tiles[code]


def pack_pages(data: bytes) -> Iterator[tuple]:
    """(page, has_alpha, textures, png) of each page of a texture pack; a texture is (name, x, y, w, h, ox, oy, ow, oh)."""
    c = Cursor(data)
    version = c.uint() if c.magic(PACK_MAGIC) else 0
    if version not in (0, 1):
        raise ValueError(f"pack version {version}")
    for _ in range(c.uint()):
        page, count, alpha = c.sized().decode(), c.uint(), c.uint()
        textures = [(c.sized().decode(), *c.ints(8)) for _ in range(count)]
        yield page, alpha, textures, c.until(PAGE_END) if version == 0 else c.sized()


def pack(data: bytes) -> Iterator[tuple]:
    """(page, has_alpha, name, x, y, w, h, ox, oy, ow, oh, png) of a texture pack (S10); the image is on a page's first row."""
    for page, alpha, textures, png in pack_pages(data):
        for i, t in enumerate(textures):
            yield page, alpha, *t, None if i else png


def files(spark: SparkSession, path: str, pattern: str, glob: str = "*", digest: bool = False) -> DataFrame:
    """path, name, mtime (seconds), length, content and, if asked for, digest (SHA-256) of the files below a folder whose names match a regular expression.

    A glob of the names keeps other files from being listed and read; the expression alone only sorts out what was read.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return df.withColumn("name", name).filter(F.col("name").rlike(pattern)).select("path", "name", F.col("modificationTime").cast("double").alias("mtime"), "length", "content", *([F.sha2("content", 256).alias("digest")] if digest else []))


def coordinates(df: DataFrame, pattern: str) -> DataFrame:
    """Adds cx and cy, the two numbers in a file's name; null for other names."""
    part = lambda i: F.regexp_extract("name", pattern, i).try_cast("int")
    return df.withColumns({"cx": part(1), "cy": part(2)})


def _decoded(df: DataFrame, schema: str, rows: Callable) -> DataFrame:
    names = [f.name for f in _fields(df.sparkSession, schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch.itertuples(index=False):  # a file at a time bounds the memory
                try:
                    out = list(rows(file))
                except (ValueError, KeyError, IndexError, UnicodeDecodeError, struct.error) as e:
                    out = [{"cx": getattr(file, "cx", None), "cy": getattr(file, "cy", None), "path": file.path, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names, dtype=object)

    return df.mapInPandas(run, schema)


def _fields(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


HEADER_NAME = r"^(\d+)_(\d+)\.lotheader$"
BODY_NAME = r"^world_(\d+)_(\d+)\.lotpack$"


def headers(files_: DataFrame) -> DataFrame:
    """Cell headers of files (path, name, content), one row each."""
    return _decoded(coordinates(files_, HEADER_NAME), HEADER, lambda f: [header(f.content) | {"cx": f.cx, "cy": f.cy}])


def read_headers(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """All cell headers below a folder, or any one of them."""
    found = files(spark, path, HEADER_NAME, "*.lotheader")
    return headers(found.limit(1) if first_only else found)


def layers(files_: DataFrame) -> DataFrame:
    """cx, cy, version, minlayer and maxlayer of header files, which are read no further (S3)."""

    def rows(f):
        c = Cursor(f.content)
        yield {"cx": f.cx, "cy": f.cy} | start(c)

    return _decoded(coordinates(files_, HEADER_NAME), "cx int, cy int, version int, minlayer int, maxlayer int, error string", rows)


def squares(bodies: DataFrame, heads: DataFrame) -> DataFrame:
    """Tile codes of all squares of cells, in world coordinates, in draw order `pos`; files (path, name, content) of bodies and headers.

    Headers are reduced to what decoding needs before they meet the bodies; cells decode in one task each, into columns. A
    body or header that can't be decoded gives one row with its error; a body without header drops out.
    """
    names = ["cx", "cy", "sx", "sy", "layer", "room", "pos", "code", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                try:
                    if f.error is not None:
                        raise ValueError(f"header: {f.error}")
                    found = body(f.content, f.version, f.minlayer, f.maxlayer)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    yield pd.DataFrame([[f.cx, f.cy, *[None] * 6, f"{type(e).__name__}: {e}"]], columns=names, dtype=object)
                    continue
                cell = BLOCK_SIZE[FORMATS[f.version]] * CELL_BLOCKS[FORMATS[f.version]]
                found |= {"cx": f.cx, "cy": f.cy, "sx": found["sx"] + f.cx * cell, "sy": found["sy"] + f.cy * cell, "error": None}
                yield pd.DataFrame(found)[names]

    joined = coordinates(bodies, BODY_NAME).select("cx", "cy", "content").join(layers(heads), ["cx", "cy"])
    return joined.mapInPandas(run, SQUARES)


def read_squares(spark: SparkSession, path: str) -> DataFrame:
    """Tile codes of all cells below a folder."""
    return squares(files(spark, path, BODY_NAME, "world_*.lotpack"), files(spark, path, HEADER_NAME, "*.lotheader"))


def named(squares: DataFrame, headers: DataFrame) -> DataFrame:
    """Squares with the names of their tiles, by each cell's own dictionary, an entry a row; codes beyond it have none."""
    entries = headers.filter("error is null").select("cx", "cy", F.posexplode("tiles").alias("code", "tile"))
    return squares.filter("error is null").drop("error").join(entries, ["cx", "cy", "code"], "left")


def population(headers: DataFrame) -> DataFrame:
    """Population of each block that has any: (cx, cy, bx, by, z)."""
    rows = headers.filter("error is null").select("cx", "cy", F.posexplode("zpop").alias("bx", "column")).select("cx", "cy", "bx", F.posexplode("column").alias("by", "z"))
    return rows.filter("z > 0")


def prefabs(files_: DataFrame) -> DataFrame:
    """Attributes and tiles of prefab files (path, content), a row each."""
    names = [f.name for f in _fields(files_.sparkSession, PREFAB)][:-1]
    return _decoded(files_, PREFAB, lambda f: (dict(zip(names, (f.path, *r), strict=True)) for r in prefab(f.content)))


def read_prefabs(spark: SparkSession, path: str) -> DataFrame:
    return prefabs(files(spark, path, r"\.pzby$", "*.pzby"))


def packs(files_: DataFrame) -> DataFrame:
    """Textures of pack files (path, content), a row each."""
    names = [f.name for f in _fields(files_.sparkSession, PACK)][:-1]
    return _decoded(files_, PACK, lambda f: (dict(zip(names, (f.path, *r), strict=True)) for r in pack(f.content)))


def pages(files_: DataFrame) -> DataFrame:
    """Pages of pack files (path, content), a row each: number in the pack, image, and where its textures are."""

    def rows(f):
        for k, (page, alpha, textures, png) in enumerate(pack_pages(f.content)):
            yield {"path": f.path, "page_no": k, "page": page, "has_alpha": alpha, "textures": textures, "png": png}

    return _decoded(files_, PAGE, rows)


def read_packs(spark: SparkSession, path: str, pattern: str = r"\.pack$", glob: str = "*.pack") -> DataFrame:
    """Textures of all packs below a folder; names can be chosen by pattern."""
    return packs(files(spark, path, pattern, glob))


def save_blocks(files_: DataFrame) -> DataFrame:
    """wx and wy of save chunks, whichever of three layouts their paths follow (S16); other files drop out.

    map/X/Y.bin, map/map_X_Y.bin and map_X_Y.bin.
    """
    nested, flat = r"/map/(\d+)/(\d+)\.bin$", r"/map_(\d+)_(\d+)\.bin$"
    part = lambda i: F.coalesce(*(F.nullif(F.regexp_extract("path", p, i), F.lit("")) for p in (nested, flat))).cast("int")
    return files_.withColumns({"wx": part(1), "wy": part(2)}).filter("wx is not null")


def save_version(content: str = "content"):
    """World version of a save chunk, its bytes 1 to 4 big-endian, and the format it belongs to: up to 195 the older."""
    number = F.conv(F.hex(F.substring(content, 2, 4)), 16, 10).cast("bigint")
    return F.struct(number.alias("version"), F.when(number <= 195, "B41").otherwise("B42").alias("format"))
