"""Images: textures, tiles composited, shrunk, cropped and written as PNG, and what lies beside them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coords import floor_div
from ..storage import reliable


def _filtered(image: np.ndarray, how: np.ndarray) -> np.ndarray:
    """Lines (h, w, channels) behind filters of these kinds: what each pixel differs from a guess by its neighbours."""
    data = image.astype(np.int16)
    left, up = np.zeros_like(data), np.zeros_like(data)
    left[:, 1:], up[1:] = data[:, :-1], data[:-1]
    corner = np.zeros_like(data)
    corner[1:, 1:] = data[:-1, :-1]
    away = np.stack([abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)])
    nearest = np.choose(away.argmin(axis=0), [left, up, corner])
    guess = np.choose(how[:, None, None], [np.zeros_like(data), left, up, (left + up) >> 1, nearest])
    return ((data - guess) & 255).astype(np.uint8)


def png(image: np.ndarray, filters: np.ndarray | None = None) -> bytes:
    """8-bit RGBA, RGB or grey image as PNG; filters has the kind (0 to 4) of each line's filter."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    kind = {1: 0, 3: 2, 4: 6}[channels]
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    how = np.zeros(h, np.uint8) if filters is None else np.asarray(filters, np.uint8)
    lines = np.hstack([how[:, None], _filtered(image.reshape(h, w, channels), how).reshape(h, -1) if how.any() else image.reshape(h, -1)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """One RGBA image over another."""
    a, b = above[..., 3:].astype(np.float64) / 255, below[..., 3:].astype(np.float64) / 255
    alpha = a + b * (1 - a)
    colour = (above[..., :3] * a + below[..., :3] * b * (1 - a)) / np.where(alpha == 0, 1, alpha)
    return np.concatenate([np.rint(colour), np.rint(alpha * 255)], axis=-1).astype(np.uint8)


def nearest_half(image: np.ndarray) -> np.ndarray:
    """Image at half size: of each two by two pixels the upper left one."""
    return np.ascontiguousarray(image[::2, ::2])


def box_half(image: np.ndarray) -> np.ndarray:
    """Image at half size: the mean of each two by two pixels, on premultiplied colours, rounded to the nearest."""
    data = image.astype(np.int64)
    alpha = data[..., 3:]
    four = lambda a: a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]
    weight = four(alpha)
    colour = (2 * four(data[..., :3] * alpha) + weight) // np.maximum(2 * weight, 1)
    return np.concatenate([np.where(weight > 0, colour, 0), (weight + 2) // 4], axis=-1).astype(np.uint8)


def lanczos_half(image: np.ndarray) -> np.ndarray:
    """Image at half size by a separable Lanczos filter of three lobes, on premultiplied colours."""
    x = np.arange(-5.5, 6) / 2
    weight = np.sinc(x) * np.sinc(x / 3)
    weight /= weight.sum()
    data = image.astype(np.float64)
    if image.shape[-1] == 4:
        data[..., :3] *= data[..., 3:] / 255
    for axis in (0, 1):
        n = data.shape[axis]
        at = np.clip(np.arange(0, n, 2)[:, None] + np.arange(-5, 7), 0, n - 1)
        data = np.moveaxis(np.tensordot(np.moveaxis(data, axis, 0)[at], weight, ([1], [0])), 0, axis) if data.ndim == 2 else np.moveaxis(np.einsum("ok...,k->o...", np.moveaxis(data, axis, 0)[at], weight), 0, axis)
    if image.shape[-1] == 4:
        data[..., :3] *= 255 / np.maximum(data[..., 3:], 1e-9)
    return np.clip(np.rint(data), 0, 255).astype(np.uint8)


TILES = "layer bigint, level int, tx bigint, ty bigint, size int, rgba binary"


def paint(squares: DataFrame, tile: int) -> DataFrame:
    """Tiles of level 0 from coloured squares (layer, x, y, ord, r, g, b, a); later `ord` lie over earlier ones.

    A square is a pixel. Each tile's squares meet in one task, at most `tile` squared places; tiles without squares
    don't exist.
    """
    rows = squares.withColumns({"tx": floor_div("x", tile), "ty": floor_div("y", tile)})

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        layer, tx, ty = key
        image = np.zeros((tile, tile, 4), np.uint8)
        part = part.sort_values("ord", kind="stable")
        at = (part.y - ty * tile).to_numpy(), (part.x - tx * tile).to_numpy()
        colour = part[["r", "g", "b", "a"]].to_numpy(np.uint8)
        depth = part.groupby(["x", "y"]).cumcount().to_numpy()
        for k in range(int(depth.max()) + 1):  # one pass for each place in the stack
            own = depth == k
            place = at[0][own], at[1][own]
            image[place] = over(image[place], colour[own])
        return pd.DataFrame([[layer, 0, tx, ty, tile, image.tobytes()]], columns=["layer", "level", "tx", "ty", "size", "rgba"])

    return rows.groupBy("layer", "tx", "ty").applyInPandas(draw, TILES)


TEXTURES = "name string, ox int, oy int, w int, h int, rgba binary"


def shapes(colours: DataFrame, w: int, h: int, diamond: bool = True) -> DataFrame:
    """A texture for each colour (name, r, g, b, a): a diamond or a rectangle of w by h pixels about the square's middle.

    A pixel is in the diamond if its middle is.
    """
    x, y = np.abs(2 * np.arange(w) + 1 - w) / w, np.abs(2 * np.arange(h) + 1 - h) / h
    inside = (x[None, :] + y[:, None] <= 1) | (not diamond)

    def draw(parts):
        for part in parts:
            rgba = [(inside[..., None] * np.array(c, np.uint8)).astype(np.uint8).tobytes() for c in zip(part.r, part.g, part.b, part.a, strict=True)]
            yield pd.DataFrame({"name": part["name"], "ox": -(w // 2), "oy": -(h // 2), "w": w, "h": h, "rgba": rgba})

    return colours.select("name", "r", "g", "b", "a").mapInPandas(draw, TEXTURES)


def trimmed(textures: DataFrame) -> DataFrame:
    """Textures without their transparent margins, offsets moved along; a wholly transparent one has no size."""

    def trim(parts):
        for part in parts:
            out = []
            for name, ox, oy, w, h, rgba in part[["name", "ox", "oy", "w", "h", "rgba"]].itertuples(index=False):
                image = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)
                ys, xs = np.nonzero(image[..., 3])
                if not len(xs):
                    out.append([name, 0, 0, 0, 0, b""])
                    continue
                x, y = xs.min(), ys.min()
                image = image[y : ys.max() + 1, x : xs.max() + 1]
                out.append([name, ox + x, oy + y, image.shape[1], image.shape[0], image.tobytes()])
            yield pd.DataFrame(out, columns=["name", "ox", "oy", "w", "h", "rgba"])

    return textures.mapInPandas(trim, TEXTURES)


def write_textures(textures: DataFrame, path: str) -> None:
    """Trimmed textures as PNG with offsets and a digest of each, by which unchanged ones are known."""
    image = F.pandas_udf(lambda w, h, rgba: pd.Series([png(np.frombuffer(d, np.uint8).reshape(b, a, 4)) if d else None for a, b, d in zip(w, h, rgba, strict=True)], dtype=object), T.BinaryType())
    trimmed(textures).select("name", "ox", "oy", "w", "h", image("w", "h", "rgba").alias("png"), F.sha2("rgba", 256).alias("digest")).write.mode("overwrite").parquet(path)


def compose(draws: DataFrame, textures: DataFrame, tile: int, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Tiles of level 0 from textures drawn at pixels; those later in `order` lie over earlier ones.

    A draw (layer, px, py, name and the order's columns) puts its texture's corner at (px + ox, py + oy) and goes to each
    tile that the texture touches; draws without a texture drop out. A task holds one tile's draws, and each of its
    textures once, so that images don't travel with every draw. Tiles without draws don't exist.
    """
    sizes = textures.select("name", "ox", "oy", "w", "h").filter("w > 0 and h > 0")
    placed = draws.join(sizes, "name").select("layer", "name", *order, (F.col("px") + F.col("ox")).alias("x"), (F.col("py") + F.col("oy")).alias("y"), "w", "h")
    span = lambda at, n: F.explode(F.sequence(floor_div(at, tile), floor_div(F.col(at) + F.col(n) - 1, tile)))
    key = ["layer", "tx", "ty"]
    dealt = placed.withColumn("tx", span("x", "w")).withColumn("ty", span("y", "h"))
    needed = dealt.select(*key, "name").distinct().join(textures.select("name", "w", "h", "rgba"), "name").select(*(F.col(c).alias(f"of_{c}") for c in (*key, "name", "w", "h", "rgba")))  # names of its own, for the grouping

    def draw(at: tuple, rows: pd.DataFrame, images: pd.DataFrame) -> pd.DataFrame:
        layer, tx, ty = at
        known = {n: np.frombuffer(d, np.uint8).reshape(h, w, 4) for n, w, h, d in images[["of_name", "of_w", "of_h", "of_rgba"]].itertuples(index=False)}
        out = np.zeros((tile, tile, 4), np.uint8)
        rows = rows.sort_values(list(order), kind="stable")
        for name, x, y in zip(rows["name"], rows.x - tx * tile, rows.y - ty * tile, strict=True):
            image = known[name]
            part = image[max(0, -y) : tile - y, max(0, -x) : tile - x]
            x, y = max(0, x), max(0, y)
            place = out[y : y + part.shape[0], x : x + part.shape[1]]
            place[:] = over(place, part)
        return pd.DataFrame([[layer, 0, tx, ty, tile, out.tobytes()]], columns=["layer", "level", "tx", "ty", "size", "rgba"])

    return dealt.groupBy(*key).cogroup(needed.groupBy(*(f"of_{c}" for c in key))).applyInPandas(draw, TILES)


def pixels(tiles: DataFrame) -> DataFrame:
    """The pixels of tiles that aren't wholly transparent: (layer, level, x, y, colour), the colour as eight hexadecimal digits."""
    byte = lambda at, n: F.substring("rgba", at, n)
    seen = F.filter(F.sequence(F.lit(0), F.col("size") * F.col("size") - 1), lambda i: byte(i * 4 + 4, F.lit(1)) != F.lit(b"\0"))
    own = F.transform(seen, lambda i: F.struct(i.alias("i"), F.lower(F.hex(byte(i * 4 + 1, F.lit(4)))).alias("colour")))
    rows = tiles.select("layer", "level", "tx", "ty", "size", F.explode(own).alias("p"))
    x, y = F.col("tx") * F.col("size") + F.col("p.i") % F.col("size"), F.col("ty") * F.col("size") + floor_div("p.i", "size")
    return rows.select("layer", "level", x.alias("x"), y.alias("y"), "p.colour")


def cropped(tiles: DataFrame, w: int, h: int, opaque_layers: tuple[int, ...] = ()) -> DataFrame:
    """PNG of tiles cut to an image of w by h pixels at level 0, without alpha in some layers (K1, K2).

    (layer, level, tx, ty, w, h, state, png): a tile that is transparent where the image is has the state `empty` and no
    PNG, others are `saved`. An image's size is halved from level to level, rounded up.
    """
    inner = lambda n, at: F.greatest(F.lit(0), F.least(F.col("size").cast("bigint"), F.call_function("shiftright", F.lit(n - 1).cast("bigint"), F.col("level")) + 1 - F.col(at) * F.col("size"))).cast("int")
    rows = tiles.select("layer", "level", "tx", "ty", inner(w, "tx").alias("w"), inner(h, "ty").alias("h"), "size", "rgba", F.col("layer").isin(*opaque_layers).alias("opaque") if opaque_layers else F.lit(False).alias("opaque"))

    @F.pandas_udf(T.BinaryType())
    def encode(size: pd.Series, rgba: pd.Series, w: pd.Series, h: pd.Series, opaque: pd.Series) -> pd.Series:
        out = []
        for n, data, a, b, plain in zip(size, rgba, w, h, opaque, strict=True):
            image = np.frombuffer(data, np.uint8).reshape(n, n, 4)[:b, :a]
            out.append(png(image[..., :3] if plain else image) if image[..., 3].any() else None)
        return pd.Series(out, dtype=object)

    made = rows.withColumn("png", encode("size", "rgba", "w", "h", "opaque"))
    return made.select("layer", "level", "tx", "ty", "w", "h", F.when(F.col("png").isNull(), "empty").otherwise("saved").alias("state"), "png")


def without_tiles(tiles: DataFrame, gone: DataFrame, all_layers: bool = True) -> DataFrame:
    """Tiles that aren't listed as gone, by (level, tx, ty), in all layers or in the listed one (K4)."""
    key = ["level", "tx", "ty"] + ([] if all_layers else ["layer"])
    return tiles.join(gone.select(*key).distinct(), key, "left_anti")


def without_children(tiles: DataFrame, saved: DataFrame, skip: int) -> DataFrame:
    """Tiles but for those below the `skip` most detailed levels' parents that were saved again (K4)."""
    child = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
    parents = saved.filter((F.col("level") >= 1) & (F.col("level") <= skip)).select("layer", (F.col("level") - 1).alias("level"), "tx", "ty")
    return without_tiles(tiles, parents.select("layer", "level", child("tx"), "ty").select("layer", "level", "tx", child("ty")), all_layers=False)


def skeleton(layers: DataFrame, w: int, h: int, tile: int, form: str = "png", ground: str = "png", skip: int = 0) -> DataFrame:
    """(layer, path, content) of the image description of each layer of a pyramid (K5).

    The size is that of the most detailed level that is kept; the ground layer may have a format of its own.
    """
    size = [((n - 1) >> skip) + 1 for n in (w, h)]
    # fixed value: the image description in XML
    xml = '<?xml version="1.0" encoding="UTF-8"?><Image xmlns="http://schemas.microsoft.com/deepzoom/2008" TileSize="%d" Overlap="0" Format="%s"><Size Width="%d" Height="%d"/></Image>'
    text = F.format_string(xml, F.lit(tile), F.when(F.col("layer") == 0, ground).otherwise(form), F.lit(size[0]), F.lit(size[1]))
    return layers.select("layer").distinct().select("layer", F.format_string("layer%d.dzi", "layer").alias("path"), text.alias("content"))


def write_skeleton(rows: DataFrame, path: str) -> None:
    """Image descriptions as text, a folder for each (K5)."""
    rows.select("content", F.col("path").alias("file")).write.partitionBy("file").mode("overwrite").text(path)


def shrink(tiles: DataFrame, levels: int = 3, half: Callable = lanczos_half) -> DataFrame:
    """The next `levels` levels above tiles of one level, in one shuffle: a task builds the part of the pyramid above its 2^levels by 2^levels tiles.

    `half` makes an image of half the size. Many levels are made by `image_pyramid`, in steps.
    """
    top = 1 << levels
    rows = tiles.withColumns({"px": floor_div("tx", top), "py": floor_div("ty", top)})

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        layer, px, py = key
        level, size = int(part.level.iloc[0]), int(part["size"].iloc[0])
        now = {(r.tx, r.ty): np.frombuffer(r.rgba, np.uint8).reshape(size, size, 4) for r in part.itertuples()}
        out = []
        for step in range(1, levels + 1):
            above = {}
            for tx, ty in {(x // 2, y // 2) for x, y in now}:
                whole = np.zeros((2 * size, 2 * size, 4), np.uint8)
                for dx in (0, 1):
                    for dy in (0, 1):
                        child = now.get((2 * tx + dx, 2 * ty + dy))
                        if child is not None:
                            whole[dy * size : (dy + 1) * size, dx * size : (dx + 1) * size] = child
                above[tx, ty] = half(whole)
            now = above
            out += [[layer, level + step, tx, ty, size, image.tobytes()] for (tx, ty), image in now.items()]
        return pd.DataFrame(out, columns=["layer", "level", "tx", "ty", "size", "rgba"])

    return rows.groupBy("layer", "px", "py").applyInPandas(build, TILES)


def image_pyramid(tiles: DataFrame, levels: int | None = None, half: Callable = lanczos_half, step: int = 3) -> DataFrame:
    """Tiles of level 0 and all levels above them, up to one tile for each quadrant, or as many as are asked for.

    Each step makes `step` levels in one shuffle, at most 4^step tiles in a task, and writes them to the shared folder; the
    next step reads its tops alone, 1/4^step of what the last one read.
    """
    tiles = reliable(tiles)
    if levels is None:
        ends = tiles.agg(*(f(c) for c in ("tx", "ty") for f in (F.min, F.max))).first()
        levels = max([0, *((-1 - v if v < 0 else v).bit_length() for v in ends if v is not None)])
    out, tops, done = tiles, tiles, 0
    while done < levels:
        n = min(step, levels - done)
        made = reliable(shrink(tops, n, half))
        done += n
        out, tops = out.union(made), made.filter(F.col("level") == done)
    return out


@F.pandas_udf(T.BinaryType())
def to_png(size: pd.Series, rgba: pd.Series) -> pd.Series:
    """PNG of a tile; null for a wholly transparent one (K1, K2)."""

    def one(n: int, data: bytes) -> bytes | None:
        image = np.frombuffer(data, np.uint8).reshape(n, n, 4)
        return png(image) if image[..., 3].any() else None

    return pd.Series([one(n, d) for n, d in zip(size, rgba, strict=True)], dtype=object)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """PNG tiles as a table partitioned by layer and level; the committer leaves no half-written tile behind (K1-K3)."""
    tiles.select("layer", "level", "tx", "ty", to_png("size", "rgba").alias("png")).filter("png is not null").write.partitionBy("layer", "level").mode("overwrite").parquet(path)


def map_info(tiles: DataFrame, **fixed) -> DataFrame:
    """One JSON row on a pyramid: extent, layers, levels and fixed entries (K6)."""
    facts = tiles.agg(F.min("layer").alias("minlayer"), (F.max("layer") + 1).alias("maxlayer"), F.max("level").alias("levels"), F.count("*").alias("tiles"))
    return facts.select(F.to_json(F.struct("*", *(F.lit(v).alias(k) for k, v in fixed.items()))).alias("json"))


def write_marks(marks: DataFrame, path: str) -> None:
    """Marks as JSON, one object on a line (K7)."""
    marks.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def mark_array(marks: DataFrame, by: list[str], id_: str = "id") -> DataFrame:
    """(by, json): the marks of each unit, such as a cell, as one JSON array with an object on each line, in order of id (K7).

    The units bound the arrays; nothing is gathered over them.
    """
    one = F.to_json(F.struct(*(c for c in marks.columns if c not in by)))
    lines = marks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(id_).alias("k"), one.alias("j")))).alias("l"))
    return lines.select(*by, F.concat(F.lit("[\n"), F.array_join(F.transform("l", lambda e: e["j"]), ",\n"), F.lit("\n]")).alias("json"))
