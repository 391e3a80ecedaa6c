"""Textures cut from the pages of packs, a library of them with overrides, and their colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.png import decode
from .raster import TEXTURES

# fixed values: the packs of an installation in the order in which they are read; later ones override
PACKS = ("Erosion.pack", "ApCom.pack", "RadioIcons.pack", "ApComUI.pack", "JumboTrees2x.pack", "Tiles2x.floor.pack", "Tiles2x.pack")
CUT = f"path string, page_no int, ord int, {TEXTURES}, error string"


def pack_rank(path: Column, packs: tuple[str, ...] = PACKS) -> Column:
    """Place of a pack in the order of reading, by its file's name; null for others, which aren't read."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(*(F.when(name == p, F.lit(k)) for k, p in enumerate(packs)))


def cut(pages: DataFrame) -> DataFrame:
    """Textures of pages (path, page_no, textures, png): trimmed images, offsets from the middle of a square's lower edge.

    A task decodes one page at a time and cuts all of its textures, so that an image is neither decoded twice nor shuffled.
    Parts of a rectangle beyond the page are transparent; a texture with nothing to see has no size. A page that can't be
    read gives one row with its error.
    """

    def textures(row) -> Iterator[tuple]:
        image = decode(bytes(row.png))
        for k, t in enumerate(row.textures):
            x, y, w, h = (t[n] for n in "xywh")
            own = np.zeros((h, w, 4), np.uint8)
            part = image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
            top, left = max(0, -y), max(0, -x)
            own[top : top + part.shape[0], left : left + part.shape[1]] = part
            ys, xs = np.nonzero(own[..., 3])
            if not len(xs):
                yield row.path, row.page_no, k, t["name"], 0, 0, 0, 0, b"", None
                continue
            top, left = int(ys.min()), int(xs.min())
            own = own[top : ys.max() + 1, left : xs.max() + 1]
            yield row.path, row.page_no, k, t["name"], t["ox"] - (t["ow"] >> 1) + left, t["oy"] - t["oh"] + top, own.shape[1], own.shape[0], own.tobytes(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_no", "ord", "name", "ox", "oy", "w", "h", "rgba", "error"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    out = list(textures(row))
                except Exception as e:  # whatever is wrong with a page, the others are read
                    out = [(row.path, row.page_no, *[None] * 7, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=names, dtype=object)

    return pages.filter("png is not null").select("path", "page_no", "textures", "png").mapInPandas(run, CUT)


def library(cut_textures: DataFrame, rank: Column) -> DataFrame:
    """One texture of each name: that of the last pack by rank, in it of the last page, on it the last; packs without rank drop out.

    Pages are cut once. The last of each name is found in each task before the shuffle, so that overridden images don't travel.
    """
    ranked = cut_textures.filter("error is null").withColumn("rank", rank).filter("rank is not null")
    place, texture = F.struct("rank", "path", "page_no", "ord"), F.struct("ox", "oy", "w", "h", "rgba")
    return ranked.groupBy("name").agg(F.max_by(texture, place).alias("last")).select("name", "last.*")


def atlas(pages: DataFrame, rank: Column) -> DataFrame:
    """(name, page_id, x, y, w, h, ox, oy): where each texture is on the pages, numbered over all packs in order.

    Pages are counted by pack first; the running count goes over packs alone.
    """
    ranked = pages.filter("error is null").withColumn("rank", rank).filter("rank is not null")
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each pack of a fixed list
    first = ranked.groupBy("rank", "path").agg(F.count("*").alias("n")).select("rank", "path", before.alias("first"))
    rows = ranked.join(first, ["rank", "path"]).select("rank", "path", "page_no", (F.col("first") + F.col("page_no")).cast("bigint").alias("page_id"), F.posexplode("textures").alias("ord", "t"))
    place = F.struct("rank", "path", "page_no", "ord")
    t = rows.groupBy("t.name").agg(F.max_by(F.struct("page_id", "t"), place).alias("e"))
    at = lambda n: F.col(f"e.t.{n}")
    return t.select("name", "e.page_id", *(at(n).alias(n) for n in "xywh"), (at("ox") - F.call_function("shiftright", at("ow"), F.lit(1))).alias("ox"), (at("oy") - at("oh")).alias("oy"))


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("sum_r", "sum_g", "sum_b", "n")]))
def pixel_sums(rgba: pd.Series) -> pd.DataFrame:
    """Colour sums and the number of opaque pixels of each image; without any, black once (A1)."""
    out = []
    for data in rgba:
        pixels = np.frombuffer(data, np.uint8).reshape(-1, 4)
        opaque = pixels[pixels[:, 3] == 255, :3].astype(np.int64)
        out.append((*opaque.sum(axis=0).tolist(), max(1, len(opaque))))
    return pd.DataFrame(out, columns=["sum_r", "sum_g", "sum_b", "n"])


def colour_sums(textures: DataFrame) -> DataFrame:
    """(name, sum_r, sum_g, sum_b, n) of the opaque pixels of each texture; without any, black once (A1)."""
    return textures.select("name", pixel_sums("rgba").alias("s")).select("name", "s.*")
