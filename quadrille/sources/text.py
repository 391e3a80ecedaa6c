"""Structured texts as DataFrames: table literals, streets, rasters, key=value files, pages."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import png

TOKEN = re.compile(r"""\s+|--\[\[.*?\]\]|--[^\n]*|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>-?(?:0x[0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?))|(?P<name>[A-Za-z_]\w*)|(?P<mark>[{}\[\]=,;().:])""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def tokens(source: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise ValueError(f"can't read {source[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[0]


class _Literals:
    """A recursive reader of table literals; it evaluates nothing else."""

    def __init__(self, source: str):
        self.all, self.at = [*tokens(source), ("end", "")], 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.all[min(self.at + k, len(self.all) - 1)]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.all[self.at - 1]

    def value(self):
        kind, text = self.next()
        if kind == "text":
            return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
        if kind == "number":
            return int(text, 16) if "x" in text.lower() else int(text) if re.fullmatch(r"-?\d+", text) else float(text)
        if kind == "name" and text in ("true", "false", "nil"):
            return {"true": True, "false": False, "nil": None}[text]
        if (kind, text) == ("mark", "{"):
            return self.table()
        raise ValueError(f"only literals are read, not {text!r}")

    def table(self):
        """A list if the keys are exactly 1 to n, else a dictionary."""
        out, n = {}, 1
        while self.peek()[1] != "}":
            if self.peek()[1] == "[":
                self.next()
                key = self.value()
                self.next(), self.next()
            elif self.peek()[0] == "name" and self.peek(1)[1] == "=":
                key = self.next()[1]
                self.next()
            else:
                key, n = n, n + 1
            found = self.value()
            if found is not None:
                out[key] = found
            if self.peek()[1] in (",", ";"):
                self.next()
        self.next()
        return [out[i] for i in range(1, len(out) + 1)] if out and set(out) == set(range(1, len(out) + 1)) else {str(k): v for k, v in out.items()}


def literal(source: str, name: str):
    """Value of the last assignment `name = <literal>` in a source text; code is never run."""
    at = [m.end() for m in re.finditer(rf"(?:^|[\s;]){re.escape(name)}\s*=(?!=)", source)]
    if not at:
        raise ValueError(f"{name} isn't assigned")
    rest = _Literals.__new__(_Literals)
    rest.all, rest.at, depth = [], 0, 0
    for kind, text in tokens(source[at[-1] :]):
        rest.all.append((kind, text))
        depth += (text == "{" and kind == "mark") - (text == "}" and kind == "mark")
        if depth == 0:
            break
    rest.all.append(("end", ""))
    return rest.value()


ZONE = "type string, name string, x bigint, y bigint, z bigint, width bigint, height bigint, geometry string, points array<double>, lineWidth bigint, properties map<string,string>"


def zones(files_: DataFrame, name: str = "objects") -> DataFrame:
    """Zone objects of table-literal files (path, content), with path and ordinal `ord` in the file.

    A file that can't be read gives one row with its error and no zone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                try:
                    rows += [(f.path, i, json.dumps(o), None) for i, o in enumerate(literal(bytes(f.content).decode("utf-8", "replace"), name))]
                except (ValueError, IndexError, KeyError, TypeError) as e:
                    rows.append((f.path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ord", "json", "error"], dtype=object)

    read = files_.select("path", "content").mapInPandas(run, "path string, ord bigint, json string, error string")
    return read.select("path", "ord", F.from_json("json", ZONE).alias("z"), "error").select("path", "ord", "z.*", "error")


def read_zones(spark: SparkSession, path: str, name: str = "objects") -> DataFrame:
    """Zone objects of all table-literal files below a folder."""
    return zones(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.lua").load(path), name)


def pixel_zones(entries: DataFrame) -> DataFrame:
    """Pixel value to zone of a biome configuration (pixel, zone): 0 to 255, the last entry of a pixel wins."""
    return entries.filter(F.col("pixel").between(0, 255)).groupBy("pixel").agg(F.max_by("zone", "ord").alias("zone"))


STREET = "_name string, _width int, points struct<point: array<struct<_x: double, _y: double>>>"


def read_streets(spark: SparkSession, path: str) -> DataFrame:
    """name, width and points of streets in XML (S13); the schema is given, as inference mixes number types."""
    df = spark.read.format("xml").option("rowTag", "street").schema(STREET).load(path)
    points = F.transform("points.point", lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y")))
    return df.select(F.col("_name").alias("name"), F.col("_width").alias("width"), points.alias("points"))


def grey_pixels(image: bytes) -> tuple[int, int, bytes]:
    """Width, height and row-major grey values of a PNG; colours by their luma."""
    rgba = png.decode(image).astype(np.int64)
    grey = (299 * rgba[..., 0] + 587 * rgba[..., 1] + 114 * rgba[..., 2]) // 1000
    return grey.shape[1], grey.shape[0], grey.astype(np.uint8).tobytes()


RASTER = r"biomemap_(\d+)_(\d+)\.png$"


def rasters(files_: DataFrame, pattern: str = RASTER) -> DataFrame:
    """(cx, cy, x, y, pixel, error) of raster images (path, content) with two numbers in their names.

    An image that can't be read gives one row with its error and no pixel.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                try:
                    w, h, flat = grey_pixels(bytes(f.content))
                except (ValueError, IndexError, struct.error, zlib.error) as e:
                    yield pd.DataFrame([[f.cx, f.cy, None, None, None, f"{type(e).__name__}: {e}"]], columns=["cx", "cy", "x", "y", "pixel", "error"], dtype=object)
                    continue
                at = np.arange(w * h)
                yield pd.DataFrame({"cx": f.cx, "cy": f.cy, "x": at % w, "y": at // w, "pixel": np.frombuffer(flat, np.uint8), "error": None})

    part = lambda i: F.regexp_extract("path", pattern, i).cast("int")
    named = files_.filter(F.col("path").rlike(pattern)).select("content", part(1).alias("cx"), part(2).alias("cy"))
    return named.mapInPandas(run, "cx int, cy int, x int, y int, pixel int, error string")


def read_rasters(spark: SparkSession, path: str, pattern: str = RASTER, glob: str = "*.png") -> DataFrame:
    """Pixels of the raster images below a folder."""
    return rasters(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path), pattern)


def key_values(lines: DataFrame, by: list[str]) -> DataFrame:
    """Map of the `key=value` lines of each unit; a value may hold further equals signs, the last of a key wins."""
    pairs = lines.withColumn("kv", F.split("value", "=", 2)).filter(F.size("kv") == 2).select(*by, "ord", F.trim(F.col("kv")[0]).alias("k"), F.trim(F.col("kv")[1]).alias("v"))
    last = pairs.groupBy(*by, "k").agg(F.max_by("v", "ord").alias("v"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("info"))


def page_title(html) -> Column:
    return F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)


def page_links(html) -> Column:
    """Targets of all links in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def classified(listing: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Files of a listing (path) by the first pattern that they match, and the two numbers in it if it has groups."""
    kind = F.coalesce(*(F.when(F.col("path").rlike(p), k) for k, p in patterns.items()))
    part = lambda i: F.coalesce(*(F.when(F.col("path").rlike(p), F.nullif(F.regexp_extract("path", p, i), F.lit(""))) for p in patterns.values() if re.compile(p).groups >= i)).cast("bigint")
    return listing.withColumns({"kind": kind, "ux": part(1), "uy": part(2)}).filter("kind is not null")
