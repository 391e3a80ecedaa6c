"""Catalogue, dictionary and option queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_usage(used: DataFrame, packs: DataFrame) -> DataFrame:
    """For each used tile, in how many packs it is, which has it first, and whether it is missing or in several."""
    hits = packs.groupBy("tile").agg(F.count_distinct("pack").alias("packs"), F.min("pack").alias("first_pack"))
    state = F.when(F.col("packs").isNull(), "missing").when(F.col("packs") > 1, "several").otherwise("one")
    return used.select("tile").distinct().join(hits, "tile", "left").select("tile", F.coalesce("packs", F.lit(0)).alias("packs"), "first_pack", state.alias("state"))


def located(dictionary: DataFrame, body: DataFrame, wanted: list[str], key: list[str]) -> DataFrame:
    """Rows of body with wanted tiles; only units whose dictionary has one are scanned."""
    units = dictionary.filter(F.col("tile").isin(*wanted)).select(*key).distinct()
    return body.filter(F.col("tile").isin(*wanted)).join(units, key, "left_semi")


def long_options(wide: DataFrame, key: list[str], prefix: str) -> DataFrame:
    """Columns prefix_<lang> as rows (key, lang, text), unset ones left out."""
    columns = [c for c in wide.columns if c.startswith(f"{prefix}_")]
    long = wide.unpivot(key, columns, "lang", "text").filter("text is not null")
    return long.withColumn("lang", F.substring("lang", len(prefix) + 2, 1000))


def wide_options(long: DataFrame, key: list[str], langs: list[str]) -> DataFrame:
    """Rows (key, lang, text) as one column for each language."""
    return long.groupBy(*key).pivot("lang", langs).agg(F.first("text"))


def localised(keys: DataFrame, texts: DataFrame, lang: str, fallback: str) -> DataFrame:
    """Text of each key in a language, else in the fallback, else the key."""
    one = lambda code, name: texts.filter(F.col("lang") == code).groupBy("key").agg(F.min("text").alias(name))
    return keys.join(one(lang, "_a"), "key", "left").join(one(fallback, "_b"), "key", "left").withColumn("text", F.coalesce("_a", "_b", F.col("key").cast("string"))).drop("_a", "_b")


def toggled(selected: DataFrame, flips: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Selection after each flip of an existing unit turned it over (U4)."""
    both = selected.select(*key).distinct().union(flips.select(*key)).groupBy(*key).agg(F.count("*").alias("n"))
    return both.filter("n % 2 = 1").select(*key).join(existing, key, "left_semi")


def first_copies(rows: DataFrame, content: str, id_: str) -> DataFrame:
    """For each row the least id with the same content (D10): a join with the combined copies, whose hot digests can be split."""
    return rows.select(id_, F.sha2(F.col(content), 256).alias("digest")).join(copies(rows, content, id_).drop("n"), "digest").select(id_, "keeper")


def copies(rows: DataFrame, content: str, id_: str) -> DataFrame:
    """Digest, least id and number of rows of each distinct content; combines before the shuffle."""
    return rows.groupBy(F.sha2(F.col(content), 256).alias("digest")).agg(F.min(id_).alias("keeper"), F.count("*").alias("n"))


def retained(blocks: DataFrame, drop_blocks: DataFrame, drop_cells: DataFrame, per_cell: int) -> DataFrame:
    """Blocks that are neither listed nor in a listed cell."""
    from ..functions.coords import floor_div

    rest = blocks.join(drop_blocks, ["bx", "by"], "left_anti")
    return rest.withColumn("cx", floor_div("bx", per_cell)).withColumn("cy", floor_div("by", per_cell)).join(drop_cells, ["cx", "cy"], "left_anti").select("bx", "by")


def selection_state(blocks: DataFrame, per_cell: int) -> DataFrame:
    """For each cell of blocks (bx, by, saved, selected) how far it is selected and saved."""
    from ..functions.coords import floor_div

    full = per_cell * per_cell
    counts = blocks.groupBy(floor_div("bx", per_cell).alias("cx"), floor_div("by", per_cell).alias("cy")).agg(F.count_if("saved").alias("saved"), F.count_if(F.col("selected") & F.col("saved")).alias("selected"))
    state = F.when((F.col("selected") > 0) & (F.col("selected") == F.col("saved")), "all selected").when(F.col("selected") > 0, "some selected").when(F.col("saved") == full, "all saved").otherwise("some saved")
    return counts.withColumn("state", state)


def with_defaults(entries: DataFrame, defaults: dict[str, str], paths: tuple[str, ...] = ()) -> DataFrame:
    """Catalogue entries with defaults for unset values, and {name} marks in path columns filled in from the entry."""
    from ..functions.values import filled

    full = entries.withColumns({c: F.coalesce(c, F.lit(v)) if c in entries.columns else F.lit(v) for c, v in defaults.items()})
    others = [c for c in full.columns if c not in paths]
    return full.withColumns({p: filled(p, {c: F.col(c) for c in others}) for p in paths})


def listing(maps: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON array of all maps in order (K14); a catalogue, not data, so that one row holds it."""
    return maps.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("json"))


def write_languages(long: DataFrame, path: str) -> None:
    """Texts (key, lang, text) as JSON, a folder for each language."""
    long.write.partitionBy("lang").mode("overwrite").json(path)


def quarantined(decoded: DataFrame, key: list[str]) -> DataFrame:
    """One row with its error for each unit that could not be decoded."""
    return decoded.filter("error is not null").dropDuplicates(key).select(*key, "error")


def matching_saves(chunks: DataFrame, form: str) -> DataFrame:
    """Saves (mode, save) of a format, by the versions of their chunks (X20): a save counts by its newest chunk."""
    newest = chunks.groupBy("mode", "save").agg(F.max("version").alias("version"))
    return newest.filter(F.when(F.col("version") <= 195, "B41").otherwise("B42") == form)


def boxed_blocks(blocks: DataFrame, x1: int, y1: int, x2: int, y2: int, block: int = 8, per_cell: int = 32) -> DataFrame:
    """Blocks (bx, by) that a box of squares touches, ends included and in either order, with their cells."""
    from ..functions.coords import floor_div

    low, high = (min(x1, x2), min(y1, y2)), (max(x1, x2), max(y1, y2))
    inside = [F.col(c).between(a // block, b // block) for c, a, b in zip(("bx", "by"), low, high, strict=True)]
    return blocks.filter(inside[0] & inside[1]).withColumns({"cx": floor_div("bx", per_cell), "cy": floor_div("by", per_cell)})


def attempted(rows: DataFrame, value: str, work: Callable[[object], object], kind: str) -> DataFrame:
    """Adds result and error of a Python function of a column for each row; a failure is kept as a value and the rest goes on."""

    @F.pandas_udf(f"result {kind}, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((work(v), None))
            except Exception as e:  # whatever the work raises is its result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["result", "error"], dtype=object)

    return rows.withColumn("_done", run(value)).select(*rows.columns, "_done.*")


def border_labels(squares: DataFrame, tasks: int | None = None) -> DataFrame:
    """For each square (layer, x, y) of objects (layer, id, type, name, x, y) the borders and labels it has.

    borders lists (id, type, open sides) of the objects whose border runs there; labels (id, type, name) of the named
    objects whose anchor it is, the least x + y and then x. Both are in order of id. Squares meet in as many tasks as are given.
    """
    from .borders import border_flags

    by = ["layer", "id", "type", "name"]
    sides = F.concat(*(F.when(F.col(s), "").otherwise(s) for s in "nesw"))
    edge = border_flags(squares, by).select(*by, "x", "y", sides.alias("sides"))
    anchor = squares.filter("name <> ''").groupBy(*by).agg(F.min(F.struct((F.col("x") + F.col("y")).alias("s"), "x", "y")).alias("a")).select(*by, "a.x", "a.y", F.lit(None).cast("string").alias("sides"))
    item = lambda c, when: F.array_sort(F.collect_list(F.when(when, F.struct("id", "type", F.col(c).alias("value")))))
    rows = edge.union(anchor)
    rows = rows.repartition(tasks, "layer", "x", "y") if tasks else rows
    return rows.groupBy("layer", "x", "y").agg(item("sides", F.col("sides").isNotNull()).alias("borders"), item("name", F.col("sides").isNull()).alias("labels"))
