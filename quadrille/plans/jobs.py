"""Render jobs by name as compositions of operators (§ jobs): a job takes frames and returns marks or coloured squares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import values as V
from ..functions.buffers import buffered
from ..functions.coords import BLOCK_SIZE, CELL_BLOCKS, GRID_HEIGHT, GRID_ROWS_PER_LAYER, GRID_WIDTH, floor_div, to_grid
from ..operators import joins, marks, pyramid, raster, windows
from ..operators.borders import border_flags
from ..operators.scanlines import column_runs
from ..sources.binary import FORMATS
from ..sources.text import pixel_zones
from ..storage import reliable

JOBS: dict[str, Callable[..., DataFrame]] = {}


def job(f: Callable) -> Callable:
    JOBS[f.__name__] = f
    return f


def _cell(form: str | None) -> int | Column:
    """Squares on a cell's side; without a format by the version in its header."""
    if form:
        return BLOCK_SIZE[form] * CELL_BLOCKS[form]
    return F.when(F.col("version") == 0, _cell(FORMATS[0])).otherwise(_cell(FORMATS[1]))


def draws(squares: DataFrame, grid: tuple[int, int] = (GRID_WIDTH, GRID_HEIGHT)) -> DataFrame:
    """(layer, px, py, gy, gx, pos, name): where the tiles of squares (layer, sx, sy, pos, tile) are drawn, from the back to the front.

    A square's anchor is the middle of its lower edge; images of layers are moved so that layers lie over each other.
    """
    gx, gy = to_grid("sx", "sy")
    lifted = gy - F.col("layer") * GRID_ROWS_PER_LAYER
    return squares.select("layer", (gx * grid[0]).alias("px"), (lifted * grid[1] + grid[1]).alias("py"), gy.alias("gy"), gx.alias("gx"), "pos", F.col("tile").alias("name"))


@job
def base(squares: DataFrame, textures: DataFrame, tile: int = 1024, grid: tuple[int, int] = (GRID_WIDTH, GRID_HEIGHT), levels: int = 0) -> DataFrame:
    """Tiles of the isometric image of squares (layer, sx, sy, pos, tile) and of `levels` levels above it; tiles without a texture drop out."""
    tiles = raster.compose(draws(squares, grid), textures, tile, ("gy", "gx", "pos"))
    return raster.image_pyramid(tiles, levels) if levels else tiles


@job
def base_top(squares: DataFrame, textures: DataFrame, how: str = "mean", water: tuple[str, ...] = ()) -> DataFrame:
    """A colour for each square; `rules` takes the ground rules, which need no textures."""
    keyed = squares.withColumn("square", F.struct("layer", "sx", "sy"))
    if how == "rules":
        stacks = keyed.groupBy("square").agg(F.array_sort(F.collect_list(F.struct("pos", "tile"))).alias("t"))  # a square's stack
        return stacks.select("square.*", V.ground_colour(F.transform("t", lambda t: t["tile"]), "square.layer").alias("css")).filter("css is not null")
    out = pyramid.square_colours(keyed.select("square", "pos", "tile"), textures, how, water)
    return out.select("square.*", V.css("r", "g", "b").alias("css"))


@job
def rooms(headers: DataFrame, form: str | None = None) -> DataFrame:
    """Rooms as area marks in world coordinates; of rooms with equal rectangles the last counts. Cells may be of both formats."""
    r = headers.filter("error is null").select("cx", "cy", "version", F.explode("rooms").alias("r"))
    at = lambda q: F.struct((q["x"] + F.col("cx") * _cell(form)).alias("x"), (q["y"] + F.col("cy") * _cell(form)).alias("y"), q["w"].alias("width"), q["h"].alias("height"))
    area = F.aggregate("r.rects", F.lit(0).cast("bigint"), lambda s, q: s + q["w"] * q["h"])
    name = F.decode("r.name", "iso-8859-1")
    rows = r.select(F.concat_ws("-", "cx", "cy", F.col("r.id")).alias("id"), F.lit("area").alias("type"), name.alias("name"), F.col("r.layer").alias("layer"), F.transform("r.rects", at).alias("rects"), area.alias("area"), V.lookup(name, V.ROOM_COLOURS, V.ROOM_DEFAULT).alias("color"), F.col("r.id").alias("ord"))
    return windows.first_of(rows, ["layer", "rects"], ["ord"], last=True).drop("ord")


@job
def zombie(population: DataFrame, form: str = "B42") -> DataFrame:
    """Blocks with population as coloured rectangles of squares; zombie_top and marks share them."""
    size, side = BLOCK_SIZE[form], CELL_BLOCKS[form]
    x, y = (F.col("cx") * side + F.col("bx")) * size, (F.col("cy") * side + F.col("by")) * size
    return population.filter("z > 0").select(x.alias("x"), y.alias("y"), F.lit(size).alias("w"), F.lit(size).alias("h"), "z", V.css(*V.heat("z")).alias("css"))


JOBS["zombie_top"] = zombie


@job
def foraging(pixels: DataFrame, zones: DataFrame, colours: dict[str, str], form: str = "B42") -> DataFrame:
    """Runs of equally zoned pixels of each raster row, in world coordinates.

    Zones without a colour, or with `skip`, are not painted, nor are pixels without a zone; all of them end a run.
    """
    one = pixel_zones(zones) if "ord" in zones.columns else zones.filter(F.col("pixel").between(0, 255)).groupBy("pixel").agg(F.max("zone").alias("zone"))
    zoned = pixels.join(F.broadcast(one), "pixel", "left")  # a row for each of 256 values at most
    rows = windows.fill_runs(zoned.withColumn("zone", F.coalesce("zone", F.lit(""))), ["cx", "cy", "y"], "x", "zone")  # null would be a wildcard
    css = V.lookup("zone", colours)
    return rows.select((F.col("start") + F.col("cx") * _cell(form)).alias("x"), (F.col("y") + F.col("cy") * _cell(form)).alias("y"), F.col("length").alias("w"), F.lit(1).alias("h"), "zone", css.alias("color")).filter("color <> 'skip'")


JOBS["foraging_top"] = foraging


@job
def foraging_b41(zones: DataFrame, colours: dict[str, str], block: int = 256) -> DataFrame:
    """Vertical runs of squares of the older format's foraging zones (x, y, w, h, zone, color): of zones that overlap the first counts.

    Zones (path, ord, type, z and a shape) are those of the ground with a colour that isn't `skip`. Shapes come as runs of
    columns, which are cut where any run of their column begins or ends; of each piece the first zone is kept. Columns
    are dealt in blocks, so that a task's pieces don't grow with the map's height. No square is listed.
    """
    used = [k for k, v in colours.items() if v != "skip"]
    own = reliable(zones.filter(F.col("type").isin(*used) & (F.col("z") == 0)))
    rects = object_rects(own).withColumn("x", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)))
    runs = rects.select("path", "ord", "x", F.col("y").alias("s"), (F.col("y") + F.col("h")).alias("e")).join(own.select("path", "ord", "type"), ["path", "ord"])
    cut = runs.withColumn("b", F.explode(F.sequence(floor_div("s", block), floor_div(F.col("e") - 1, block))))
    cut = cut.select("path", "ord", "type", "x", "b", F.greatest("s", F.col("b") * block).alias("s"), F.least("e", (F.col("b") + 1) * block).alias("e"))
    marks_ = cut.select("x", "b", F.explode(F.array("s", "e")).alias("at")).groupBy("x", "b").agg(F.array_sort(F.collect_set("at")).alias("marks"))  # one more than a block's rows at most
    inside = F.filter("marks", lambda m: (m >= F.col("s")) & (m <= F.col("e")))
    pieces = cut.join(marks_, ["x", "b"]).withColumn("m", inside)
    pairs = F.zip_with(F.slice("m", F.lit(1), F.size("m") - 1), F.slice("m", F.lit(2), F.size("m") - 1), lambda a, b: F.struct(a.alias("s"), b.alias("e")))
    first = pieces.select("x", "path", "ord", "type", F.explode(pairs).alias("p")).groupBy("x", "p.s", "p.e").agg(F.min_by("type", F.struct("path", "ord")).alias("zone"))
    merged = windows.merge_intervals(first, ["x", "zone"])
    return merged.select("x", F.col("s").alias("y"), F.lit(1).alias("w"), (F.col("e") - F.col("s")).alias("h"), "zone", V.lookup("zone", colours).alias("color"))


def object_rects(zones: DataFrame) -> DataFrame:
    """(path, ord, x, y, w, h) of zones: rectangles as they are, polygons and buffered polylines as covers of their squares.

    A square belongs to a shape if its middle does. Polylines without a width, and shapes without points, have none.
    """
    kind = F.coalesce("geometry", F.lit("rect"))
    plain = zones.filter(kind == "rect").select("path", "ord", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))
    points = G.array_to_points("points")
    shapes = zones.filter(kind.isin("polygon", "polyline") & (F.size("points") >= 2)).select("path", "ord", F.when(kind == "polygon", points).otherwise(buffered(points, F.col("lineWidth").cast("double"))).alias("ring"))
    runs = column_runs(shapes.filter(F.size("ring") > 1), ["path", "ord"])
    return plain.unionByName(windows.strips(runs, ["path", "ord"]).select("path", "ord", "x", "y", "w", "h"))


@job
def objects(zones: DataFrame, colours: dict[str, str], layers: tuple[int, int] = (0, 1)) -> DataFrame:
    """An area mark for each zone of a configured type: id, type, name, layer, color and rects, whatever its shape."""
    used = [k for k, v in colours.items() if v != "skip"]
    rows = reliable(zones.filter(F.col("type").isin(*used) & (F.col("z") >= layers[0]) & (F.col("z") < layers[1])))  # decoded once, read by each kind of shape
    rects = object_rects(rows).groupBy("path", "ord").agg(F.array_sort(F.collect_list(F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")))).alias("rects"))  # of one zone
    return rows.join(rects, ["path", "ord"]).select(F.hex(F.xxhash64("path", "ord")).alias("id"), F.lit("area").alias("type"), F.coalesce("name", F.lit("")).alias("name"), F.col("z").alias("layer"), V.lookup("type", colours).alias("color"), "rects")


@job
def object_cells(zones: DataFrame, colours: dict[str, str], layers: tuple[int, int] = (0, 1), form: str = "B42") -> DataFrame:
    """The marks of objects() with each cell (cx, cy) that one of their rectangles lies in."""
    marks_ = objects(zones, colours, layers)
    boxes = marks_.select("*", F.explode("rects").alias("q")).select("*", "q.x", "q.y", F.col("q.width").alias("w"), F.col("q.height").alias("h"))
    return joins.cells_of(boxes, _cell(form)).drop("q", "x", "y", "w", "h").distinct()


@job
def streets(roads: DataFrame) -> DataFrame:
    """Streets as polyline marks, shown from a zoom level by class."""
    level = V.street_class("points", "width")
    return roads.select(F.hex(F.xxhash64("name", "points")).alias("id"), F.lit("polyline").alias("type"), "name", "width", "points", level.alias("visible_zoom_level"))


@job
def save(sprites: DataFrame, names: DataFrame) -> DataFrame:
    """Decoded save squares (wx, wy, layer, x, y, pos, sprite) with the names of their sprites, as squares for base and base_top."""
    return sprites.join(names, "sprite").select("layer", F.col("x").alias("sx"), F.col("y").alias("sy"), "pos", "tile")


JOBS["save_top"] = save


@job
def room_borders(headers: DataFrame, form: str | None = None, tasks: int | None = None) -> DataFrame:
    """Border squares of each room, for the rooms image. Cells may be of both formats. Rooms are dealt to as many tasks as are given."""
    from ..functions.geometry import squares_of

    r = headers.filter("error is null").select("cx", "cy", "version", F.explode("rooms").alias("r")).select("cx", "cy", "version", F.col("r.id").alias("room"), F.explode("r.rects").alias("q"))
    r = r.repartition(tasks, "cx", "cy", "room") if tasks else r  # before squares are made: a room's meet without a shuffle
    base_ = F.col("q.x") + F.col("cx") * _cell(form), F.col("q.y") + F.col("cy") * _cell(form)
    squares = r.select("cx", "cy", "room", F.explode(squares_of(*base_, F.col("q.w"), F.col("q.h"))).alias("p")).select("cx", "cy", "room", "p.x", "p.y").distinct()
    return border_flags(squares, ["cx", "cy", "room"])


@job
def locate(named: DataFrame, headers: DataFrame, wanted: list[str], limit: int = 128) -> DataFrame:
    """Squares with wanted tiles as point marks; shown later if there are many."""
    from ..operators.relational import located

    dictionary = headers.filter("error is null").select("cx", "cy", F.explode("tiles").alias("tile"))
    found = located(dictionary, named, wanted, ["cx", "cy"]).select(F.lit("point").alias("type"), F.col("sx").alias("x"), F.col("sy").alias("y"), "layer", F.col("tile").alias("name"))
    n = found.agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(n)).withColumn("visible_zoom_level", F.when(F.col("n") >= limit, 2).otherwise(1)).drop("n")  # one row is broadcast


def mark_table(frame: DataFrame) -> DataFrame:
    """Any job's marks with their boxes, ready for marks.laid_out()."""
    return marks.boxed(frame)
