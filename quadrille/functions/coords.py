"""Coordinates as column expressions: squares, blocks, cells, isometric grid, tiles, pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sizes in pixels and grid rows of the isometric projection
SQUARE_HEIGHT, SQUARE_WIDTH = 64, 128
GRID_HEIGHT, GRID_WIDTH = 32, 64
LAYER_HEIGHT, GRID_ROWS_PER_LAYER = 192, 6
TEXTURE_WIDTH, TEXTURE_HEIGHT, LARGE_TEXTURE_WIDTH, LARGE_TEXTURE_HEIGHT = 128, 256, 384, 512
# fixed values: squares of a block and blocks of a cell, by format version
BLOCK_SIZE = {"B41": 10, "B42": 8}
CELL_BLOCKS = {"B41": 30, "B42": 32}
LAYERS = {"B41": (0, 8), "B42": (-32, 32)}
# fixed values: squares' size in pixels from which a zoom level holds
ZOOM_STEPS = {"iso": (0, 1, 8, 32), "top": (0, 1, 8, 16)}


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def floor_div(a, n) -> Column:
    """Integer quotient rounded down, exact for all longs."""
    a, n = col(a).cast("bigint"), col(n).cast("bigint")
    return F.call_function("div", a - F.pmod(a, n), n)


def floor_mod(a, n) -> Column:
    return F.pmod(col(a).cast("bigint"), col(n).cast("bigint"))


def to_grid(x, y) -> tuple[Column, Column]:
    """Square to isometric grid."""
    return col(x) - col(y), col(x) + col(y)


def from_grid(gx, gy) -> tuple[Column, Column]:
    """Isometric grid to square; null where the grid point is no square."""
    even = F.pmod(col(gx) + col(gy), F.lit(2)) == 0
    return F.when(even, floor_div(col(gx) + col(gy), 2)), F.when(even, floor_div(col(gy) - col(gx), 2))


def tile_to_grid(tx, ty, layer, origin=(0, 0), per_tile=(16, 32)) -> tuple[Column, Column]:
    """Grid origin of a tile, moved down by its layer."""
    return col(tx) * per_tile[0] + origin[0], col(ty) * per_tile[1] + origin[1] + col(layer) * GRID_ROWS_PER_LAYER


def grid_to_pixel(gx, gy) -> tuple[Column, Column]:
    """Pixel centre of a grid point."""
    return col(gx) * GRID_WIDTH, col(gy) * GRID_HEIGHT


def tile_to_cell(tx, ty, cell, origin=(0, 0)) -> tuple[Column, Column]:
    """Top-view tile to cell, one tile for each cell (P5)."""
    return col(tx) + floor_div(F.lit(origin[0]), cell), col(ty) + floor_div(F.lit(origin[1]), cell)


def align(origin, step) -> Column:
    """Rounds down to a multiple of step; step 0 leaves the value."""
    step = col(step).cast("bigint")
    return F.when(step == 0, col(origin)).otherwise(floor_div(origin, F.when(step == 0, 1).otherwise(step)) * step)


def normal_rects(rects) -> Column:
    """Rectangles [x, y] become unit squares, other arities but four go."""
    whole = F.filter(col(rects), lambda r: F.size(r).isin(2, 4))
    return F.transform(whole, lambda r: F.when(F.size(r) == 2, F.concat(r, F.array(F.lit(1), F.lit(1)))).otherwise(r))


def pyramid_sizes(w, h) -> Column:
    """Sizes from (w, h) down to (1, 1), each half of the one before, rounded up."""
    n = F.ceil(F.log2(F.greatest(col(w), col(h)).cast("double"))).cast("int")
    up = lambda v, k: F.call_function("shiftright", col(v) - 1, k) + 1
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(up(w, k).alias("w"), up(h, k).alias("h")))


def morton(x, y) -> Column:
    """Z-order key of non-negative 31-bit coordinates: x on even bits, y on odd ones."""

    def spread(v: Column) -> Column:
        v = v.cast("bigint")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(col(x)).bitwiseOR(F.shiftleft(spread(col(y)), 1))


def parent(t, levels: int = 1) -> Column:
    """Tile coordinate some levels up the pyramid; rounds down below zero too (P10)."""
    return F.shiftright(col(t), levels)


def children(tx, ty) -> Column:
    """The four tiles below a tile (P10)."""
    return F.array(*(F.struct((col(tx) * 2 + dx).alias("tx"), (col(ty) * 2 + dy).alias("ty")) for dy in (0, 1) for dx in (0, 1)))


def shift_points(points, layer) -> Column:
    """Points moved up by their layer in the isometric view."""
    return F.transform(col(points), lambda p: F.struct((p["x"] - col(layer) * 3).alias("x"), (p["y"] - col(layer) * 3).alias("y")))


def square_to_canvas(x, y, layer, step: float, view: str) -> tuple[Column, Column]:
    """Canvas position of a square."""
    if view == "top":
        return col(x) * step, col(y) * step
    return (col(x) - col(y)) * step / 2, (col(x) + col(y)) * step / 4 - col(layer) * (1.5 * step)


def canvas_to_square(px, py, layer, step: float, view: str) -> tuple[Column, Column]:
    """Square under a canvas position."""
    if view == "top":
        return F.floor(col(px) / step), F.floor(col(py) / step)
    gx, gy = col(px) / step, (col(py) + col(layer) * (1.5 * step)) * 2 / step
    return F.floor(gy + gx), F.floor(gy - gx)


def convert_unit(v, size_from: int, size_to: int) -> Column:
    """Between squares, blocks and cells."""
    return floor_div(col(v) * size_from, size_to)


def zoom_level(step, view: str) -> Column:
    """Highest zoom level whose least step is reached (P25)."""
    out = F.lit(0)
    for level, least in enumerate(ZOOM_STEPS[view]):
        out = F.when(col(step) >= least, level).otherwise(out)
    return out


def render_margin(large: bool) -> tuple[int, int, int, int]:
    """Grid margin around a tile from which textures reach into it: left, top, right, bottom."""
    w, h = (LARGE_TEXTURE_WIDTH, LARGE_TEXTURE_HEIGHT) if large else (TEXTURE_WIDTH, TEXTURE_HEIGHT)
    side = w // 2 // GRID_WIDTH - 1
    return -side, 0, side, h // GRID_HEIGHT - 2


def affected_margin(margin: tuple[int, int, int, int], layers: tuple[int, int] = (0, 1)) -> tuple[int, int, int, int]:
    """Grid margin around a square that it reaches, from the margin of a tile."""
    left, top, right, bottom = margin
    up, down = max(layers[1], 0) if layers[1] > 1 else 0, min(layers[0], 0)
    return -1 - right, -1 - bottom - up * GRID_ROWS_PER_LAYER, 1 - left, 1 - top - down * GRID_ROWS_PER_LAYER


def tile_path(layer, level, tx, ty, ext) -> Column:
    """Path of a tile below a pyramid's folder."""
    return F.format_string("layer%d_files/%d/%d_%d.%s", col(layer), col(level), col(tx), col(ty), col(ext))


def tile_of_path(path) -> Column:
    """Layer, level, tx, ty and extension of a tile's path; null for other paths."""
    pattern = r"(?:^|/)layer(-?\d+)_files/(\d+)/(\d+)_(\d+)\.(\w+)$"
    part = lambda i: F.regexp_extract(col(path), pattern, i)
    names = ("layer", "level", "tx", "ty")
    return F.when(col(path).rlike(pattern), F.struct(*(part(i).cast("bigint").alias(n) for i, n in enumerate(names, 1)), part(5).alias("ext")))
