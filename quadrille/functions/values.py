"""Colours, classes, texts, dictionaries and options as column expressions."""

from __future__ import annotations

from functools import partial
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coords import col

# fixed values: room names and their colours
ROOM_COLOURS = {
    "gym": "lime", "garagestorage": "orange", "storage": "orange", "garage": "orange", "warehouse": "orange", "closet": "orange", "construction": "orange", "factory": "orange", "firestorage": "orange", "shed": "orange", "pawnshop": "orange", "pawnshopstorage": "orange",
    "toolstore": "magenta", "storageunit": "magenta", "farmstorage": "magenta", "loggingfactory": "magenta", "toolstorage": "blue", "empty": "silver", "emptyoutside": "silver",
}
ROOM_DEFAULT = "cyan"
# fixed values: ends of long labels before which they break, in order of preference
LABEL_ENDS = ("store", "storage", "kitchen", "bathroom", "room", "rooms", "factory", "occupied", "dining", "warehouse", "restaurant", "clothes", "station", "game", "stand", "shipping", "cooking", "office", "print", "bottling")
# fixed values: colours of named kinds
COLOUR_NAMES = {"red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "lime": (0, 255, 0), "orange": (255, 165, 0), "magenta": (255, 0, 255), "silver": (192, 192, 192), "cyan": (0, 255, 255), "gray": (128, 128, 128), "white": (255, 255, 255), "black": (0, 0, 0)}
# fixed values: ground rules (first position, end position or none, pattern, red, green, blue), first that hits wins
GROUND_RULES = (
    (0, 5, "vegetation_farm", (218, 165, 32)),
    (1, None, "(_trees|jumbo)", (38, 53, 22)),
    (0, 1, "location_", (132, 81, 76)),
    (1, None, "_railroad", (73, 58, 43)),
    (1, None, "^vegetation", (48, 73, 32)),
    (1, 100, "^walls", (93, 44, 39)),
    (0, 1, r"_natural_(.*_)*0*2_\d+$", (108, 127, 131)),
    (0, 1, "_street_", (128, 128, 128)),
    (0, 1, "_natural_(.*_)*0*1_0*([0-9]|1[0-5])$", (217, 207, 183)),
    (0, 1, "_natural_(.*_)*0*1_0*(1[6-9]|2[0-9]|3[0-1])$", (75, 88, 27)),
    (0, 1, "_natural_(.*_)*0*1_0*(3[2-9]|4[0-7])$", (97, 103, 36)),
    (0, 1, "_natural_(.*_)*0*1_0*(4[8-9]|5[0-9]|6[0-3])$", (127, 120, 45)),
    (0, 1, "_natural_(.*_)*0*1_0*(6[4-9]|7[0-9])$", (91, 63, 21)),
    (0, 8, "location_", (132, 81, 76)),
)
UPPER_RULES = ((1, 100, "^walls", (93, 44, 39)),)


def _matches(pattern: str, t: Column) -> Column:
    return t.rlike(pattern)


def css(r, g, b) -> Column:
    return F.format_string("#%02x%02x%02x", col(r).cast("int"), col(g).cast("int"), col(b).cast("int"))


def heat(z) -> tuple[Column, Column, Column]:
    """Red, green, blue of a population 0 to 255: blue to green to red."""
    z = col(z)
    hot = z >= 128
    return F.when(hot, (z - 128) * 2).otherwise(0), F.when(hot, 255 - (z - 128) * 2).otherwise(z * 2), F.when(hot, 0).otherwise(255 - z * 2)


def lookup(key, values: dict, default=None) -> Column:
    """Value of a fixed dictionary as one map look-up, no join."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))
    return F.coalesce(F.try_element_at(table, col(key)), F.lit(default))


def colour(name, default: str, alpha: int) -> Column:
    """RGBA of a colour's name as #rrggbbaa, of the default's for unknown names; null for `skip`."""
    table = {k: "#" + "".join(f"{c:02x}" for c in (*v, alpha)) for k, v in COLOUR_NAMES.items()}
    return F.when(F.lower(col(name)) != "skip", lookup(F.lower(col(name)), table, table[default]))


def street_class(points, width) -> Column:
    """0 for wide or long streets, 1 for middling, 2 for small ones."""
    span = lambda axis: F.array_max(F.transform(col(points), lambda p: p[axis])) - F.array_min(F.transform(col(points), lambda p: p[axis]))
    size = F.greatest(span("x"), span("y"))
    return F.when((size > 512) | (col(width) > 12), 0).when((size > 256) | (col(width) > 8), 1).otherwise(2)


def ground_colour(tiles, layer) -> Column:
    """Colour of the first rule that a tile in the rule's positions meets; null without one."""
    tiles = col(tiles)

    def chosen(rules) -> Column:
        options = []
        for begin, end, pattern, (r, g, b) in rules:
            part = F.slice(tiles, begin + 1, F.greatest(F.least(F.size(tiles), F.lit(end) if end else F.size(tiles)) - begin, F.lit(0)))
            options.append(F.when(F.exists(part, partial(_matches, pattern)), F.lit(f"#{r:02x}{g:02x}{b:02x}")))
        return F.coalesce(*options)

    return F.when(col(layer) == 0, chosen(GROUND_RULES)).otherwise(chosen(UPPER_RULES))


def broken_label(text) -> Column:
    """A line break before the first known end, else in the middle."""
    text = col(text)
    n = F.length(text)
    out = F.concat(F.substring(text, F.lit(1), F.floor(n / 2).cast("int")), F.lit("\n"), text.substr(F.floor(n / 2).cast("int") + 1, n))
    for end in reversed(LABEL_ENDS):
        out = F.when(text.endswith(end), F.concat(text.substr(F.lit(1), n - len(end)), F.lit("\n" + end))).otherwise(out)
    return out


def is_light(r, g, b) -> Column:
    """Luma above the middle."""
    return col(r) * 0.2126 + col(g) * 0.7152 + col(b) * 0.0722 > 128


def filled(template, values: dict) -> Column:
    """Template with the first {name} of each name replaced."""
    out = col(template)
    for name, value in values.items():
        mark = "{" + name + "}"
        at = F.instr(out, mark)
        out = F.when(at > 0, F.concat(out.substr(F.lit(1), at - 1), col(value).cast("string"), out.substr(at + len(mark), F.length(out)))).otherwise(out)
    return out


def folder_name(text) -> Column:
    """Characters other than word characters, dots and hyphens become underscores."""
    return F.regexp_replace(col(text), r"[^-\w.]", "_")


def scoped_option(options, map_name: str, command: str, strict: bool = False) -> Column:
    """Value of the most specific of key[map](command), key(command), key[map], key that is set.

    options is a map from the part after the key; without `strict`, empty and zero values count as not set.
    """
    options = col(options)
    tried = [F.try_element_at(options, F.lit(k)) for k in (f"[{map_name}]({command})", f"({command})", f"[{map_name}]", "")]
    return F.coalesce(*(t if strict else F.when(~F.coalesce(t, F.lit("")).isin("", "0", "false"), t) for t in tried))


def packed(pairs) -> Column:
    """Map as k:v items in order, joined by &&."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(col(pairs)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "&&")


def unpacked(text, key: str = "en") -> Column:
    """Inverse of packed(); an item without a key gets `key`."""
    items = F.split(col(text), "&&", -1)
    return F.map_from_entries(F.transform(items, lambda i: F.when(F.instr(i, ":") > 0, F.struct(F.substring_index(i, ":", 1).alias("k"), i.substr(F.instr(i, ":") + 1, F.length(i)).alias("v"))).otherwise(F.struct(F.lit(key).alias("k"), i.alias("v")))))


def merged(old, new) -> Column:
    """Map with the newer value of each key."""
    return F.map_zip_with(col(old), col(new), lambda k, a, b: F.coalesce(b, a))


def differing(old: dict, new: dict) -> Column:
    """Names of columns whose values differ, null-safe."""
    return F.array_compact(F.array(*(F.when(~old[k].eqNullSafe(new[k]), F.lit(k)) for k in old)))


def jumbo_sprite(file, tileset, tile) -> Column:
    """Computed id of a large tree's sprite."""
    return col(file) * 512 * 512 + col(tileset) * 512 + col(tile)


def absolute_anchor(text) -> Column:
    """Point of a label position `abs(x,y)`; null for others."""
    pattern = r"^abs\((\d+),(\d+)\)$"
    part = lambda i: F.regexp_extract(col(text), pattern, i).cast("bigint")
    return F.when(col(text).rlike(pattern), F.struct(part(1).alias("x"), part(2).alias("y")))


def label_position(how, rects) -> Column:
    """Where the label of an area of rectangles (x, y, w, h) stands, by its text position.

    `none` has no place, `centroid` is weighted by area, `top` is the least corner by x and y, `abs(x,y)` that point;
    everything else is the middle of the bounding box.
    """
    how, rects = col(how), col(rects)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    total = lambda one: F.aggregate(rects, F.lit(0.0), lambda s, r: s + one(r))
    area = total(lambda r: r["w"] * r["h"])
    mean = lambda at, n: total(lambda r: (r[at] + r[n] / 2) * r["w"] * r["h"]) / area
    middle = lambda at, n: (F.array_min(F.transform(rects, lambda r: r[at])) + F.array_max(F.transform(rects, lambda r: r[at] + r[n]))) / 2
    least, given = F.array_min(F.transform(rects, lambda r: F.struct(r["x"], r["y"]))), absolute_anchor(how)
    placed = F.when(how == "centroid", point(mean("x", "w"), mean("y", "h"))).when(how == "top", point(least["x"], least["y"])).when(given.isNotNull(), point(given["x"], given["y"]))
    return F.when(F.coalesce(how, F.lit("")) != "none", F.coalesce(placed, point(middle("x", "w"), middle("y", "h"))))


def deep_merged(old, new) -> Column:
    """Two nested options as maps from dotted paths to values, the newer put over the older.

    Branches are merged; a value takes the place of an older branch at its path, and a branch that of an older value.
    """
    names = F.map_keys(col(new))
    inside = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    kept = F.map_filter(col(old), lambda k, v: ~F.exists(names, lambda n: (n == k) | inside(k, n) | inside(n, k)))
    return F.map_concat(kept, col(new))


def same_json(a, b) -> Column:
    """Whether two JSON texts have equal values, whatever the order of their keys and their spacing; null for invalid ones.

    Spark doesn't look at text behind a whole value, so that a text has to be one item of a list and one entry of an object.
    """

    def plain(c) -> Column:
        item = F.try_parse_json(F.concat(F.lit("["), col(c), F.lit("]")))
        entry = F.try_parse_json(F.concat(F.lit('{"a":'), col(c), F.lit("}")))
        one = F.size(F.try_variant_get(item, "$", "array<variant>")) == 1
        return F.when(one & entry.isNotNull(), F.to_json(item))

    return plain(a) == plain(b)


def pack_chosen(name, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a file is a texture pack of full size, or matches one of the allowed patterns from its start."""
    name = col(name)
    if allowed:
        return name.rlike("^(?:" + "|".join(f"(?:{p})" for p in allowed) + ")")
    return F.endswith(name, F.lit(".pack")) & ~F.contains(name, F.lit("1x")) & ~F.contains(name, F.lit("temp"))
