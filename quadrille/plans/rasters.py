"""Queries over pyramids, heat maps and square colours (A1-A5, A13, J1, J2, J15, X4, jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import values as V
from ..operators import pyramid as P
from .catalogue import query
from .views import view

LEVELS = 10


@query(f"""SELECT CAST(k AS BIGINT) AS level, layer, CAST(floor(x / pow(2, k)) AS BIGINT) AS tx, CAST(floor(y / pow(2, k)) AS BIGINT) AS ty, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS sum_v, max(v) AS max_v
  FROM v_points, range(0, {LEVELS + 1}) t(k) GROUP BY ALL""")
def A13_pyramid(spark, d):
    return P.pyramid(view(spark, d, "v_points"), LEVELS).withColumn("level", F.col("level").cast("bigint"))


@query("""SELECT layer, CAST(floor(x / 8.0) AS BIGINT) AS bx, CAST(floor(y / 8.0) AS BIGINT) AS "by", least(255, count(*)) AS z FROM v_points GROUP BY 1, 2, 3""")
def S6_heat_blocks(spark, d):
    return P.heat_blocks(view(spark, d, "v_points"))


@query("""WITH p AS (SELECT l_suppkey AS tile, CAST(l_quantity AS BIGINT) AS r, l_partkey % 256 AS g, l_orderkey % 256 AS b, CASE WHEN l_linenumber > 4 THEN 255 ELSE 128 END AS a FROM lineitem)
  SELECT tile, CAST(coalesce(sum(r) FILTER (WHERE a = 255), 0) AS BIGINT) AS sum_r, CAST(coalesce(sum(g) FILTER (WHERE a = 255), 0) AS BIGINT) AS sum_g, CAST(coalesce(sum(b) FILTER (WHERE a = 255), 0) AS BIGINT) AS sum_b, CAST(greatest(count(*) FILTER (WHERE a = 255), 1) AS BIGINT) AS n FROM p GROUP BY tile""")
def A1_colour_sums(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    pixels = l.select(F.col("l_suppkey").alias("tile"), F.col("l_quantity").cast("bigint").alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"), F.when(F.col("l_linenumber") > 4, 255).otherwise(128).alias("a"))
    return P.colour_sums(pixels, ["tile"])


def _stacks(spark, d):
    """Draw order: by line, then tile; equal (line, tile) are the same tile."""
    from pyspark.sql import Window

    order = Window.partitionBy("square").orderBy("line", "tile")
    return view(spark, d, "v_stacks").withColumn("pos", F.row_number().over(order) - 1).select("square", "pos", "tile")


_ST = "s AS (SELECT square, tile, row_number() OVER (PARTITION BY square ORDER BY line, tile) - 1 AS pos FROM v_stacks)"
_MEAN = "CAST(floor(sum(sum_r) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS r, CAST(floor(sum(sum_g) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS g, CAST(floor(sum(sum_b) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS b"


@query(f"WITH {_ST} SELECT square, {_MEAN} FROM s JOIN v_textures USING (tile) WHERE pos = 0 GROUP BY square")
def A3_first_tile_colour(spark, d):
    return P.square_colours(_stacks(spark, d), view(spark, d, "v_textures"), "first")


_WATER = tuple(range(1, 400, 3))


@query(f"WITH {_ST}, c AS (SELECT square, tile FROM s WHERE pos = 0 UNION ALL SELECT square, arg_min(tile, pos) FROM s WHERE pos > 0 AND tile IN ({', '.join(map(str, _WATER))}) GROUP BY square) SELECT square, {_MEAN} FROM c JOIN v_textures USING (tile) GROUP BY square")
def A4_water_colour(spark, d):
    return P.square_colours(_stacks(spark, d), view(spark, d, "v_textures"), "water", _WATER)


@query(f"SELECT square, {_MEAN} FROM v_stacks JOIN v_textures USING (tile) GROUP BY square")
def A5_mean_colour(spark, d):
    return P.square_colours(view(spark, d, "v_stacks"), view(spark, d, "v_textures"), "mean")


def _top(spark, d, how, *water):
    from .jobs import JOBS

    s = _stacks(spark, d).select((F.col("square") % 3).alias("layer"), (F.col("square") % 100).alias("sx"), F.expr("square div 100").alias("sy"), "pos", "tile")
    return JOBS["base_top"](s, view(spark, d, "v_textures"), how, *water)


_CSS = "SELECT square % 3 AS layer, square % 100 AS sx, square // 100 AS sy, printf('#%02x%02x%02x', r, g, b) AS css FROM m"


@query(f"WITH {_ST}, m AS (SELECT square, {_MEAN} FROM s JOIN v_textures USING (tile) WHERE pos = 0 GROUP BY square) {_CSS}")
def job_base_top_first(spark, d):
    """Top view by the lowest tile of each square."""
    return _top(spark, d, "first")


@query(f"WITH {_ST}, c AS (SELECT square, tile FROM s WHERE pos = 0 UNION ALL SELECT square, arg_min(tile, pos) FROM s WHERE pos > 0 AND tile IN ({', '.join(map(str, _WATER))}) GROUP BY square), m AS (SELECT square, {_MEAN} FROM c JOIN v_textures USING (tile) GROUP BY square) {_CSS}")
def job_base_top_water(spark, d):
    """Top view by the lowest tile of each square and the lowest half water tile above it."""
    return _top(spark, d, "water", _WATER)


@query("SELECT s.tile, CAST(count(*) AS BIGINT) AS uses FROM v_stacks s LEFT JOIN v_textures t USING (tile) WHERE t.tile IS NULL GROUP BY s.tile")
def J2_missing_textures(spark, d):
    return view(spark, d, "v_stacks").join(view(spark, d, "v_textures"), "tile", "left_anti").groupBy("tile").agg(F.count("*").alias("uses"))


@query("""SELECT tile, arg_min(pack, CASE WHEN pack % 3 = 1 THEN 0 WHEN pack % 3 = 0 THEN 1 ELSE 2 END * 1000000 + pack) AS pack FROM v_packs GROUP BY tile""")
def J3_ordered_lookup(spark, d):
    rank = F.when(F.col("pack") % 3 == 1, 0).when(F.col("pack") % 3 == 0, 1).otherwise(2)
    return view(spark, d, "v_packs").groupBy("tile").agg(F.min_by("pack", F.struct(rank.alias("r"), F.col("pack"))).alias("pack"))


@query("""WITH b AS (SELECT layer, CAST(floor(x / 8.0) AS BIGINT) AS bx, CAST(floor(y / 8.0) AS BIGINT) AS "by", least(255, count(*) * 20) AS z FROM v_points GROUP BY 1, 2, 3), t AS (SELECT bx * 8 AS x, "by" * 8 AS y, z FROM b WHERE layer = 0)
  SELECT CAST(floor(x / 64.0) AS BIGINT) AS tx, CAST(floor(y / 64.0) AS BIGINT) AS ty, printf('#%02x%02x%02x', CASE WHEN z >= 128 THEN (z - 128) * 2 ELSE 0 END, CASE WHEN z >= 128 THEN 255 - (z - 128) * 2 ELSE z * 2 END, CASE WHEN z >= 128 THEN 0 ELSE 255 - z * 2 END) AS css, CAST(count(*) AS BIGINT) AS blocks FROM t GROUP BY 1, 2, 3""")
def X4_heat_job(spark, d):
    b = view(spark, d, "v_points").filter("layer = 0").groupBy(C.floor_div("x", 8).alias("bx"), C.floor_div("y", 8).alias("by")).agg(F.least(F.lit(255), F.count("*") * 20).alias("z"))
    return b.groupBy(C.floor_div(F.col("bx") * 8, 64).alias("tx"), C.floor_div(F.col("by") * 8, 64).alias("ty"), V.css(*V.heat("z")).alias("css")).agg(F.count("*").alias("blocks"))


@query("""SELECT p.x, p.y, min(CASE p.v % 3 WHEN 0 THEN '#ff000080' WHEN 1 THEN '#80808080' END) AS colour FROM v_points p GROUP BY p.x, p.y""")
def J15_pixel_colours(spark, d):
    p = view(spark, d, "v_points").select("x", "y", (F.col("v") % 3).alias("pixel"))
    zones = spark.sql("SELECT * FROM VALUES (0L, 'red'), (1L, 'unknown'), (2L, 'skip') AS t(pixel, zone)")  # a fixed table of three rows
    return p.join(F.broadcast(zones), "pixel").groupBy("x", "y").agg(F.min(V.colour("zone", "gray", 128)).alias("colour"))


@query("""WITH k AS (SELECT p_brand AS cell, list(p_partkey ORDER BY p_partkey) AS tiles FROM part GROUP BY p_brand) SELECT r.id, k.tiles[1 + (r.id % 50)] AS tile FROM v_rects r JOIN k ON k.cell = r.type""")
def J1_dictionary_codes(spark, d):
    """Codes looked up in the dictionary of their own cell; a code beyond it is null."""
    part = spark.read.parquet(f"{d}/part.parquet")
    cells = part.groupBy(F.col("p_brand").alias("type")).agg(F.array_sort(F.collect_list("p_partkey")).alias("tiles"))  # a cell's dictionary
    return view(spark, d, "v_rects").join(cells, "type").select("id", F.get("tiles", (F.col("id") % 50).cast("int")).alias("tile"))
