"""Relational queries: catalogues, dictionaries, sources, set operations, incremental work (A, I, J10-J14, S, T, U, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords as C
from ..operators import incremental as I
from ..operators import joins as J
from ..operators import pyramid as P
from ..operators import relational as R
from ..sources import text as S
from ..storage import tasks_for
from .catalogue import query
from .views import view

_D = lambda a, n: f"CAST(floor(({a}) / {n}.0) AS BIGINT)"


@query("""WITH h AS (SELECT tile, count(DISTINCT pack) AS packs, min(pack) AS first_pack FROM v_packs WHERE pack % 7 > 1 GROUP BY tile), u AS (SELECT DISTINCT tile FROM v_stacks)
  SELECT u.tile, CAST(coalesce(packs, 0) AS BIGINT) AS packs, first_pack, CASE WHEN packs IS NULL THEN 'missing' WHEN packs > 1 THEN 'several' ELSE 'one' END AS state FROM u LEFT JOIN h USING (tile)""")
def J11_pack_usage(spark, d):
    return R.pack_usage(view(spark, d, "v_stacks"), view(spark, d, "v_packs").filter("pack % 7 > 1"))


@query("SELECT s.square, s.line, s.tile FROM v_stacks s WHERE tile IN (3, 14, 159) AND square IN (SELECT square FROM v_stacks WHERE tile IN (3, 14, 159))")
def J12_two_phase_locate(spark, d):
    s = view(spark, d, "v_stacks")
    dictionary = s.select("square", F.col("tile")).distinct()
    body = s.withColumn("t", F.col("tile")).withColumn("tile", F.col("tile").cast("string"))
    return R.located(dictionary.withColumn("tile", F.col("tile").cast("string")), body, ["3", "14", "159"], ["square"]).select("square", "line", F.col("t").alias("tile"))


@query("""WITH RECURSIVE r(root, node) AS (SELECT node, node FROM v_deps UNION ALL SELECT r.root, v_deps.needs FROM r JOIN v_deps ON r.node = v_deps.node) SELECT root, node FROM r""")
def J13_dependency_closure(spark, d):
    """From every node."""
    e = view(spark, d, "v_deps")
    return J.closure(e.select(F.col("node").alias("root")), e)


@query("""SELECT coalesce(a.c, b.c) AS c, a.n AS orders, b.n AS customers, CASE WHEN a.c IS NULL THEN 'no order' WHEN b.c IS NULL THEN 'no customer' ELSE 'both' END AS state
  FROM (SELECT CASE WHEN o_custkey % 4 = 1 THEN -1 - o_custkey ELSE o_custkey END AS c, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS c, count(*) AS n FROM customer GROUP BY 1) b ON a.c = b.c""")
def J14_id_mapping(spark, d):
    """All rows of both sides; keys on one side only come from mapping a quarter of the orders' keys below zero."""
    key = F.when(F.col("o_custkey") % 4 == 1, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(key.alias("c")).agg(F.count("*").alias("orders"))
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_custkey").alias("c")).agg(F.count("*").alias("customers"))
    state = F.when(F.col("orders").isNull(), "no order").when(F.col("customers").isNull(), "no customer").otherwise("both")
    return o.join(c, "c", "full_outer").select("c", "orders", "customers", state.alias("state"))


@query("SELECT type, CAST(count(*) AS BIGINT) AS rooms FROM v_rects GROUP BY type")
def A7_rooms_by_name(spark, d):
    return view(spark, d, "v_rects").groupBy("type").agg(F.count("*").alias("rooms"))


@query("SELECT DISTINCT tile FROM v_stacks")
def A8_used_tiles(spark, d):
    return view(spark, d, "v_stacks").select("tile").distinct()


@query("SELECT ux, uy, max(mtime) AS mtime, string_agg(sig, ',' ORDER BY sig) AS sigs FROM v_old GROUP BY ux, uy")
def A9_signatures(spark, d):
    return I.signatures(view(spark, d, "v_old"), ["ux", "uy"]).withColumn("sigs", F.array_join("sigs", ","))


@query("SELECT ux, uy, max(mtime) AS mtime, string_agg(sig, ',' ORDER BY sig) AS sigs FROM (SELECT * FROM v_old UNION ALL SELECT * FROM v_new) GROUP BY ux, uy")
def A10_merge_signatures(spark, d):
    key = ["ux", "uy"]
    parts = I.signatures(view(spark, d, "v_old"), key).union(I.signatures(view(spark, d, "v_new"), key))
    return I.merge_signatures(parts, key).withColumn("sigs", F.array_join("sigs", ","))


@query("SELECT ux, uy, min(mtime) AS mtime FROM v_old WHERE substr(sig, 1, 1) IN ('0', '1', '2', '3', '4', '5') GROUP BY ux, uy")
def A11_completed_tiles(spark, d):
    return I.completed(view(spark, d, "v_old").withColumn("ext", F.substring("sig", 1, 1)), ["ux", "uy"], tuple("012345"))


@query(f"SELECT {_D('x', 2)} AS tx, {_D('y', 2)} AS ty, CAST(count(*) AS BIGINT) AS children FROM (SELECT DISTINCT x, y FROM v_points) GROUP BY 1, 2")
def A12_dependency_count(spark, d):
    return P.dependencies(view(spark, d, "v_points").select(F.col("x").alias("tx"), F.col("y").alias("ty")).distinct())


@query("SELECT layer, CAST(count(*) AS BIGINT) AS n, min(x) AS low_x, max(x) AS high_x, min(v) AS least, max(v) AS most FROM v_points GROUP BY layer")
def A14_layer_inventory(spark, d):
    return view(spark, d, "v_points").groupBy("layer").agg(F.count("*").alias("n"), F.min("x").alias("low_x"), F.max("x").alias("high_x"), F.min("v").alias("least"), F.max("v").alias("most"))


@query(f"""WITH b AS (SELECT DISTINCT bx, b_y, saved, selected FROM v_blocks), c AS (SELECT {_D('bx', 8)} AS cx, {_D('b_y', 8)} AS cy, count(*) FILTER (WHERE saved) AS saved, count(*) FILTER (WHERE saved AND selected) AS selected FROM b GROUP BY 1, 2)
  SELECT cx, cy, CAST(saved AS BIGINT) AS saved, CAST(selected AS BIGINT) AS selected, CASE WHEN selected > 0 AND selected = saved THEN 'all selected' WHEN selected > 0 THEN 'some selected' WHEN saved = 64 THEN 'all saved' ELSE 'some saved' END AS state FROM c""")
def A16_X5_selection_state(spark, d):
    return R.selection_state(view(spark, d, "v_blocks").withColumnRenamed("b_y", "by").distinct(), 8)


@query("SELECT min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, min(x - y) AS d1, max(x - y) AS d2, min(x + y) AS s1, max(x + y) AS s2 FROM v_points")
def A17_extent(spark, d):
    gx, gy = C.to_grid("x", "y")
    p = view(spark, d, "v_points").select("x", "y", gx.alias("gx"), gy.alias("gy"))
    return p.agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.min("gx").alias("d1"), F.max("gx").alias("d2"), F.min("gy").alias("s1"), F.max("gy").alias("s2"))


@query("SELECT o_custkey AS map, count(DISTINCT o_orderpriority) = 1 AS uniform, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS versions FROM orders GROUP BY o_custkey")
def A18_version_check(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(F.col("o_custkey").alias("map")).agg((F.count_distinct("o_orderpriority") == 1).alias("uniform"), F.count_distinct("o_orderpriority").alias("versions"))


_OLD = "o AS (SELECT ux, uy, max(mtime) AS mtime, string_agg(sig, ',' ORDER BY sig) AS sigs FROM v_old GROUP BY ux, uy)"
_NEW = "n AS (SELECT ux, uy, max(mtime) AS mtime, string_agg(sig, ',' ORDER BY sig) AS sigs FROM v_new GROUP BY ux, uy)"


def _snapshots(spark, d):
    # uids 3 to 5 keep what they had, so that some units are unchanged
    key = ["ux", "uy"]
    old, new = view(spark, d, "v_old"), view(spark, d, "v_new")
    return I.signatures(old, key), I.signatures(new.filter("not ux between 3 and 5").unionByName(old.filter("ux between 3 and 5 and uy <> 4")), key)


_NEW2 = "n AS (SELECT ux, uy, max(mtime) AS mtime, string_agg(sig, ',' ORDER BY sig) AS sigs FROM (SELECT * FROM v_new WHERE NOT ux BETWEEN 3 AND 5 UNION ALL SELECT * FROM v_old WHERE ux BETWEEN 3 AND 5 AND uy <> 4) GROUP BY ux, uy)"


@query(f"""WITH {_OLD}, {_NEW2} SELECT coalesce(o.ux, n.ux) AS ux, coalesce(o.uy, n.uy) AS uy, CASE WHEN o.ux IS NULL THEN 'appeared' WHEN n.ux IS NULL THEN 'deleted' WHEN o.sigs = n.sigs THEN 'same' ELSE 'changed' END AS state,
  CASE WHEN o.ux IS NOT NULL AND n.ux IS NOT NULL AND o.sigs = n.sigs THEN n.mtime ELSE 1000001 END AS mtime FROM o FULL JOIN n ON o.ux = n.ux AND o.uy = n.uy""")
def I1_J10_snapshot_diff(spark, d):
    old, new = _snapshots(spark, d)
    return I.snapshot_diff(old, new, ["ux", "uy"], F.lit(1000001).cast("bigint"))


@query("""WITH s AS (SELECT tx, ty, max(m) AS m FROM (SELECT ux AS tx, uy AS ty, mtime AS m FROM v_new UNION ALL SELECT ux + 1, uy, mtime FROM v_new) GROUP BY tx, ty), t AS (SELECT ux AS tx, uy AS ty, max(mtime) AS m FROM v_old GROUP BY 1, 2)
  SELECT s.tx, s.ty FROM s LEFT JOIN t USING (tx, ty) WHERE t.m IS NULL OR t.m < s.m + 1""")
def I2_stale_tiles(spark, d):
    n = view(spark, d, "v_new")
    reach = n.select(F.explode(F.array(F.struct(F.col("ux").alias("tx"), F.col("uy").alias("ty")), F.struct((F.col("ux") + 1).alias("tx"), F.col("uy").alias("ty")))).alias("t"), "mtime").select("t.*", "mtime")
    done = view(spark, d, "v_old").groupBy(F.col("ux").alias("tx"), F.col("uy").alias("ty")).agg(F.max("mtime").alias("mtime"))
    return I.stale(reach, done, ["tx", "ty"], 1)


@query("SELECT DISTINCT k AS level, CAST(floor(x / pow(2, k)) AS BIGINT) AS tx, CAST(floor(y / pow(2, k)) AS BIGINT) AS ty FROM v_points, range(0, 7) t(k) WHERE layer = 1")
def I3_stale_ancestors(spark, d):
    p = view(spark, d, "v_points").filter("layer = 1").select(F.col("x").alias("tx"), F.col("y").alias("ty"))
    return P.stale_ancestors(p, 6).withColumn("level", F.col("level").cast("bigint"))


@query(f"""WITH {_OLD}, {_NEW2}, f AS (SELECT ux, uy FROM n WHERE ux % 4 = 1) SELECT ux, uy, mtime, sigs FROM n WHERE ux % 4 <> 1 UNION ALL SELECT o.ux, o.uy, o.mtime, o.sigs FROM o JOIN f USING (ux, uy)""")
def K9_commit_snapshot(spark, d):
    old, new = _snapshots(spark, d)
    failed = new.filter("ux % 4 = 1").select("ux", "uy")
    return I.committed(old, new, failed, ["ux", "uy"]).withColumn("sigs", F.array_join("sigs", ","))


@query("SELECT DISTINCT x AS bx, y AS by FROM (SELECT x, y FROM v_points WHERE layer < 0 UNION SELECT x, y FROM v_points WHERE layer = 2)")
def U1_union_cells(spark, d):
    p = view(spark, d, "v_points")
    return p.filter("layer < 0").select("x", "y").union(p.filter("layer = 2").select("x", "y")).distinct().toDF("bx", "by")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN w + 100 ELSE w END AS w FROM v_rects UNION ALL SELECT -id - 1, w FROM v_rects WHERE id % 5 = 0 AND id % 2 = 0")
def U2_D1_upsert(spark, d):
    from ..operators.marks import upserted

    r = view(spark, d, "v_rects").select("id", "w")
    changed = r.filter("id % 5 = 0")
    return upserted(r, changed.select("id", (F.col("w") + 100).alias("w")).union(changed.filter("id % 2 = 0").select(-F.col("id") - 1, "w")))


@query("SELECT x, y FROM v_points WHERE layer = 0 EXCEPT SELECT x, y FROM v_points WHERE layer = 1")
def U3_U5_difference(spark, d):
    p = view(spark, d, "v_points")
    return p.filter("layer = 0").select("x", "y").subtract(p.filter("layer = 1").select("x", "y"))


@query("""WITH s AS (SELECT DISTINCT bx, b_y FROM v_blocks WHERE selected), f AS (SELECT bx, b_y FROM v_blocks WHERE NOT selected), n AS (SELECT bx, b_y, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM f) GROUP BY bx, b_y)
  SELECT n.bx, n.b_y FROM n WHERE n % 2 = 1 AND EXISTS (SELECT 1 FROM v_blocks b WHERE b.saved AND b.bx = n.bx AND b.b_y = n.b_y)""")
def U4_toggle(spark, d):
    b = view(spark, d, "v_blocks")
    return R.toggled(b.filter("selected"), b.filter("not selected"), b.filter("saved").select("bx", "b_y").distinct(), ["bx", "b_y"])


@query(f"SELECT DISTINCT x AS tx, y AS ty FROM v_points p WHERE NOT EXISTS (SELECT 1 FROM v_points q WHERE q.v = 50 AND {_D('q.x', 8)} = {_D('p.x', 8)} AND {_D('q.y', 8)} = {_D('p.y', 8)})")
def U6_skipped_subtrees(spark, d):
    p = view(spark, d, "v_points")
    tiles = p.select(F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    gates = p.filter("v = 50").select(C.parent("x", 3).alias("tx"), C.parent("y", 3).alias("ty")).distinct()
    return I.without_skipped(tiles, gates, 3)


@query("SELECT sha256(text) AS digest, min(doc_id) AS keeper, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def D10_content_copies(spark, d):
    return R.copies(spark.read.parquet(f"{d}/documents.parquet"), "text", "doc_id")


@query("SELECT ux, uy, mtime, sig FROM v_new n WHERE NOT EXISTS (SELECT 1 FROM v_old o WHERE o.ux = n.ux AND o.uy = n.uy AND o.sig = n.sig)")
def I6_unseen_contents(spark, d):
    return view(spark, d, "v_new").join(view(spark, d, "v_old").select("ux", "uy", "sig"), ["ux", "uy", "sig"], "left_anti").select("ux", "uy", "mtime", "sig")


@query(f"""SELECT DISTINCT bx, b_y FROM v_blocks b WHERE NOT EXISTS (SELECT 1 FROM v_blocks s WHERE s.selected AND s.bx = b.bx AND s.b_y = b.b_y) AND ({_D('bx', 8)} + {_D('b_y', 8)}) % 5 <> 0""")
def D9_J17_retained_blocks(spark, d):
    b = view(spark, d, "v_blocks").withColumnRenamed("b_y", "by")
    blocks = b.select("bx", "by").distinct()
    cells = blocks.select(C.floor_div("bx", 8).alias("cx"), C.floor_div("by", 8).alias("cy")).distinct().filter("(cx + cy) % 5 = 0")
    return R.retained(blocks, b.filter("selected").select("bx", "by").distinct(), cells, 8).withColumnRenamed("by", "b_y")


@query("SELECT id, visible, CASE WHEN n >= 128 THEN 2 ELSE 1 END AS zoom FROM (SELECT id, w AS visible, count(*) OVER () AS n FROM v_rects)")
def T6_zoom_demotion(spark, d):
    r = view(spark, d, "v_rects")
    n = r.agg(F.count("*").alias("n"))  # one row, joined instead of a window over everything
    return r.crossJoin(F.broadcast(n)).select("id", F.col("w").alias("visible"), F.when(F.col("n") >= 128, 2).otherwise(1).alias("zoom"))


@query("SELECT page_id, coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def S22_page_scrape(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", S.page_title("html").alias("title"), F.array_join(S.page_links("html"), " ").alias("links"))


@query("""SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN type END, 'vanilla') AS map_name, coalesce(CASE WHEN id % 2 = 0 THEN '{root}/mods/{map_name}' END, '{root}/maps/') AS raw, 'utf8' AS encoding,
  CASE WHEN id % 2 = 0 THEN '/pz/mods/' || coalesce(CASE WHEN id % 3 > 0 THEN type END, 'vanilla') ELSE '/pz/maps/' END AS map_path FROM v_rects""")
def S20_map_defaults(spark, d):
    entries = view(spark, d, "v_rects").select("id", F.when(F.col("id") % 3 > 0, F.col("type")).alias("map_name"), F.when(F.col("id") % 2 == 0, "{root}/mods/{map_name}").alias("map_path"))
    full = R.with_defaults(entries, {"map_name": "vanilla", "map_path": "{root}/maps/", "encoding": "utf8", "root": "/pz"})
    return R.with_defaults(full.withColumn("raw", F.col("map_path")), {}, ("map_path",)).select("id", "map_name", "raw", "encoding", "map_path")


@query("""WITH l AS (SELECT id, 'maps/' || x || '_' || y || CASE id % 3 WHEN 0 THEN '.lotheader' WHEN 1 THEN '.bin' ELSE '.txt' END AS path, x, y FROM v_rects) SELECT id, path, CASE id % 3 WHEN 0 THEN 'map' ELSE 'save' END AS kind, x AS ux, y AS uy FROM l WHERE id % 3 < 2""")
def S19_classified_files(spark, d):
    ext = F.when(F.col("id") % 3 == 0, ".lotheader").when(F.col("id") % 3 == 1, ".bin").otherwise(".txt")
    listing = view(spark, d, "v_rects").select("id", F.concat(F.lit("maps/"), "x", F.lit("_"), "y", ext).alias("path"))
    return S.classified(listing, {"map": r"(\d+)_(\d+)\.lotheader$", "save": r"(\d+)_(\d+)\.bin$"})


@query("""SELECT type, 'type=' || type || '=x;w=' || max_w AS info FROM (SELECT type, arg_max(w, id) AS max_w FROM v_rects GROUP BY type)""")
def S21_key_values(spark, d):
    r = view(spark, d, "v_rects")
    lines = r.select("type", F.explode(F.array(F.struct((F.col("id") * 3).alias("ord"), F.concat(F.lit("type = "), "type", F.lit("=x")).alias("value")), F.struct((F.col("id") * 3 + 1).alias("ord"), F.concat(F.lit("w="), "w").alias("value")), F.struct((F.col("id") * 3 + 2).alias("ord"), F.lit("no pair").alias("value")))).alias("l")).select("type", "l.*")
    info = S.key_values(lines, ["type"])
    return info.select("type", F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("info"))


@query("SELECT pixel, zone FROM (SELECT pixel, zone, row_number() OVER (PARTITION BY pixel ORDER BY ord DESC) AS n FROM (SELECT id AS ord, x * 2 % 300 AS pixel, type AS zone FROM v_rects)) WHERE n = 1 AND pixel BETWEEN 0 AND 255")
def S15_pixel_zones(spark, d):
    return S.pixel_zones(view(spark, d, "v_rects").select(F.col("id").alias("ord"), (F.col("x") * 2 % 300).alias("pixel"), F.col("type").alias("zone")))


@query("""WITH t AS (SELECT conv_id AS key, lang, min(text) AS text FROM v_texts GROUP BY 1, 2) SELECT k.key, coalesce(a.text, b.text, CAST(k.key AS VARCHAR)) AS text FROM (SELECT DISTINCT conv_id * 2 // 3 AS key FROM v_texts) k LEFT JOIN t a ON a.key = k.key AND a.lang = 'system' LEFT JOIN t b ON b.key = k.key AND b.lang = 'assistant'""")
def X15_localised(spark, d):
    """Over whole texts."""
    t = view(spark, d, "v_texts")
    keys = t.select(F.expr("conv_id * 2 div 3").alias("key")).distinct()
    return R.localised(keys, t.withColumnRenamed("conv_id", "key"), "system", "assistant")


@query("""WITH b AS (SELECT layer, id, w FROM v_rects), s AS (SELECT id, w FROM b WHERE id % 4 <> 0), n AS (SELECT id, CASE WHEN id % 3 = 0 THEN w + 1 ELSE w END AS w FROM b WHERE id % 5 <> 0)
  SELECT coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'remove' WHEN s.w <> n.w THEN 'replace' ELSE 'keep' END AS action FROM s FULL JOIN n ON s.id = n.id""")
def X12_render_sync(spark, d):
    r = view(spark, d, "v_rects").select("id", "w")
    wanted = r.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.col("w") + 1).otherwise(F.col("w")).alias("w"))
    return I.sync(r.filter("id % 4 <> 0"), wanted)


@query("""WITH l AS (SELECT DISTINCT layer FROM v_points WHERE layer <> 2), i AS (SELECT layer, layer - row_number() OVER (ORDER BY layer) AS k FROM l) SELECT min(layer) AS low, max(layer) AS high FROM i WHERE k = (SELECT k FROM i WHERE layer = 0)""")
def X10_layer_range(spark, d):
    from ..operators.windows import runs

    layers = view(spark, d, "v_points").filter("layer <> 2").select(F.lit(0).alias("g"), "layer")
    return runs(layers, ["g"], "layer").filter("start <= 0 and start + length > 0").select(F.col("start").alias("low"), (F.col("start") + F.col("length") - 1).alias("high"))


@query("""WITH t AS (SELECT ['americanholly', 'americanlinden', 'canadianhemlock', 'carolinasilverbell', 'cockspurhawthorn', 'dogwood', 'easternredbud', 'redmaple', 'riverbirch', 'virginiapine', 'yellowwood'] AS n)
  SELECT 'vegetation_foliage_01_' || i AS name, 'f_bushes_1_' || (i % 8) || ',f_bushes_1_' || (i % 8 + 48) || ',f_bushes_1_' || (i + 80) AS textures FROM range(16) r(i)
  UNION ALL SELECT 'vegetation_groundcover_01_' || i, 'd_plants_1_' || (i % 8 + 8) || ',d_plants_1_' || ((i % 24) // 8 * 16 + 24 + i % 8) FROM range(48) r(i)
  UNION ALL SELECT 'vegetation_trees_01_' || i, 'e_' || n[1 + i % 11] || '_1_2' || CASE WHEN i % 11 IN (0, 2, 9) THEN '' ELSE ',e_' || n[1 + i % 11] || '_1_22' END FROM range(33) r(i), t
  UNION ALL SELECT 'jumbo_tree_01_0', 'e_americanlindenJUMBO_1_1,e_americanlindenJUMBO_1_11'""")
def P31_vegetation(spark, d):
    from ..functions.vegetation import vegetation

    v = vegetation(spark, season="autumn", flower=True, jumbo_size=5, jumbo_type=2)
    return v.select("name", F.array_join("textures", ",").alias("textures"))


@query("SELECT id, CAST(row_number() OVER (PARTITION BY type ORDER BY visible_zoom_level DESC, (SELECT CAST(list_sum(list_transform(range(0, 9), lambda i: ((m.x >> i) & 1) * (1 << (2 * i)) + ((m.y >> i) & 1) * (1 << (2 * i + 1)))) AS BIGINT)), id) AS BIGINT) AS task FROM v_marks m")
def T2_task_order(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("type").orderBy(F.desc("visible_zoom_level"), C.morton("x", "y"), "id")
    return view(spark, d, "v_marks").select("id", F.row_number().over(order).cast("bigint").alias("task"))


@query("SELECT id, row_number() OVER (ORDER BY visible_zoom_level DESC, (SELECT CAST(list_sum(list_transform(range(0, 9), lambda i: ((m.x >> i) & 1) * (1 << (2 * i)) + ((m.y >> i) & 1) * (1 << (2 * i + 1)))) AS BIGINT)), id) - 1 AS task FROM v_marks m")
def T2_tasks_in_one_order(spark, d):
    """The order of all tasks, over ranges of it."""
    from ..operators.scans import ranked

    keyed = view(spark, d, "v_marks").select("id", (-F.col("visible_zoom_level")).alias("zoom"), C.morton("x", "y").alias("z"))
    return ranked(keyed, "zoom", "z", "id", name="task").select("id", "task")


@query("SELECT type, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY w * h, id) AS n, count(*) OVER (PARTITION BY type) AS c FROM v_rects) WHERE n <= (c + 1) // 2")
def T4_lower_half(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("type")
    ranked = view(spark, d, "v_rects").select("type", "id", F.row_number().over(by.orderBy(F.col("w") * F.col("h"), "id")).alias("n"), F.count("*").over(by).alias("c"))
    return ranked.filter("n <= (c + 1) div 2").select("type", "id")


@query("SELECT gx, gy, (gx + gy) // 2 AS sx, (gy - gx) // 2 AS sy FROM (SELECT i - 20 AS gx FROM range(50) a(i)), (SELECT j - 7 AS gy FROM range(33) b(j)) WHERE (gx + gy) % 2 = 0")
def X6_visible_grid(spark, d):
    """Grid points of a screen that are squares: one parity."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(-20).cast("bigint"), F.lit(29).cast("bigint"))).alias("gx")).withColumn("gy", F.explode(F.sequence(F.lit(-7).cast("bigint"), F.lit(25).cast("bigint"))))
    sx, sy = C.from_grid("gx", "gy")
    return grid.select("gx", "gy", sx.alias("sx"), sy.alias("sy")).filter("sx is not null")


@query("SELECT id, name AS map, y || '=' || type || '=' AS q, CAST(x AS VARCHAR) AS x FROM v_rects")
def X16_query_string(spark, d):
    text = F.concat(F.lit("map="), "name", F.lit("&q="), "y", F.lit("="), "type", F.lit("=&x="), "x")
    pairs = F.map_from_entries(F.transform(F.split(text, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.substr(F.instr(p, "=") + 1, F.length(p)).alias("v"))))
    return view(spark, d, "v_rects").select("id", pairs.alias("m")).select("id", *(F.col("m")[k].alias(k) for k in ("map", "q", "x")))


@query("SELECT layer, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT x * 1000 + y) AS BIGINT) AS squares FROM v_points WHERE layer BETWEEN -2 AND 4 GROUP BY layer")
def X21_layers_without_padding(spark, d):
    return view(spark, d, "v_points").filter(F.col("layer").between(-2, 4)).groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct(F.col("x") * 1000 + F.col("y")).alias("squares"))


@query(f"SELECT {_D('x', 2)} AS tx, {_D('y', 2)} AS ty, bool_or(x % 2 = 0 AND y % 2 = 0) AS nw, CAST(count(*) AS BIGINT) AS present FROM (SELECT DISTINCT x, y FROM v_points WHERE layer = 0) GROUP BY 1, 2")
def J18_tile_children(spark, d):
    """Which children a tile has, by grouping on the shifted key: no join."""
    t = view(spark, d, "v_points").filter("layer = 0").select("x", "y").distinct()
    return t.groupBy(C.parent("x").alias("tx"), C.parent("y").alias("ty")).agg(F.bool_or((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).alias("nw"), F.count("*").alias("present"))


@query("""SELECT '[' || string_agg('{"type":"' || type || '","n":' || n || '}', ',' ORDER BY type) || ']' AS json FROM (SELECT type, count(*) AS n FROM v_rects GROUP BY type)""")
def K14_map_listing(spark, d):
    return R.listing(view(spark, d, "v_rects").groupBy("type").agg(F.count("*").alias("n")), ["type", "n"])


@query("""SELECT '{"minlayer":' || min(layer) || ',"maxlayer":' || (max(layer) + 1) || ',"levels":' || max(w) || ',"tiles":' || count(*) || ',"sqr":1,"cell_size":256}' AS json FROM v_rects""")
def K6_map_info(spark, d):
    from ..operators.raster import map_info

    return map_info(view(spark, d, "v_rects").select("layer", F.col("w").alias("level")), sqr=1, cell_size=256)


@query("SELECT CAST(CASE WHEN greatest(abs(x1 - x0), abs(y1 - y0)) * 2 > 512 OR id % 16 > 12 THEN 0 WHEN greatest(abs(x1 - x0), abs(y1 - y0)) * 2 > 256 OR id % 16 > 8 THEN 1 ELSE 2 END AS BIGINT) AS class, CAST(count(*) AS BIGINT) AS n FROM v_segments GROUP BY 1")
def A15_street_counts(spark, d):
    from ..functions.values import street_class

    points = F.array(*(F.struct((F.col(f"x{i}") * 2).alias("x"), (F.col(f"y{i}") * 2).alias("y")) for i in (0, 1)))
    return view(spark, d, "v_segments").groupBy(street_class(points, F.col("id") % 16).cast("bigint").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT id, x, y FROM v_rects WHERE NOT (x < 128 AND y < 128)")
def F11_stash_coordinates(spark, d):
    return view(spark, d, "v_rects").filter(~((F.col("x") < 128) & (F.col("y") < 128))).select("id", "x", "y")


@query("SELECT DISTINCT a.layer, a.x, a.y FROM v_rects a WHERE EXISTS (SELECT 1 FROM v_points p WHERE p.x = a.x AND p.y = a.y AND p.v > 10)")
def F4_non_empty_sources(spark, d):
    full = view(spark, d, "v_points").filter("v > 10").select("x", "y")
    return view(spark, d, "v_rects").select("layer", "x", "y").distinct().join(full, ["x", "y"], "left_semi")


@query("SELECT DISTINCT x AS tx, y AS ty FROM v_points p WHERE layer = 0 AND NOT EXISTS (SELECT 1 FROM v_points q WHERE q.layer = 3 AND q.x = p.x AND q.y = p.y)")
def X23_stale_removal(spark, d):
    p = view(spark, d, "v_points")
    return p.filter("layer = 0").select("x", "y").distinct().join(p.filter("layer = 3").select("x", "y"), ["x", "y"], "left_anti").toDF("tx", "ty")


@query("SELECT a.id, round((b.x - a.x) * 4.0 / a.w, 4) AS dx, round((b.y - a.y) * 4.0 / a.w, 4) AS dy, round(b.w / CAST(a.w AS DOUBLE), 4) AS scale FROM v_rects a JOIN v_rects b ON b.id = 0")
def X11_relative_placement(spark, d):
    r = view(spark, d, "v_rects")
    base = r.filter("id = 0").select(F.col("x").alias("bx"), F.col("y").alias("b_y"), F.col("w").alias("bw"))  # one row
    placed = r.crossJoin(F.broadcast(base))
    return placed.select("id", F.round((F.col("bx") - F.col("x")) * 4.0 / F.col("w"), 4).alias("dx"), F.round((F.col("b_y") - F.col("y")) * 4.0 / F.col("w"), 4).alias("dy"), F.round(F.col("bw") / F.col("w"), 4).alias("scale"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keeper FROM documents")
def D10_keepers(spark, d):
    return R.first_copies(spark.read.parquet(f"{d}/documents.parquet"), "text", "doc_id")


@query("""WITH s AS (SELECT layer, id, type, CASE WHEN id % 3 > 0 THEN name ELSE '' END AS name, x + i AS x, y + j AS y, (CASE WHEN j = 0 THEN 'n' ELSE '' END) || (CASE WHEN i = w - 1 THEN 'e' ELSE '' END) || (CASE WHEN j = h - 1 THEN 's' ELSE '' END) || (CASE WHEN i = 0 THEN 'w' ELSE '' END) AS sides, i = 0 AND j = 0 AS anchor FROM v_rects, range(12) a(i), range(9) b(j) WHERE i < w AND j < h)
  SELECT layer, x, y, string_agg(type || ':' || sides, ',' ORDER BY id) AS borders, coalesce(string_agg(type || ':' || name, ',' ORDER BY id) FILTER (WHERE anchor AND name <> ''), '') AS labels FROM s WHERE sides <> '' GROUP BY layer, x, y""")
def X1_border_labels(spark, d):
    from ..functions.geometry import squares_of

    parts = view(spark, d, "v_rects")
    tasks = tasks_for(parts)
    r = parts.withColumn("name", F.when(F.col("id") % 3 > 0, F.col("name")).otherwise("")).repartition(tasks, "layer", "id", "type", "name")
    squares = r.select("layer", "id", "type", "name", F.explode(squares_of("x", "y", "w", "h")).alias("p")).select("layer", "id", "type", "name", "p.x", "p.y")
    text = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["type"], e["value"])), ",").alias(c)
    return R.border_labels(squares, tasks).select("layer", "x", "y", text("borders"), text("labels"))


@query("""WITH r AS (SELECT id, x, y, w, h, ['none', 'centroid', 'top', 'abs(' || x || ',7)', 'middle'][1 + id % 5] AS how FROM v_rects)
  SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN round(((x + w / 2.0) * w * h + (x - 3 + 0.5) * 2) / (w * h + 2), 6) WHEN 2 THEN x - 3 WHEN 3 THEN x ELSE (x - 3 + x + w) / 2.0 END AS ax,
  CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN round(((y + h / 2.0) * w * h + (y + 5 + 1.0) * 2) / (w * h + 2), 6) WHEN 2 THEN y + 5 WHEN 3 THEN 7 ELSE (y + greatest(y + h, y + 7)) / 2.0 END AS ay FROM r""")
def X13_label_position(spark, d):
    """Areas of two rectangles each, under all text positions."""
    from ..functions.values import label_position

    c = F.col("id") % 5
    how = F.when(c == 0, "none").when(c == 1, "centroid").when(c == 2, "top").when(c == 3, F.format_string("abs(%d,7)", "x")).otherwise("middle")
    rects = F.array(F.struct("x", "y", "w", "h"), F.struct((F.col("x") - 3).alias("x"), (F.col("y") + 5).alias("y"), F.lit(1).cast("bigint").alias("w"), F.lit(2).cast("bigint").alias("h")))
    return view(spark, d, "v_rects").select("id", label_position(how, rects).alias("p")).select("id", F.round("p.x", 6).alias("ax"), F.round("p.y", 6).alias("ay"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS same, CASE WHEN event_id % 3 = 0 THEN NULL ELSE true END AS valid FROM events""")
def X17_json_values(spark, d):
    """A path of JSON, equality whatever the order of keys, and null for texts that aren't JSON."""
    from ..functions.values import same_json

    k = F.get_json_object("props", "$.k")
    one, two = F.concat(F.lit('{"a": [1, 2], "k": '), k, F.lit("}")), F.concat(F.lit('{"k":'), (k.cast("bigint") - k.cast("bigint") % 2).cast("string"), F.lit(',"a":[1,2]}'))
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", k.cast("bigint").alias("k"), same_json(one, two).alias("same"), same_json(broken, F.col("props")).alias("valid"))


@query("SELECT type AS mode, CAST(x AS VARCHAR) AS save, max(150 + id % 100) AS version FROM v_rects GROUP BY 1, 2 HAVING max(150 + id % 100) <= 195")
def X20_matching_saves(spark, d):
    chunks = view(spark, d, "v_rects").select(F.col("type").alias("mode"), F.col("x").cast("string").alias("save"), (150 + F.col("id") % 100).alias("version"))
    return R.matching_saves(chunks, "B41")


@query("SELECT id, 'layer' || (layer - 1) || '_files/' || w || '/' || x || '_' || y || '.' || CASE WHEN id % 2 = 0 THEN 'png' ELSE 'empty' END AS path, CASE WHEN id % 3 > 0 THEN layer - 1 END AS layer, CASE WHEN id % 3 > 0 THEN x * 1000 + y END AS place, CASE WHEN id % 3 > 0 THEN CASE WHEN id % 2 = 0 THEN 'png' ELSE 'empty' END END AS ext FROM v_rects")
def X22_tile_paths(spark, d):
    """Paths of tiles, and tiles of paths; a third of the paths read back is of no tile."""
    path = C.tile_path(F.col("layer") - 1, "w", "x", "y", F.when(F.col("id") % 2 == 0, "png").otherwise("empty"))
    t = view(spark, d, "v_rects").select("id", path.alias("path"))
    back = C.tile_of_path(F.when(F.col("id") % 3 > 0, F.concat(F.lit("/out/"), "path")).otherwise(F.regexp_replace("path", "_files", "")))
    return t.select("id", "path", back.alias("t")).select("id", "path", "t.layer", (F.col("t.tx") * 1000 + F.col("t.ty")).alias("place"), "t.ext")


@query("SELECT id, CASE WHEN w <> 3 THEN 100 // (w - 3) - CASE WHEN w < 3 AND 100 % (3 - w) > 0 THEN 1 ELSE 0 END END AS result, CASE WHEN w = 3 THEN 'ZeroDivisionError' END AS error FROM v_rects")
def X28_results_or_errors(spark, d):
    """A function of each row that fails for some; failures are values."""
    return R.attempted(view(spark, d, "v_rects").select("id", "w"), "w", lambda w: 100 // (w - 3), "bigint").select("id", "result", F.substring_index("error", ":", 1).alias("error"))


@query(f"""SELECT DISTINCT bx, b_y, {_D('bx', 32)} AS cx, {_D('b_y', 32)} AS cy FROM v_blocks WHERE bx BETWEEN -3 AND 37 AND b_y BETWEEN -13 AND 25""")
def X36_boxed_blocks(spark, d):
    blocks = view(spark, d, "v_blocks").select("bx", F.col("b_y").alias("by")).distinct()
    return R.boxed_blocks(blocks, 300, -100, -20, 207).withColumnRenamed("by", "b_y")


@query("""WITH p AS (SELECT DISTINCT CASE pack % 5 WHEN 0 THEN 'Tiles1x.' || pack || '.pack' WHEN 1 THEN 'temp' || pack || '.pack' WHEN 2 THEN pack || '.txt' ELSE 'Tiles' || pack || '.pack' END AS name FROM v_packs) SELECT name, name LIKE '%.pack' AND name NOT LIKE '%1x%' AND name NOT LIKE '%temp%' AS plain, name LIKE 'Tiles1%' OR name LIKE 'temp2%' AS listed FROM p""")
def F10_pack_names(spark, d):
    from ..functions.values import pack_chosen

    c = F.col("pack")
    name = F.when(c % 5 == 0, F.format_string("Tiles1x.%d.pack", "pack")).when(c % 5 == 1, F.format_string("temp%d.pack", "pack")).when(c % 5 == 2, F.format_string("%d.txt", "pack")).otherwise(F.format_string("Tiles%d.pack", "pack"))
    return view(spark, d, "v_packs").select(name.alias("name")).distinct().select("name", pack_chosen("name").alias("plain"), pack_chosen("name", ("Tiles1", "temp2")).alias("listed"))
