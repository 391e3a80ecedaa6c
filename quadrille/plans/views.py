"""Projections of the tables into coordinates, marks, stacks, sources and dictionaries.

Each view is a list of expressions that Spark and DuckDB both read, so that a query and its SQL start from one text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str], str]] = {
    "v_points": ("lineitem", ["CAST(l_partkey % 1024 - 512 AS BIGINT) AS x", "CAST(l_orderkey % 1024 - 512 AS BIGINT) AS y", "CAST(l_linenumber - 3 AS BIGINT) AS layer", "CAST(l_quantity AS BIGINT) AS v"], ""),
    "v_rects": ("part", ["p_partkey AS id", "(p_partkey * 37) % 211 AS x", "(p_partkey * 91) % 193 AS y", "CAST(1 + p_size % 12 AS BIGINT) AS w", "1 + p_partkey % 9 AS h", "p_partkey % 3 AS layer", "p_brand AS type", "p_name AS name"], ""),
    "v_world": ("part", ["p_partkey AS id", "CASE WHEN p_partkey % 1000 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN p_partkey * 37 % 23 ELSE p_partkey * 37 % 211 END + CAST(floor(p_partkey / 2048.0) AS BIGINT) * 211 AS x", "CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 91 % 19 ELSE p_partkey * 91 % 193 END AS y", "CASE WHEN p_partkey % 1000 = 0 THEN 400 ELSE CAST(1 + p_size % 12 AS BIGINT) END AS w", "CASE WHEN p_partkey % 1000 = 0 THEN 300 ELSE 1 + p_partkey % 9 END AS h", "p_partkey % 3 AS layer"], ""),
    "v_stacks": ("lineitem", ["l_orderkey AS square", "CAST(l_linenumber AS BIGINT) AS line", "l_partkey AS tile"], ""),
    "v_textures": ("part", ["p_partkey AS tile", "p_partkey * 7 % 1000 AS sum_r", "p_partkey * 13 % 1000 AS sum_g", "p_partkey * 29 % 1000 AS sum_b", "CAST(1 + p_size % 5 AS BIGINT) AS n"], "p_partkey % 11 <> 0"),
    "v_packs": ("lineitem", ["l_suppkey AS pack", "l_partkey AS tile"], ""),
    "v_deps": ("part", ["p_partkey AS node", "CAST(floor(p_partkey / 2.0) AS BIGINT) AS needs"], "p_partkey > 0"),
    "v_old": ("events", ["user_id % 16 AS ux", "user_id % 7 AS uy", "event_id AS mtime", "md5(props) AS sig"], "event_id % 10 < 7"),
    "v_new": ("events", ["user_id % 16 AS ux", "user_id % 7 AS uy", "event_id AS mtime", "md5(props) AS sig"], "event_id % 10 >= 3 AND user_id % 7 <> 2"),
    "v_blocks": ("orders", ["o_orderkey % 97 - 20 AS bx", "o_orderkey % 89 - 30 AS b_y", "o_custkey % 5 > 0 AS saved", "o_custkey % 3 = 0 AS selected"], ""),
    "v_marks": ("part", ["p_partkey AS id", "p_brand AS type", "p_name AS name", "(p_partkey * 37) % 211 AS x", "(p_partkey * 91) % 193 AS y", "CAST(1 + p_size % 12 AS BIGINT) AS w", "1 + p_partkey % 9 AS h", "CAST(p_partkey % 3 AS INT) AS layer", "CAST(p_size % 4 AS INT) AS visible_zoom_level"], ""),
    "v_heat": ("part", ["p_partkey AS id", "p_partkey * 7 % 256 AS z"], ""),
    "v_texts": ("conversations", ["conv_id", "turn", "role AS lang", "text"], ""),
    "v_segments": ("orders", ["o_orderkey AS id", "CAST(o_orderkey * 37 % 400 - 200 AS DOUBLE) AS x0", "CAST(o_custkey * 91 % 300 - 150 AS DOUBLE) AS y0", "CAST(o_orderkey * 53 % 400 - 200 AS DOUBLE) AS x1", "CAST(o_custkey * 17 % 300 - 150 AS DOUBLE) AS y1"], ""),
    "v_intervals": ("orders", ["o_custkey % 50 AS grp", "o_orderkey AS id", "o_orderkey * 37 % 1000 AS s", "o_orderkey * 37 % 1000 + o_custkey % 9 AS e"], ""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns, where = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return (df.filter(where) if where else df).selectExpr(*columns)


def duck(text: str) -> str:
    """SQL with the views that it names as common table expressions in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    parts = [f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {VIEWS[v][0]}{' WHERE ' + VIEWS[v][2] if VIEWS[v][2] else ''})" for v in used]
    rest = text.strip()
    if rest[:5].upper() == "WITH ":
        recursive = rest[5:15].upper() == "RECURSIVE "
        rest = rest[15:] if recursive else rest[5:]
        return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([*parts, rest])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + rest
