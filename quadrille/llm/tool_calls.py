"""Operator 1: tool-call linking, in DataFrame operations only.

Calls and results are hash-joined by identifier, calls are ordered topologically by the calls they depend on, arguments
are validated against schemas, and each linked call is serialised as canonical JSON (keys sorted at every depth, as the
variant encoding keeps them). Calls of one conversation never meet in one task: levels come from rounds of joins on
(conversation, call), positions from counts of small ranges of sequence numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Sequence numbers that are ranked together within a level.
RANGE = 256


def _first(rows: DataFrame, *values: str) -> DataFrame:
    """One row for each (conv_id, call_id): the first by seq, and how many there were."""
    return rows.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", *values)).alias("v"), F.count("*").alias("n")).select("conv_id", "call_id", "v.*", "n")


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need none of the others, else 1 + the most of those needed.

    calls has (conv_id, call_id), needs (conv_id, call_id, need). Needs that no call has are ignored; calls that lie on a
    cycle, or need one that does, get no row. As many rounds as the longest chain; each keeps only needs still open.
    """
    key = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    open_needs = cut(needs.select(*key, "need").distinct().join(known, ["conv_id", "need"], "left_semi"))
    ready = cut(calls.select(*key).join(open_needs, key, "left_anti").withColumn("level", F.lit(0)))
    done, level = ready, 0
    while not open_needs.isEmpty() and not ready.isEmpty():
        level += 1
        before = open_needs.select(*key).distinct()
        open_needs = cut(open_needs.join(ready.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"))
        ready = cut(before.join(open_needs, key, "left_anti").withColumn("level", F.lit(level)))
        done = done.union(ready)
    return done


def positions(placed: DataFrame) -> DataFrame:
    """Adds position: the rank of a call in its conversation by (level, seq, call_id), from 0; a null seq comes first."""
    group = ["conv_id", "level", "range"]
    rows = placed.withColumn("range", F.coalesce(F.floor(F.col("seq") / RANGE), F.lit(-(1 << 62))))
    within = F.row_number().over(Window.partitionBy(*group).orderBy("seq", "call_id")) - 1
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("level", "range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.coalesce(before, F.lit(0)).alias("start"))
    return rows.withColumn("within", within).join(starts, group).withColumn("position", F.col("start") + F.col("within")).drop("range", "within", "start")


def _problems(known, params):
    """Sorted texts of what is wrong with a map of argument values against an array of (param, type, required)."""
    typed = F.expr(
        """transform(map_entries(args), e -> struct(e.key AS param, CASE
             WHEN schema_of_variant(e.value) RLIKE '^(BIGINT|DECIMAL[(][0-9]+,0[)])$' THEN 'integer'
             WHEN schema_of_variant(e.value) RLIKE '^(DOUBLE|FLOAT|DECIMAL.*)$' THEN 'number'
             WHEN schema_of_variant(e.value) RLIKE '^OBJECT' THEN 'object'
             WHEN schema_of_variant(e.value) RLIKE '^ARRAY' THEN 'array'
             WHEN schema_of_variant(e.value) = 'VOID' THEN 'null'
             ELSE lower(schema_of_variant(e.value)) END AS type))"""
    )
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(F.map_keys(known), p["param"])), lambda p: F.concat(F.lit("missing "), p["param"]))

    def wrong(e):
        spec = F.filter(params, lambda p: p["param"] == e["param"])
        fits = (spec[0]["type"] == e["type"]) | ((spec[0]["type"] == "number") & (e["type"] == "integer"))
        return F.when(F.size(spec) == 0, F.concat(F.lit("unknown "), e["param"])).when(~fits, F.concat(F.lit("type "), e["param"]))

    return F.array_sort(F.concat(missing, F.filter(F.transform(typed, wrong), lambda x: x.isNotNull())))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each identifier of a call or result.

    calls: conv_id, call_id, seq, name, arguments (JSON text), depends_on (array of call ids). results: conv_id,
    call_id, seq, content. schemas: name, param, type (JSON type names), required.

    Returns conv_id, call_id, name, status (`answered`, `unanswered`, `early` if the result comes before the call,
    `orphan` for a result without call), level and position of the topological order (null on or behind a cycle, and
    for orphans), problems (sorted: `invalid json`, `no schema`, `missing p`, `unknown p`, `type p`; null for orphans),
    n_calls and n_results (repeated identifiers: the first by seq counts, ties to the least name, arguments or content)
    and canonical, JSON of arguments, call_id, name and result with sorted keys (arguments null if they are no JSON
    object, result null without one). A null seq comes before all others. Rows with a null identifier can't be linked and give no rows; empty tables give
    what the other table makes of them. Other columns are not read.
    Very long texts are taken whole, as values of one row.
    """
    key = ["conv_id", "call_id"]
    own = cut(_first(calls.select(*key, "seq", "name", "arguments", "depends_on"), "name", "arguments", "depends_on").withColumnRenamed("n", "n_calls"))
    answers = _first(results.select(*key, "seq", "content"), "content").toDF(*key, "seq_r", "content", "n_results")
    ordered = positions(levels(own, own.select(*key, F.explode("depends_on").alias("need"))).join(own.select(*key, "seq"), key)).select(*key, "level", "position")

    params = schemas.filter("name is not null and param is not null").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("param", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("params"))
    # one row for each function name: the size of a tool catalogue, checked by Spark before it broadcasts
    known = own.join(params, "name", "left").withColumn("json", F.expr("try_parse_json(arguments)"))
    known = known.withColumn("args", F.when(F.expr("schema_of_variant(json) LIKE 'OBJECT%'"), F.from_json("arguments", "map<string,variant>")))
    problems = F.when(F.col("args").isNull(), F.array(F.lit("invalid json"))).when(F.col("params").isNull(), F.array(F.lit("no schema"))).otherwise(_problems(F.col("args"), F.col("params")))
    checked = known.select(*key, "seq", "name", "n_calls", problems.alias("problems"), F.when(F.col("args").isNotNull(), F.to_json("json")).alias("arguments"))

    joined = checked.join(ordered, key, "left").join(answers.hint("shuffle_hash"), key, "full_outer")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").when(F.col("seq_r") < F.col("seq"), "early").otherwise("answered")
    quoted = lambda c: F.coalesce(F.expr(f"to_json(to_variant_object(struct({c} AS x)))").substr(F.lit(6), F.length(F.expr(f"to_json(to_variant_object(struct({c} AS x)))")) - 6), F.lit("null"))
    parts = [F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"call_id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("content"), F.lit("}")]
    return joined.select(*key, "name", status.alias("status"), "level", "position", "problems", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.concat(*parts).alias("canonical"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that chat turns (conv_id, turn, role, text) stand for.

    A user's turn is a call, `ask` or (from 200 characters) `read`, whose arguments hold its text, turn and number of
    words; the assistant's turn after it is its result. A call depends on the call at half its turn, if there is one.
    """
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn").cast("bigint")
    base = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"), "role", F.col("text").cast("string").alias("text"))
    words = F.size(F.split(F.trim("text"), r"\s+"))
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text"), F.when(F.col("text").isNotNull(), words).alias("n_words")))
    calls = base.filter("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), F.when(F.length("text") >= 200, "read").otherwise("ask").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") > 0, F.array(name(F.expr("turn div 2")))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = base.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


#: Schemas of the two functions that from_turns() names: (name, param, type, required).
TURN_SCHEMAS = [("ask", "text", "string", True), ("ask", "turn", "integer", True), ("ask", "n_words", "integer", False), ("read", "text", "string", True), ("read", "turn", "integer", True), ("read", "n_words", "integer", False)]
