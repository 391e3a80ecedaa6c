"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tool_calls

    calls, results = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    rows = ", ".join(f"('{n}', '{p}', '{t}', {str(r).lower()})" for n, p, t, r in tool_calls.TURN_SCHEMAS)
    linked = tool_calls.link(calls, results, spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, param, type, required)"))
    return linked.withColumn("problems", F.array_join("problems", "; "))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import byte_bpe

    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    own = (op1_tool_calls, op2_language_id, op3_exact_topk, op4_sharding, op5_quality, op6_decontamination, op7_token_counts, op8_substring_dedup, op9_byte_bpe, op10_simhash, op11_collocations, op12_suffix_dedup, op13_filter_audit)
    return {f.__name__: f for f in own}


ORACLE = {
    "op1_tool_calls": """
WITH RECURSIVE u AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, text FROM conversations WHERE role = 'user'),
deps AS (SELECT a.conv_id, a.turn, b.turn AS need FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn // 2 AND a.turn > 0),
lv(conv_id, turn, level) AS (SELECT conv_id, turn, 0 FROM deps WHERE need IS NULL UNION ALL SELECT d.conv_id, d.turn, lv.level + 1 FROM deps d JOIN lv ON d.conv_id = lv.conv_id AND d.need = lv.turn),
c AS (SELECT u.conv_id, 'call-' || u.conv_id || '-' || u.turn AS call_id, CASE WHEN length(text) >= 200 THEN 'read' ELSE 'ask' END AS name, level,
  row_number() OVER (PARTITION BY u.conv_id ORDER BY level, u.turn) - 1 AS position, u.turn, text,
  '{' || CASE WHEN text IS NULL THEN '' ELSE '"n_words":' || len(regexp_split_to_array(trim(text), '\\s+')) || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"turn":' || u.turn || '}' AS arguments
  FROM u JOIN lv ON u.conv_id = lv.conv_id AND u.turn = lv.turn),
r AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, name,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status, level, position,
  CASE WHEN c.call_id IS NULL THEN NULL WHEN c.text IS NULL THEN 'missing text' ELSE '' END AS problems,
  CAST(c.call_id IS NOT NULL AS BIGINT) AS n_calls, CAST(r.call_id IS NOT NULL AS BIGINT) AS n_results,
  '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS canonical
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id""",
    "op3_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN firsts USING (h) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS k FROM gone GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN k IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(ps, p)) END, ' ')) AS kept_sha256
FROM n LEFT JOIN lost USING (doc_id)""",
    "op11_collocations": """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
k AS (SELECT unnest(range(1, 6)) AS k),
g AS (SELECT lang, k, w[i : i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM p, k WHERE len(w) >= k)),
f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY lang, k, p HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, p, k, f AS a, n, unnest(range(1, k)) AS cut FROM f JOIN n USING (lang) WHERE k > 1),
s AS (SELECT c.lang, c.p, c.k, a, n, cut, x.f AS l, y.f AS r, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1 : c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
i AS (SELECT lang, p[j : j + m - 1] AS p, max(f) AS longer FROM (SELECT lang, p, f, m, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY 1, 2),
o AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE longer IS NULL OR longer < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY rank <= 2000""",
    "op12_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, sha256(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM n WHERE n >= 100)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM r)),
x AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
y AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM x),
z AS (SELECT doc_id, h, n, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(h, 2 * max(b) + 1) AS kept
  FROM y JOIN n USING (doc_id) GROUP BY doc_id, h, n)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, n.h))) AS kept_sha256
FROM n LEFT JOIN z USING (doc_id)""",
    "op13_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
  + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS failed FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, failed),
f(letter, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || g.letter || h.letter || i.letter AS filter_order, [a.own, b.own, g.own, h.own, i.own] AS owns
  FROM f a, f b, f g, f h, f i WHERE (a.own | b.own | g.own | h.own | i.own) = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, owns[step] AS own, CAST(coalesce(list_sum(owns[1 : step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
  CAST(coalesce(sum(n) FILTER ((failed & (before | own)) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER ((failed & before) = 0 AND (failed & own) <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER ((failed & before) <> 0 AND (failed & own) <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER ((failed & before) = 0 AND (failed & own) <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER ((failed & before) = 0 AND (failed & own) <> 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
