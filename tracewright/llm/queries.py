"""The registered ``opN_<name>`` queries, each its operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, tokens, toolcalls, toxicity, warc
from .common import table

TOKENIZER = "piece_bpe_32k.model"


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as a call or result, linked; JSON tool calls in texts would be events as well."""
    messages = table(spark, sf_dir, "conversations")
    events = toolcalls.turns_as_events(messages).unionByName(toolcalls.parse_messages(messages))
    linked = toolcalls.link(events, toolcalls.TURN_SCHEMAS)
    return linked.select("conv_id", "turn", "kind", "call_id", "status", "ready", "depth", "n_results", "canonical", F.col("errors").isNull().alias("valid"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(mixing.mix(table(spark, sf_dir, "documents")))
    rounded = mixed.withColumns({name: F.round(name, 6) for name in ("position", "position_2", "position_3")})
    return rounded.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position", "position_2", "position_3")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_matches")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tool_calls, op2_warc, op3_token_counts, op4_mix_sources, op5_toxicity, op6_line_dedup, op7_decontaminate, op8_exact_dedup, op9_near_dedup, op10_quality)}


_CALLS = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role <> 'assistant', true) AS is_call, coalesce(text, '') AS text FROM conversations),
c AS (SELECT *, 'call_' || conv_id || '_' || turn AS call_id, CASE WHEN turn > 0 THEN 'call_' || conv_id || '_' || greatest(turn - 2, 0) END AS after FROM e WHERE is_call),
chain AS (
  SELECT c.r, c.call_id, c.turn AS ready, CAST(0 AS BIGINT) AS depth FROM c LEFT JOIN c p ON p.call_id = c.after WHERE p.r IS NULL
  UNION ALL SELECT c.r, c.call_id, greatest(c.turn, chain.ready), depth + 1 FROM chain JOIN c ON c.after = chain.call_id AND c.call_id <> chain.call_id),
results AS (SELECT r, conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id FROM e WHERE NOT is_call),
answers AS (SELECT call_id, count(*) AS n FROM results GROUP BY call_id)
SELECT conv_id, turn, 'call' AS kind, c.call_id, CASE WHEN n IS NULL THEN 'unanswered' ELSE 'answered' END AS status, ready, depth, coalesce(n, 0) AS n_results,
       CAST(json_object('conversation', conv_id, 'text', text, 'turn', turn) AS VARCHAR) AS canonical, text <> '' AS valid
FROM c JOIN chain USING (r) LEFT JOIN answers ON answers.call_id = c.call_id
UNION ALL
SELECT conv_id, turn, 'result', results.call_id, CASE WHEN chain.r IS NULL THEN 'orphan' ELSE 'linked' END, greatest(turn, ready), depth, NULL, NULL, true
FROM results LEFT JOIN chain ON chain.call_id = results.call_id
"""

_WARC = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h, url FROM pages),
d AS (SELECT r, page_id, url, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url, r) AS n, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN first END AS refers_to FROM k
"""

_POSITION = """CASE WHEN copies > {k} THEN round(CASE class
    WHEN 0 THEN CASE WHEN demand_{k} <= 1.25 THEN (2 * demand_{k} / (1.5 + sqrt(greatest(2.25 - demand_{k}, 0)))) / 2
                     ELSE (1 + 2 * (demand_{k} - 1.25) / (1.0 + sqrt(greatest(1.0 - (demand_{k} - 1.25), 0)))) / 2 END
    WHEN 1 THEN demand_{k} / 2
    ELSE CASE WHEN demand_{k} <= 0.75 THEN (2 * demand_{k} / (0.5 + sqrt(0.25 + demand_{k}))) / 2
              ELSE (1 + 2 * (demand_{k} - 0.75) / (1.0 + sqrt(1.0 + (demand_{k} - 0.75)))) / 2 END END, 6) END AS {name}"""

_MIX = f"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS hash FROM documents),
by_source AS (SELECT k, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k, source),
ranked AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) AS class FROM by_source),
reach AS (SELECT *, class + 1 AS weight, CAST(3 * source_size AS DOUBLE) / (class + 1) AS reach FROM ranked),
levels AS (SELECT *, CAST(sum(source_size) OVER () - 3 * (sum(source_size) OVER up - source_size) AS DOUBLE)
             / CAST(sum(weight) OVER down AS DOUBLE) AS level FROM reach
           WINDOW up AS (ORDER BY reach, k ROWS UNBOUNDED PRECEDING), down AS (ORDER BY reach, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (SELECT k, source_size, class, least(weight * (max(CASE WHEN level <= reach THEN level END) OVER ()), CAST(3 * source_size AS DOUBLE)) AS target FROM levels),
laid AS (SELECT doc_id, size, source_size, class, target,
           CAST(sum(size) OVER (PARTITION BY k ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS DOUBLE) + size / 2.0::DOUBLE AS middle
         FROM sized JOIN targets USING (k)),
copied AS (SELECT *, CASE WHEN size > 0 AND source_size > 0 THEN CAST(least(greatest(floor((target - middle) / source_size) + 1, 0), 3) AS BIGINT) ELSE 0 END AS copies FROM laid),
shared AS (SELECT *, {", ".join(f"least(({k} * source_size + middle) / nullif(target, 0), 1.0::DOUBLE) * 2 AS demand_{k}" for k in range(3))} FROM copied)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  {", ".join(_POSITION.format(k=k, name=name) for k, name in enumerate(("position", "position_2", "position_3")))}
FROM shared
"""

_DECONTAMINATE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
spans AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM spans JOIN windows USING (n, span)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

_EXACT = """
WITH n AS (SELECT row_number() OVER () AS r, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r) = 1 AS kept, text_sha256 FROM n
"""


_NEAR = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
named AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.other GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN named USING (r) LEFT JOIN n USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_calls": _CALLS, "op2_warc": _WARC, "op4_mix_sources": _MIX, "op7_decontaminate": _DECONTAMINATE, "op8_exact_dedup": _EXACT, "op9_near_dedup": _NEAR}
