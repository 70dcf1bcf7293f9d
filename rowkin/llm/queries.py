"""The corpus operators as queries over the tables of a folder; op<N>_<name> applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowkin.llm import ann_blocks, conversations, html_extract, lang_id, merkle, mixing, ngram_join, packing, passages, token_counts, token_output, topk_impact, toxicity
from rowkin.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_blocks.nearest(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_impact.top_k(table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added_tokens=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"), added_tokens=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_proofs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ngram_jaccard_join,
        op2_nearest_neighbours,
        op3_substring_dedup,
        op4_exact_topk,
        op5_source_mixing,
        op6_html_extraction,
        op7_best_fit_packing,
        op8_toxicity,
        op9_token_output,
        op10_language_id,
        op11_conversation_repair,
        op12_token_counts,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses on whole tables."""
    return {"op2_nearest_neighbours": OP2_SQL, "op4_exact_topk": OP4_SQL, "op11_conversation_repair": OP11_SQL, "op13_merkle_manifest": OP13_SQL}


OP2_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND c.id <> q.id AND len(q.x) = len(c.x)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP4_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id AND len(q.x) = len(c.x)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 of an ASCII text {0}, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT))"""

OP11_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, {CRC_SQL.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations
), dam AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt,
    unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE f <> 0
), seq AS (
  SELECT *, substr(role, 1, 1) AS ini, rtrim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(txt), copy) AS k,
    row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST, copy) AS seen
  FROM dam
), turns AS (
  SELECT *, CASE WHEN rest = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM seq
), step(frm, ini, mid) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ins(mid, nxt, cost, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')
), edit AS (
  SELECT 'D' AS op, NULL AS ini, mid AS frm, mid, 4 AS cost FROM ins WHERE cost = 0
  UNION ALL SELECT 'K', ini, frm, mid, 0 FROM step
  UNION ALL SELECT 'R', NULL, frm, mid, 3 FROM step WHERE ini <> 's'
), move AS (
  SELECT op, ini, frm, nxt, edit.cost + ins.cost AS cost, op || letters AS letters FROM edit JOIN ins USING (mid)
), best AS (
  SELECT conv_id, 0::BIGINT AS k, nxt AS state, printf('%09d', cost) || letters AS way FROM (SELECT DISTINCT conv_id FROM conversations) JOIN ins ON mid = 0
  UNION ALL
  SELECT b.conv_id, b.k + 1, nxt, min(printf('%09d', substr(way, 1, 9)::BIGINT + cost + CASE WHEN op <> 'D' AND fault = 't' THEN 3 ELSE 0 END) || substr(way, 10) || letters)
  FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.k = b.k + 1
  JOIN move m ON m.frm = b.state AND (op = 'D' OR (fault IN ('k', 't') AND (op = 'R' OR m.ini = t.ini)))
  GROUP BY b.conv_id, b.k, nxt
), ways AS (
  SELECT conv_id, min(way) AS way FROM best WHERE state IN (0, 3)
    AND k = (SELECT count(*) FROM turns t WHERE t.conv_id IS NOT DISTINCT FROM best.conv_id) GROUP BY conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(substr(way, 10), '')) AS c, unnest(range(1, length(way) - 8)) AS i FROM ways WHERE length(way) > 9
), placed AS (
  SELECT *, count(*) FILTER (WHERE c <> 'I') OVER w AS k, count(*) FILTER (WHERE c <> 'D') OVER w - 1 AS p FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), kept AS (
  SELECT l.conv_id, l.i, l.c, l.p, t.role, t.txt, max(CASE WHEN l.p = 0 AND l.c = 'K' AND t.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
  FROM placed l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.k = l.k AND l.c <> 'I' WHERE l.c <> 'D'
), mended AS (
  SELECT conv_id, string_agg(CASE WHEN c = 'K' THEN role WHEN (p - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(txt, ''), chr(10) ORDER BY i) AS whole FROM kept GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE k > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  substr(way, 1, 9)::BIGINT AS cost, substr(way, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM w.conv_id
"""

#: The digest of a row with the text {0}.
LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

#: All levels of the trees over {0} (tree, pos, h), and for each leaf a row a level: what stands before and after it in its run.
TREE_SQL = """
{1}_lv AS (
  SELECT tree, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {0}
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM {1}_lv WHERE n > 1 GROUP BY tree, lvl, pos // 16
), {1}_run AS (
  SELECT tree, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {1}_lv WHERE n > 1 GROUP BY ALL
), {1}_path AS (
  SELECT t.tree, t.pos, list(array_to_string(list_slice(hs, 1, nth), '') || '|' || array_to_string(list_slice(hs, nth + 2, 16), '') ORDER BY lvl) AS path
  FROM (SELECT {0}.tree, {0}.pos, lvl, hs, (({0}.pos // (16 ** lvl)::BIGINT) % 16)::BIGINT AS nth
        FROM {0} JOIN {1}_run r ON r.tree IS NOT DISTINCT FROM {0}.tree AND r.run = {0}.pos // (16 ** (lvl + 1))::BIGINT) t
  GROUP BY t.tree, t.pos
)"""

OP13_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {LEAF_SQL.format("text")}) - 1 AS pos, {LEAF_SQL.format("text")} AS h,
    CASE WHEN {CRC_SQL.format("doc_id::VARCHAR")} % 5 = 0 THEN {LEAF_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS shown
  FROM documents
), {TREE_SQL.format("leaf", "doc")}, top AS (
  SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h FROM doc_lv WHERE n = 1
), {TREE_SQL.format("top", "src")}, whole AS (
  SELECT l.doc_id, l.h AS leaf, coalesce(l.shown, l.h) AS shown, top.h AS subroot, r.h AS root, coalesce(p.path, []) || coalesce(s.path, []) AS path
  FROM leaf l JOIN top ON top.source IS NOT DISTINCT FROM l.tree JOIN src_lv r ON r.n = 1
  LEFT JOIN doc_path p ON p.tree IS NOT DISTINCT FROM l.tree AND p.pos = l.pos
  LEFT JOIN src_path s ON s.pos = top.pos
), folded AS (
  SELECT *, list_reduce(path, lambda a, x: sha256(replace(x, '|', a)), shown) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
