"""Queries of the listings, labels, counts and estimates, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.operators import listings
from rowkin.queries import _SHARE, CONFIDENT_SQL, _confident, query, table
from rowkin.sources import tables

COLLECTED_SQL = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
, c AS (SELECT user_id AS result_id, CAST(event_type = 'purchase' AS INTEGER) AS label, user_id % 4 = 0 AND r_regionkey > 0 AS audited, r_regionkey::DOUBLE / 10 AS rate, user_id % 3 = 0 AS rejected, r_regionkey = 2 AS in_tally FROM n JOIN region ON user_id % 5 = r_regionkey WHERE r = 1)
, l AS (SELECT result_id, label, CASE WHEN audited THEN 'audit' WHEN rejected THEN 'voluntary' ELSE 'review' END AS source, CASE WHEN audited THEN round(1.0::DOUBLE / rate, 9) ELSE 1.0::DOUBLE END AS weight, in_tally FROM c)
"""


def _collected(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    feedback = events.select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("result_id"), F.when(F.col("event_type") == "purchase", "TRUE_MATCH").otherwise("FALSE_MATCH").alias("verdict"), F.col("ts").alias("created_at"))
    u = F.col("user_id")
    results = events.select("user_id").distinct().select(u.alias("result_id"), (u % 5).alias("run_id"), F.when(u % 3 == 0, "NO_MATCH").otherwise("MATCH").alias("decision"), (u % 4 == 0).alias("audit_sampled"))
    runs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("run_id"), (F.col("r_regionkey").cast("double") / 10).alias("audit_rate"))
    return listings.collected_labels(feedback, results, runs, 2)


@query(f"{COLLECTED_SQL} SELECT * FROM l")
def collected_labels(spark, sf_dir):
    """The newest verdict on each result, its source and weight."""
    return _collected(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(f"{COLLECTED_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE source = 'audit') AS audit, count(*) FILTER (WHERE source = 'review') AS review, count(*) FILTER (WHERE source = 'voluntary') AS voluntary FROM l")
def label_counts(spark, sf_dir):
    """Labels by class and source, in one pass."""
    return listings.label_counts(_collected(spark, sf_dir), source=["audit", "review", "voluntary"])


@query(f"""{CONFIDENT_SQL}, q AS (SELECT confidence AS c, CAST(label AS DOUBLE) AS y, CAST(doc_id % 3 + 1 AS DOUBLE) AS w FROM p)
, b AS (SELECT least(greatest(CAST(trunc(c * 10) AS INTEGER), 0), 9) AS bin, abs(sum(w * c) - sum(w * y)) AS gap FROM q GROUP BY 1)
SELECT count(*) AS n, round(sum(w * y) FILTER (WHERE c >= 0.7) / sum(w) FILTER (WHERE c >= 0.7), 6) AS "precision", round(sum(w * y) FILTER (WHERE c >= 0.7) / sum(w * y), 6) AS recall, round(sum(w * y) FILTER (WHERE c < 0.3) / sum(w * y), 6) AS missed,
  round(sum(w) FILTER (WHERE c >= 0.3 AND c < 0.7) / sum(w), 6) AS review_share, round((SELECT sum(gap) FROM b) / sum(w), 6) AS ece, round(sum(w * (c - y) * (c - y)) / sum(w), 6) AS brier FROM q""")
def judged_cuts(spark, sf_dir):
    """Rates of two cuts on weighted labels, with calibration error and Brier score."""
    return listings.judged(_confident(spark, sf_dir).withColumn("weight", F.col("doc_id") % 3 + 1), 0.7, 0.3)


@query("""WITH r AS (SELECT o_orderpriority AS s, o_orderkey % 7 = 0 OR o_orderpriority = '1-URGENT' AS seen, o_orderstatus AS d, o_orderkey % 2 = 0 AS m FROM orders)
, p AS (SELECT s, count(*)::DOUBLE AS size, count(*) FILTER (WHERE seen) AS n, count(*) FILTER (WHERE m) AS expected, count(*) FILTER (WHERE seen AND d = 'F' AND m) AS tp, count(*) FILTER (WHERE seen AND d = 'F' AND NOT m) AS fp, count(*) FILTER (WHERE seen AND d = 'P') AS review FROM r GROUP BY 1)
, e AS (SELECT sum(tp * size / n) AS tp, sum(fp * size / n) AS fp, sum(review * size / n) AS review, sum(expected) AS expected FROM p WHERE n > 0)
, x AS (SELECT *, tp / (tp + fp) AS pr, tp / expected AS rc FROM e)
SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(review, 6) AS review, round(pr, 9) AS "precision", round(rc, 9) AS recall, round(2 * pr * rc / (pr + rc), 9) AS f1 FROM x""")
def stratified_estimate(spark, sf_dir):
    """Totals estimated from strata: one judged whole, the others by a sample that is scaled up."""
    d, match = F.col("o_orderstatus"), F.col("o_orderkey") % 2 == 0
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), ((F.col("o_orderkey") % 7 == 0) | (F.col("o_orderpriority") == "1-URGENT")).alias("seen"), match.alias("m"), ((d == "F") & match).cast("int").alias("tp"), ((d == "F") & ~match).cast("int").alias("fp"), (d == "P").cast("int").alias("review"))
    out = listings.stratified(rows, "stratum", F.col("seen"), F.count_if("m"))
    return out.select(*(F.round(c, 6).alias(c) for c in ("tp", "fp", "review")), *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH k AS (SELECT 'segment' AS block, c_mktsegment AS key FROM customer UNION ALL SELECT 'nation', c_nationkey::VARCHAR FROM customer), p AS (SELECT block, key, count(*) AS n FROM k GROUP BY 1, 2)
SELECT block, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest FROM p GROUP BY 1""")
def block_statistics(spark, sf_dir):
    """Keys, rows and the largest key of two blocks."""
    keys = F.array(F.struct(F.lit("segment").alias("block"), F.col("c_mktsegment").alias("key")), F.struct(F.lit("nation").alias("block"), F.col("c_nationkey").cast("string").alias("key")))
    return listings.block_statistics(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.explode(keys).alias("k")).select("record_id", "k.block", "k.key"))


_DECIDED = "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'MATCH' WHEN o_orderstatus = 'P' THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END"


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("result_id"), (F.col("o_custkey") % 7).alias("run_id"), F.expr(_DECIDED).alias("decision"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 4).alias("n_candidates"))


@query(f"WITH r AS (SELECT o_custkey % 7 AS run_id, {_DECIDED} AS d FROM orders) SELECT run_id, count(*) AS records_total, count(*) FILTER (WHERE d = 'MATCH') AS matched, count(*) FILTER (WHERE d = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE d = 'NO_MATCH') AS no_match, count(*) FILTER (WHERE d IS NULL) AS failed FROM r GROUP BY 1")
def run_outcomes(spark, sf_dir):
    """Outcome counters of each run."""
    return listings.outcomes(_results(spark, sf_dir))


@query(f"SELECT o_orderkey AS record_id FROM orders WHERE {_DECIDED} = 'NO_MATCH' AND o_custkey % 4 > 0 AND {_SHARE.format("concat('R7:', o_orderkey::VARCHAR)")} < 0.25")
def audit_drawn(spark, sf_dir):
    """Rejected records with candidates that the audit draws."""
    return listings.audit_drawn(_results(spark, sf_dir), 0.25, "R7").select("record_id")


@query("SELECT l_orderkey AS result_id, l_linenumber AS rank, c_name AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_suppkey = 7 ORDER BY o_orderdate DESC, l_orderkey, l_linenumber LIMIT 50")
def ranked_in(spark, sf_dir):
    """The newest fifty results that rank one master row (a page is what is asked for)."""
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_suppkey").alias("provider_id"), F.col("l_linenumber").alias("rank"))
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("record_id"), F.col("o_orderdate").alias("created_at"))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"))
    return listings.ranked_in(candidates, results, records, 7).select("result_id", "rank", "name")


@query("SELECT l_orderkey AS result_id, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey) AS vectors FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 = 3 GROUP BY 1")
def run_population(spark, sf_dir):
    """The candidates that a run stored for each result, by rank."""
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_suppkey").alias("vector"), F.col("l_linenumber").alias("rank"))
    return listings.population(candidates, _results(spark, sf_dir), 3).select("result_id", F.array_join(F.col("vectors").cast("array<string>"), ",").alias("vectors"))


@query("""WITH u AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c.c_custkey AS config_id, c.c_name AS version, p.c_name AS parent_version, coalesce(n, 0) AS runs, strftime(last, '%Y-%m-%d') AS latest, c.c_custkey = 10 AS active FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 2 LEFT JOIN u ON u.k = c.c_custkey""")
def config_summaries(spark, sf_dir):
    """Versions with their parents, runs and the active one."""
    configs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("config_id"), F.col("c_name").alias("version"), F.expr("c_custkey div 2").alias("parent_id"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("config_id"), F.col("o_orderdate").alias("created_at"))
    return listings.config_summaries(configs, runs, 10).select("config_id", "version", "parent_version", "runs", F.date_format("latest_run_at", "yyyy-MM-dd").alias("latest"), "active")


@query("SELECT o_orderkey AS k, CAST(41 + row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS ordinal FROM orders WHERE o_orderkey % 3 <> 0")
def new_ordinals(spark, sf_dir):
    """Dense ordinals of new rows after the highest in use."""
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"))
    return listings.with_ordinals(new, "k", 41, width=1000)


@query("WITH f AS (SELECT c_mktsegment AS field, c_custkey AS level, c_acctbal AS weight FROM customer), r AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(weight) DESC, field, level) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 3 * (SELECT count(DISTINCT field) FROM f)")
def strongest_weights(spark, sf_dir):
    """The largest weights, three a field."""
    return listings.strongest(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("field"), F.col("c_custkey").alias("level"), F.col("c_acctbal").alias("weight")))


@query("SELECT o_orderpriority AS level, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def level_pivot(spark, sf_dir):
    """A row a level, a column a strategy."""
    cells = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("strategy")).agg(F.max("o_orderkey").alias("f1"))
    return listings.by_strategy(cells, ["F", "O", "P"])


@query("SELECT o_orderkey AS ordinal, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderkey LIMIT 400 OFFSET 150")
def scan_window(spark, sf_dir):
    """A window of rows in their stable order, whatever gaps the ordinals have (a window is what is asked for)."""
    return tables.batch(table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("ordinal"), "o_orderstatus"), 150, 400)
