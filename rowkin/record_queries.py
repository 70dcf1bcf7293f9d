"""Queries of reviews, training labels, versions, histories, block keys and tallies, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.operators import blocking, feedback, learn
from rowkin.plans import assistant
from rowkin.queries import query, table
from rowkin.schema import FIELDS

_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'ESCALATED' ELSE 'PENDING' END"
_ACT = "CASE o_orderkey % 7 WHEN 0 THEN 'approve' WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' WHEN 3 THEN 'reject' WHEN 4 THEN 'escalate' WHEN 5 THEN 'approve' ELSE 'undo' END"
_ASKED = "CASE WHEN o_orderkey % 11 = 0 THEN 7 WHEN o_orderkey % 11 = 1 THEN o_custkey % 5 END"
_CHOSEN = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 3 END"


@query(f"""WITH c AS (SELECT l_orderkey AS r, min(l_linenumber) AS rank, l_suppkey % 5 AS p FROM lineitem GROUP BY 1, 3)
, top AS (SELECT r, min_by(p, rank * 1000 + p) AS p FROM c GROUP BY 1)
, a AS (SELECT o_orderkey AS k, {_STATUS} AS s, o_orderstatus = 'P' AS amb, {_ACT} AS act, {_ASKED} AS asked, {_CHOSEN} AS chosen, o_orderkey % 13 = 0 AS silent, o_orderkey % 3 = 0 AS admin, o_orderkey % 17 <> 0 AS known FROM orders)
, t AS (SELECT a.*, CASE WHEN known THEN coalesce(asked, chosen, CASE WHEN act = 'reject' THEN top.p END) ELSE asked END AS target FROM a LEFT JOIN top ON top.r = a.k)
, h AS (SELECT t.*, c.rank FROM t LEFT JOIN c ON c.r = t.k AND c.p = t.target)
, e AS (SELECT *, CASE WHEN NOT known THEN 'not_found' WHEN act = 'undo' THEN 'unknown_action' WHEN act <> 'approve' AND silent THEN 'comment_required' WHEN act = 'approve' AND s = 'APPROVED' THEN 'already_approved' WHEN act <> 'escalate' AND s IN ('APPROVED', 'REJECTED') THEN 'already_reviewed'
    WHEN act = 'reject' AND s = 'ESCALATED' AND NOT admin THEN 'escalated_to_admin' WHEN act = 'escalate' AND s <> 'PENDING' THEN 'not_pending' WHEN act = 'approve' AND asked IS NULL AND amb THEN 'provider_choice_required' WHEN act = 'approve' AND target IS NULL THEN 'provider_required' WHEN act = 'approve' AND rank IS NULL THEN 'provider_not_a_candidate' END AS error FROM h)
SELECT k AS action_id, error, CASE WHEN error IS NULL THEN CASE act WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' ELSE 'ESCALATED' END WHEN known THEN s END AS review_status, CASE WHEN error IS NULL AND act = 'approve' THEN target END AS approved_provider_id,
  CASE WHEN error IS NULL AND act <> 'escalate' AND rank IS NOT NULL THEN concat_ws(':', CASE WHEN act = 'approve' THEN 'TRUE_MATCH' ELSE 'FALSE_MATCH' END, target, rank, 'organization') END AS feedback FROM e""")
def review_outcomes(spark, sf_dir):
    """Outcomes of approvals, rejections and escalations, and the vectors that they capture."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    results = orders.where("o_orderkey % 17 <> 0").select(k.alias("result_id"), F.expr(_STATUS).alias("review_status"), F.when(F.col("o_orderstatus") == "P", "AMBIGUOUS").otherwise("MATCH").alias("decision"), F.expr(_CHOSEN).alias("provider_id"), F.lit("organization").alias("kind"))
    candidates = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("result_id"), (F.col("l_suppkey") % 5).alias("provider_id")).agg(F.min("l_linenumber").alias("rank"), F.create_map(F.lit("npi"), F.lit("VALID_EXACT")).alias("levels"))
    actions = orders.select(k.alias("action_id"), k.alias("result_id"), F.expr(_ACT).alias("action"), F.expr(_ASKED).cast("long").alias("provider_id"), F.when(k % 13 == 0, " ").otherwise("seen").alias("comment"), (k % 3 == 0).alias("is_admin"))
    out = feedback.reviewed(results, candidates, actions)
    shown = F.when(F.col("feedback").isNotNull(), F.concat_ws(":", "feedback.verdict", F.col("feedback.provider_id").cast("string"), F.col("feedback.rank").cast("string"), "feedback.model"))
    return out.select("action_id", "error", "review_status", "approved_provider_id", shown.alias("feedback"))


_ORG = list(FIELDS["organization"].items())
_NAMES = {f: f"CASE user_id % {len(levels)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(levels)) + " END" for f, levels in _ORG}


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
, l AS (SELECT user_id AS key, CAST(event_type = 'purchase' AS INTEGER) AS label, event_id % 6 > 1 AS fits FROM n WHERE r = 1)
SELECT key, CASE WHEN fits THEN 'organization' END AS kind, CASE WHEN fits THEN concat_ws(',', {", ".join(f"key % {len(x)}" for _, x in _ORG)}) END AS vector, label FROM l""")
def training_labels(spark, sf_dir):
    """The newest verdicts with vectors read back from the level names that were stored; some fit no kind."""
    events = table(spark, sf_dir, "events")
    u, e = F.col("user_id"), F.col("event_id")
    names = F.map_from_arrays(F.array(*(F.lit(f) for f, _ in _ORG)), F.array(*(F.expr(_NAMES[f]) for f, _ in _ORG)))
    odd = F.map_concat(F.map_filter(names, lambda k, v: k != "npi"), F.create_map(F.lit("npi"), F.lit("NO_SUCH_LEVEL")))
    levels = F.when(e % 6 == 1, odd).when(e % 6 != 0, names)
    told = events.select(e.alias("feedback_id"), u.alias("result_id"), F.when(F.col("event_type") == "purchase", "TRUE_MATCH").otherwise("FALSE_MATCH").alias("verdict"), F.col("ts").alias("created_at"), levels.alias("levels"), F.when(e % 2 == 0, "individual").otherwise("organization").alias("model"))
    results = events.select("user_id").distinct().select(u.alias("result_id"), F.lit(1).alias("run_id"), F.lit("MATCH").alias("decision"), F.lit(False).alias("audit_sampled"))
    runs = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.lit(1).alias("run_id"), F.lit(0.1).alias("audit_rate"))
    out = feedback.training_labels(told, results, runs)
    return out.select("key", "kind", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"), "label")


@query("SELECT event_id AS feedback_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 500")
def training_prefix(spark, sf_dir):
    """The oldest 500 pieces of feedback (a limit is what is asked for)."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("feedback_id"), F.col("ts").alias("created_at"))
    return feedback.training_prefix(rows, 500).select("feedback_id")


_VERSION = "CASE WHEN {0} % 4 = 0 THEN 'em' || {0} // 40 ELSE 'em' || {0} // 40 || '.r' || ({0} % 9) END"


@query(f"""WITH t AS (SELECT DISTINCT {_VERSION.format("p_partkey")} AS v FROM part WHERE p_partkey % 5 <> 0), p AS (SELECT DISTINCT {_VERSION.format("c_custkey")} AS v FROM customer)
, x AS (SELECT v, regexp_extract(v, '^(.+)\\.r(\\d+)$', 1) AS r, regexp_extract(v, '^(.+)\\.r(\\d+)$', 2) AS n FROM p), y AS (SELECT v, CASE WHEN r = '' THEN v ELSE r END AS root, CASE WHEN r = '' THEN 1 ELSE n::BIGINT + 1 END AS least FROM x)
SELECT v AS version, root || '.r' || (SELECT min(i) FROM range(y.least, y.least + 30) q(i) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.v = root || '.r' || i)) AS next FROM y""")
def next_versions(spark, sf_dir):
    """The next free version of each config."""
    spark_sql = _VERSION.replace("//", "div")
    name = lambda t, k, where: table(spark, sf_dir, t).where(where).select(F.expr(spark_sql.format(k)).alias("version"))
    return feedback.next_versions(name("customer", "c_custkey", "true"), name("part", "p_partkey", "p_partkey % 5 <> 0"))


@query("SELECT event_id::VARCHAR AS entity_id, 'q' || event_id AS question, CASE WHEN event_id % 3 <> 0 THEN 'SELECT ' || event_id END AS sql, CASE WHEN event_id % 3 <> 0 THEN event_id % 50 ELSE 0 END AS rows, CASE WHEN event_id % 3 = 0 THEN 'not allowed' END AS rejected FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id::VARCHAR LIMIT 20")
def assistant_history(spark, sf_dir):
    """A user's twenty newest questions, read back from the audit log (a limit is what is asked for)."""
    e = F.col("event_id")
    refused = e % 3 == 0
    null = F.lit(None)
    asked = table(spark, sf_dir, "events").select(e.alias("attempt_id"), "user_id", F.col("ts").alias("asked_at"), F.concat(F.lit("q"), e.cast("string")).alias("question"), F.when(~refused, F.concat(F.lit("SELECT "), e.cast("string"))).alias("sql"), F.when(~refused, e % 50).alias("rows"), F.when(refused, "not allowed").alias("rejected"), null.cast("string").alias("code"), F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"), F.lit(0.5).alias("seconds"))
    return assistant.history(assistant.attempts(asked), 5).select("entity_id", "question", "sql", "rows", "rejected")


@query("""WITH r AS (SELECT c_custkey AS id, c_nationkey % 4 = 0 AS org, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_custkey % 100 ELSE '' END AS npi, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'S' || c_nationkey END AS st, lpad((c_custkey % 700)::VARCHAR, 5, '0') AS zip, CASE WHEN c_custkey % 8 <> 0 THEN 1950 + c_custkey % 40 END AS yr, 'L' || c_custkey % 90 AS lic, c_mktsegment AS last, substr(c_name, 1, 8) AS first FROM customer)
SELECT id AS record_id, block, key FROM (
  SELECT id, 'npi' AS block, npi AS key FROM r WHERE npi <> '' UNION SELECT id, 'license', lic || '|' || st FROM r WHERE st <> '' UNION SELECT id, 'ein', 'E' || id % 50 FROM r WHERE org
  UNION SELECT id, 'zip_name3', zip || '|' || substr(last, 1, 3) FROM r WHERE NOT org UNION SELECT id, 'zip_name3', zip || '|' || substr(first, 1, 3) FROM r WHERE NOT org UNION SELECT id, 'zip_name3', zip || '|' || substr(last, 1, 3) FROM r WHERE org
  UNION SELECT id, 'state_dob', st || '|' || (yr + d) FROM r, (VALUES (0), (-1), (1)) v(d) WHERE NOT org AND st <> '' AND yr IS NOT NULL
  UNION SELECT id, 'phonetic_state', p || '|' || st FROM r, (VALUES ('A'), ('B')) v(p) WHERE NOT org AND st <> ''
  UNION SELECT id, 'org_token_state', last || '|' || st FROM r WHERE org AND st <> '' UNION SELECT id, 'org_token_state', 'OF|' || st FROM r WHERE org AND st <> ''
  UNION SELECT id, 'org_acronym', 'AC' || id % 9 FROM r WHERE org UNION SELECT id, 'org_acronym', 'ABC' FROM r WHERE org AND id % 2 = 0)""")
def block_key_table(spark, sf_dir):
    """Keys of all blocks of persons and organizations as a query asks for them, the years before and after included."""
    c = F.col("c_custkey")
    st = F.when(c % 6 == 0, "").otherwise(F.concat(F.lit("S"), F.col("c_nationkey").cast("string")))
    rows = table(spark, sf_dir, "customer").select(
        c.alias("record_id"), (F.col("c_nationkey") % 4 == 0).alias("is_organization"), F.when(c % 3 == 0, F.concat(F.lit("N"), (c % 100).cast("string"))).otherwise("").alias("npi"),
        F.concat(F.lit("L"), (c % 90).cast("string")).alias("license_number"), st.alias("license_state"), F.concat(F.lit("E"), (c % 50).cast("string")).alias("ein"), F.concat(F.lit("AC"), (c % 9).cast("string")).alias("org_acronym_key"), F.lit("").alias("dba_acronym_key"),
        F.when(c % 2 == 0, "ABC").otherwise("A LONG NAME").alias("org_name_norm"), F.lit("").alias("dba_name_norm"), F.struct(st.alias("state"), F.lpad((c % 700).cast("string"), 5, "0").alias("zip5")).alias("address"),
        F.col("c_mktsegment").alias("last_norm"), F.left("c_name", F.lit(8)).alias("first_norm"), F.array("c_mktsegment", F.lit("OF")).alias("org_tokens"), F.struct(F.when(c % 8 != 0, 1950 + c % 40).alias("year")).alias("dob"), F.array(F.lit("A"), F.lit("B")).alias("phonetic_keys"),
    )
    return blocking.block_keys(rows, query=True)


@query("""WITH p AS (SELECT [l_linenumber % 4, l_suppkey % 3, CAST(l_quantity AS INTEGER) % 2] AS v, l_orderkey % 6 = 0 AS seen FROM lineitem), n AS (SELECT v, count(*) AS n FROM p GROUP BY 1), m AS (SELECT v, count(*) * 3 AS m FROM p WHERE seen GROUP BY 1)
SELECT array_to_string(v, ',') AS vector, CAST(n - coalesce(m, 0) AS BIGINT) AS n FROM n LEFT JOIN m USING (v) WHERE n - coalesce(m, 0) > 0""")
def tally_without_labels(spark, sf_dir):
    """A tally of patterns less three times those that are labelled, never below zero."""
    v = F.array(F.expr("cast(l_linenumber % 4 as int)"), F.expr("cast(l_suppkey % 3 as int)"), F.expr("cast(l_quantity as int) % 2"))
    pairs = table(spark, sf_dir, "lineitem").select(F.lit("individual").alias("kind"), v.alias("vector"), (F.col("l_orderkey") % 6 == 0).alias("seen"))
    taken = learn.pattern_tally(pairs.where("seen")).withColumn("n", F.col("n") * 3)
    return learn.less(learn.pattern_tally(pairs), taken).select(F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"), "n")
