"""Queries of the review queue, conflicts, tiles, match details, and runs recorded by commits, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowkin.listing_queries import _DECIDED
from rowkin.operators import adjudicate, decide, learn, recorded, stats
from rowkin.queries import _SHARE, query, table
from rowkin.schema import FIELDS
from rowkin.sources import commits
from rowkin.storage import shared_dir

_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'ESCALATED' ELSE 'PENDING' END"
_OPEN = "CASE p_size % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'EXPIRED' ELSE 'ACTIVE' END"
_TODAY = "DATE '2024-01-20'"
TABLES_SQL = f"""
WITH res AS (SELECT o_orderkey AS result_id, o_custkey AS record_id, o_custkey % 7 AS run_id, {_DECIDED} AS decision, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 1000) / 1000.0::DOUBLE END AS confidence, o_orderdate::TIMESTAMP AS created_at,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS superseded_by, {_STATUS} AS review_status, o_orderkey % 9 = 0 AS audit_sampled, CASE WHEN o_orderkey % 6 = 0 THEN 'call' || o_orderkey % 3 END AS call_key FROM orders)
, rec AS (SELECT c_custkey AS record_id, upper(c_mktsegment) AS state, 'type' || c_custkey % 3 AS sanction_type, c_nationkey % 2 = 0 AS is_organization, c_custkey % 10 <> 0 AS is_current FROM customer)
, cas AS (SELECT p_partkey AS case_id, p_partkey * 4 + 1 AS result_id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 4 + 2 END AS conflict_result_id, {_OPEN} AS status, p_partkey % 2 = 0 AS conflict_flag, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS start_date FROM part)
"""


def _tables(spark, sf_dir):
    k = F.col("o_orderkey")
    results = table(spark, sf_dir, "orders").select(
        k.alias("result_id"), F.col("o_custkey").alias("record_id"), (F.col("o_custkey") % 7).alias("run_id"), F.expr(_DECIDED).alias("decision"), F.when(k % 11 != 0, (k % 1000) / 1000.0).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(k % 4 == 0, k + 1).alias("superseded_by"), F.expr(_STATUS).alias("review_status"), (k % 9 == 0).alias("audit_sampled"), F.when(k % 6 == 0, F.concat(F.lit("call"), (k % 3).cast("string"))).alias("call_key"),
    )
    c = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(c.alias("record_id"), F.upper("c_mktsegment").alias("state"), F.concat(F.lit("type"), (c % 3).cast("string")).alias("sanction_type"), (F.col("c_nationkey") % 2 == 0).alias("is_organization"), (c % 10 != 0).alias("is_current"))
    p = F.col("p_partkey")
    cases = table(spark, sf_dir, "part").select(p.alias("case_id"), (p * 4 + 1).alias("result_id"), F.when(p % 5 != 0, p * 4 + 2).alias("conflict_result_id"), F.expr(_OPEN).alias("status"), (p % 2 == 0).alias("conflict_flag"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("start_date"))
    return results, records, cases


@query(f"""{TABLES_SQL}, live AS (SELECT * FROM cas WHERE status = 'ACTIVE' AND conflict_flag)
SELECT result_id, EXISTS (SELECT 1 FROM live WHERE live.result_id = res.result_id) OR EXISTS (SELECT 1 FROM live WHERE conflict_result_id = res.result_id) AS involved FROM res""")
def live_conflicts(spark, sf_dir):
    """Results that a live conflict is about, and all others."""
    results, _, cases = _tables(spark, sf_dir)
    side = lambda x: stats.in_conflict(results, cases, x).select("result_id", F.lit(x).alias("involved"))
    return side(True).unionByName(side(False))


_ASKED = "decision = 'AMBIGUOUS' AND review_status = 'PENDING' AND confidence BETWEEN 0.05 AND 0.95 AND created_at >= TIMESTAMP '1993-01-01' AND created_at < TIMESTAMP '1998-01-02' AND sanction_type = 'type1' AND is_organization AND superseded_by IS NULL"


@query(f"""{TABLES_SQL}, live AS (SELECT * FROM cas WHERE status = 'ACTIVE' AND conflict_flag), q AS (SELECT *, EXISTS (SELECT 1 FROM live WHERE live.result_id = res.result_id OR conflict_result_id = res.result_id) AS involved FROM res JOIN rec USING (record_id))
SELECT 'filters' AS asked, result_id, record_id, confidence FROM q WHERE {_ASKED} AND NOT involved UNION ALL SELECT 'conflicts', result_id, record_id, confidence FROM q WHERE involved AND state = 'BUILDING' UNION ALL SELECT 'audit', result_id, record_id, confidence FROM q WHERE audit_sampled AND superseded_by IS NULL AND run_id = 3""")
def review_queue(spark, sf_dir):
    """Three questions to the review queue: many filters, those in conflict with history, and a run's audit."""
    results, records, cases = _tables(spark, sf_dir)
    asked = {
        "filters": dict(decision="AMBIGUOUS", status="PENDING", least=0.05, most=0.95, since="1993-01-01", until="1998-01-01", sanction_type="type1", is_organization=True, conflict=False),
        "conflicts": dict(conflict=True, state="building", superseded=True),
        "audit": dict(audit=True, run=3),
    }
    out = None
    for name, filters in asked.items():
        one = stats.queue(results, records, cases, **filters).select(F.lit(name).alias("asked"), "result_id", "record_id", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{TABLES_SQL}, ph AS (SELECT *, CASE WHEN status = 'ACTIVE' AND start_date > {_TODAY} THEN 'PENDING' ELSE status END AS phase FROM cas)
SELECT (SELECT count(*) FROM supplier) AS providers, (SELECT count(*) FROM rec WHERE is_current) AS sanction_records, {", ".join(f"(SELECT count(*) FROM res WHERE superseded_by IS NULL AND decision = '{d}') AS {n}" for d, n in (("MATCH", "matched"), ("AMBIGUOUS", "ambiguous"), ("NO_MATCH", "no_match")))},
  {", ".join(f"(SELECT count(*) FROM res WHERE superseded_by IS NULL AND decision <> 'NO_MATCH' AND review_status = '{r}') AS {n}" for r, n in (("PENDING", "pending_review"), ("ESCALATED", "escalated"), ("APPROVED", "approved"), ("REJECTED", "rejected")))},
  {", ".join(f"(SELECT count(*) FROM ph WHERE phase = '{p}') AS cases_{p.lower()}" for p in ("PENDING", "ACTIVE", "EXPIRED", "CLOSED"))}, (SELECT count(*) FROM cas WHERE status = 'ACTIVE' AND conflict_flag) AS conflicts""")
def kpi_tiles(spark, sf_dir):
    """The fourteen tiles of the dashboard."""
    results, records, cases = _tables(spark, sf_dir)
    return stats.kpi_tiles(table(spark, sf_dir, "supplier"), records, results, cases, F.lit("2024-01-20").cast("date"))


@query(f"""{TABLES_SQL}, cand AS (SELECT l_orderkey AS result_id, l_linenumber AS rank, l_suppkey AS provider_id, round(l_discount, 2) AS confidence, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
, listed AS (SELECT result_id, string_agg(rank || ':' || provider_id || ':' || s_name, ',' ORDER BY rank, provider_id, confidence) AS candidates FROM cand GROUP BY 1)
, own AS (SELECT result_id, string_agg(case_id::VARCHAR, ',' ORDER BY start_date DESC, case_id) AS cases FROM cas GROUP BY 1), against AS (SELECT conflict_result_id AS result_id, string_agg(case_id::VARCHAR, ',' ORDER BY start_date DESC, case_id) AS conflicting FROM cas WHERE status = 'ACTIVE' AND conflict_result_id IS NOT NULL GROUP BY 1)
SELECT res.result_id, rec.state, candidates, coalesce(cases, '') AS cases, coalesce(conflicting, '') AS conflicting, 'v' || run_id % 3 AS band, call_key AS model
FROM res JOIN rec USING (record_id) LEFT JOIN listed USING (result_id) LEFT JOIN own USING (result_id) LEFT JOIN against USING (result_id)""")
def match_details(spark, sf_dir):
    """Every result with its record, candidates, cases, contradicted cases, band and call."""
    results, records, cases = _tables(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("provider_id"), F.round("l_discount", 2).alias("confidence"))
    providers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"), "s_name")
    listed = results.select(F.col("result_id").alias("record_id"), F.col("record_id").alias("own_record"), "result_id", "run_id", "call_key")
    named = records.withColumnRenamed("record_id", "own_record")
    details = stats.match_detail(listed, lines, listed.select("record_id", "own_record").join(named, "own_record"), providers)
    runs = results.select("run_id").distinct().withColumn("config_id", F.col("run_id") % 3)
    configs = runs.select("config_id").distinct().select("config_id", F.concat(F.lit("v"), F.col("config_id").cast("string")).alias("version"), F.lit(0.9).alias("t_accept"), F.lit(0.1).alias("t_reject"))
    calls = results.select("call_key").distinct().filter("call_key is not null").select("call_key", F.col("call_key").alias("model"), F.lit("p1").alias("prompt_version"), F.lit("{}").alias("response"))
    out = stats.with_context(details, cases.withColumn("created_at", F.col("start_date")), runs, configs, calls)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["case_id"].cast("string")), ",").alias(c)
    shown = F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["provider_id"].cast("string"), x["provider"]["s_name"])), ",").alias("candidates")
    return out.select("result_id", F.col("record.state").alias("state"), shown, ids("cases"), ids("conflicting_cases").alias("conflicting"), F.col("band.version").alias("band"), F.col("call.model").alias("model"))


_FIRST = "CASE WHEN o_orderstatus = 'F' THEN 'MATCH' WHEN o_orderstatus = 'P' THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END"
_SECOND = f"CASE WHEN o_orderkey % 10 = 3 THEN 'MATCH' ELSE {_FIRST} END"
_RATE = 0.25


@query(f"""WITH d AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS record_id, 'A' || o_orderkey % 3 AS authority, {_FIRST} AS d1, {_SECOND} AS d2, o_orderkey % 8 = 0 AS unknown, o_orderkey % 7 = 0 AS by_model, o_custkey % 2 = 0 AS has FROM orders)
, r AS (SELECT *, substr(sha256('R1' || chr(31) || authority || chr(31) || record_id), 1, 32) AS id1, substr(sha256('R2' || chr(31) || authority || chr(31) || record_id), 1, 32) AS id2 FROM d)
, known AS (SELECT * FROM r WHERE NOT unknown)
, c AS (SELECT 'P' || p_partkey AS case_id, p_partkey::VARCHAR AS record_id, p_partkey % 3 AS s FROM part)
, hit AS (SELECT case_id, id2, record_id FROM known JOIN c USING (record_id) WHERE s = 0 AND d1 <> d2)
SELECT 'superseded' AS what, id1 AS a, id2 AS b FROM known UNION ALL SELECT 'current', id2, d2 FROM known UNION ALL SELECT 'conflict', case_id, id2 FROM hit UNION ALL SELECT 'skipped', record_id, run FROM r, (VALUES ('R1'), ('R2')) v(run) WHERE unknown
UNION ALL SELECT 'match.ai_decided', id1, NULL FROM known WHERE by_model UNION ALL SELECT 'match.ai_decided', id2, NULL FROM known WHERE by_model UNION ALL SELECT 'case.conflict_flagged', case_id, NULL FROM hit
UNION ALL SELECT 'audited', id1, NULL FROM known WHERE d1 = 'NO_MATCH' AND has AND {_SHARE.format("concat('R1:', record_id)")} < {_RATE} UNION ALL SELECT 'audited', id2, NULL FROM known WHERE d2 = 'NO_MATCH' AND has AND {_SHARE.format("concat('R2:', record_id)")} < {_RATE}""")
def recorded_runs(spark, sf_dir):
    """Two runs written by commits: links, current results, conflicts, skipped records, audit rows and draws."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    store = commits.Store(spark, f"{shared_dir(spark)}/rowkin-store-{uuid.uuid4().hex}")
    scope = orders.where("o_orderkey % 8 <> 0").select(k.cast("string").alias("record_id"), F.concat(F.lit("A"), (k % 3).cast("string")).alias("source_authority"))
    candidates = orders.where("o_custkey % 2 = 0").select(k.cast("string").alias("record_id"), F.lit("S1").alias("provider_id"), F.lit(1).alias("rank"), F.lit("individual").alias("kind"), F.array((k % 4).cast("int")).alias("vector"))
    p = F.col("p_partkey")
    cases = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), p.cast("string")).alias("case_id"), F.concat(F.lit("A"), (p % 3).cast("string")).alias("source_authority"), p.cast("string").alias("record_id"), F.when(p % 3 == 0, "ACTIVE").otherwise("CLOSED").alias("status"), F.lit(False).alias("conflict_flag"))
    for run, decision in (("R1", _FIRST), ("R2", _SECOND)):
        decisions = orders.select(k.cast("string").alias("record_id"), F.expr(decision).alias("decision"), F.when(k % 7 == 0, "LLM").otherwise("PROBABILISTIC").alias("route"))
        recorded.write_run(store, run, decisions, candidates, scope, cases, chunks=2, audit_rate=_RATE, created_at=F.lit("2024-01-01").cast("timestamp"))
    nothing = F.lit(None).cast("string").alias("b")
    rows = lambda what, df, a, b=nothing: df.select(F.lit(what).alias("what") if isinstance(what, str) else what, F.col(a).alias("a"), F.col(b).alias("b") if isinstance(b, str) else b)
    results = recorded.read(store, "results")
    parts = [
        rows("superseded", recorded.read(store, "supersedes"), "old_id", "new_id"),
        rows("current", recorded.current_results(store), "result_id", "decision"),
        rows("conflict", recorded.read(store, "flags"), "case_id", "result_id"),
        rows("skipped", recorded.read(store, "skipped"), "record_id", "run_id"),
        rows(F.col("action").alias("what"), recorded.read(store, "audit"), "entity_id"),
        rows("audited", results.where("audit_sampled"), "result_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Lines of orders as pairs of the kind organization, some of which cannot be scored, and given tables by which they are.
_SIZES = [len(x) for x in FIELDS["organization"].values()]
_LEVELS = [f"(l_partkey * {3 + 2 * i} + l_linenumber * {i + 1}) % {n}" for i, n in enumerate(_SIZES)]
_MODEL = learn.Model("organization", [[(2 * k + 1) / n**2 for k in range(n)] for n in _SIZES], [[(2 * (n - k) - 1) / n**2 for k in range(n)] for n in _SIZES], 0.1)
_CURVE = [(-6.0, 0.05), (0.0, 0.4), (6.0, 0.97)]
_BITS = " + ".join("CASE v[%d] %s END" % (i + 1, " ".join(f"WHEN {k} THEN {b!r}::DOUBLE" for k, b in enumerate(bits))) for i, bits in enumerate(_MODEL.weights()))
_STATE = list(FIELDS["organization"]).index("state")


@query(f"""WITH p AS (SELECT l_orderkey AS record_id, l_suppkey * 10 + l_linenumber AS provider_id, [{", ".join(f"CAST({x} AS INTEGER)" for x in _LEVELS)}] AS v, CASE WHEN l_partkey % 97 = 0 THEN 'level out of range' WHEN l_partkey % 89 = 0 THEN 'no vector' WHEN l_partkey % 83 = 0 THEN 'vector of length 3' WHEN l_partkey % 79 = 0 THEN 'unknown kind: person' END AS err FROM lineitem)
, bad AS (SELECT record_id, min(err) AS error FROM p WHERE err IS NOT NULL GROUP BY 1)
, w AS (SELECT *, CAST({_BITS} AS DOUBLE) AS bits FROM p WHERE record_id NOT IN (SELECT record_id FROM bad))
, s AS (SELECT *, CASE WHEN bits <= -6 THEN 0.05 WHEN bits < 0 THEN 0.05 + (bits + 6) * (0.35 / 6.0::DOUBLE) WHEN bits < 6 THEN 0.4 + bits * (0.57 / 6.0::DOUBLE) ELSE 0.97 END AS conf FROM w)
, t AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY conf DESC, bits DESC, provider_id) AS rk FROM s QUALIFY rk <= 5)
, a AS (SELECT record_id, max(conf) FILTER (WHERE rk = 1) AS c1, max(conf) FILTER (WHERE rk = 2) AS c2, max(provider_id) FILTER (WHERE rk = 1) AS p1, min(rk) FILTER (WHERE v[1] = 3) AS ex, count(*) FILTER (WHERE v[1] = 3) AS holders FROM t GROUP BY 1)
, e AS (SELECT a.record_id, t.provider_id AS xp, t.conf AS xc, CASE WHEN t.v[{_STATE + 1}] = 1 THEN 1 ELSE 0 END AS clash FROM a JOIN t ON a.record_id = t.record_id AND a.ex = t.rk)
, r AS (SELECT o_orderkey AS record_id, error, c1, c2, p1, xp, xc, CASE WHEN error IS NOT NULL THEN NULL WHEN c1 IS NULL THEN 'NO_CANDIDATES' WHEN holders > 1 THEN 'NPI_EXACT_CONFLICT' WHEN holders = 1 AND clash = 0 THEN 'NPI_EXACT' WHEN c1 >= 0.9 AND c1 - c2 < 0.05 THEN 'THIN_MARGIN' WHEN c1 >= 0.9 THEN 'ABOVE_ACCEPT' WHEN c1 < 0.2 THEN 'BELOW_REJECT' ELSE 'GREY_BAND' END AS reason
    FROM orders LEFT JOIN bad ON o_orderkey = bad.record_id LEFT JOIN a ON o_orderkey = a.record_id LEFT JOIN e ON o_orderkey = e.record_id)
SELECT record_id, error, reason, CASE reason WHEN 'NO_CANDIDATES' THEN 'NO_MATCH' WHEN 'BELOW_REJECT' THEN 'NO_MATCH' WHEN 'NPI_EXACT' THEN 'MATCH' WHEN 'ABOVE_ACCEPT' THEN 'MATCH' WHEN NULL THEN NULL ELSE CASE WHEN reason IS NOT NULL THEN 'AMBIGUOUS' END END AS decision,
  CASE WHEN reason IN ('NPI_EXACT', 'NPI_EXACT_CONFLICT') THEN xp WHEN reason IN ('THIN_MARGIN', 'ABOVE_ACCEPT', 'GREY_BAND') THEN p1 END AS provider_id, round(CASE reason WHEN 'NPI_EXACT' THEN greatest(xc, 0.9) WHEN 'NPI_EXACT_CONFLICT' THEN xc WHEN 'NO_CANDIDATES' THEN NULL ELSE c1 END, 9) AS confidence FROM r""")
def isolated_decisions(spark, sf_dir):
    """Decisions of the engine's own scoring, conflicts and routing; records with pairs that cannot be scored end with an error."""
    k = F.col("l_partkey")
    whole = F.array(*(F.expr(x).cast("int") for x in _LEVELS))
    vector = F.when(k % 97 == 0, F.array(F.lit(9), *(F.lit(0) for _ in _SIZES[1:]))).when(k % 89 == 0, F.lit(None)).when(k % 83 == 0, F.array(*(F.lit(0),) * 3)).otherwise(whole)
    kind = F.when((k % 79 == 0) & (k % 97 != 0) & (k % 89 != 0) & (k % 83 != 0), "person").otherwise("organization")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("provider_id"), kind.alias("kind"), vector.alias("vector"), F.lit(False).alias("cross_type"))
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    out = decide.isolated(records, pairs, {"organization": decide.Bundle(_MODEL, _CURVE, 0.9, 0.2)})
    return out.select("record_id", "error", "reason", "decision", "provider_id", F.round("confidence", 9).alias("confidence"))


_GOOD = '{"decision": "MATCH", "provider_id": "P1", "confidence": 0.75, "evidence_cited": ["P1.npi"], "reasoning": "the number agrees"}'


def _model(prompt: str) -> str:
    """A stand-in that errs by the record's number: no JSON for multiples of 5, an unknown id for those of 3, no answer at all for those of 7; asked again, it mends those of 2."""
    import json

    asked = json.loads(prompt)
    again = "refused_answer" in asked
    number = json.loads(asked["prompt"])["n"] if again else asked["n"]
    if number % 7 == 0 or (again and number % 11 == 0):
        raise TimeoutError("no answer")
    if again and number % 2 == 0:
        return f"Sorry. {_GOOD}"
    if number % 5 == 0:
        return "I cannot tell."
    return _GOOD.replace('"P1",', '"P9",') if number % 3 == 0 else f"```json\n{_GOOD}\n```"


@query("""SELECT c_custkey AS record_id, CASE WHEN n % 7 = 0 THEN 'call_failed' WHEN (n % 5 = 0 OR n % 3 = 0) AND NOT (n % 2 = 0 AND n % 11 <> 0) THEN CASE WHEN n % 5 = 0 THEN 'no_json_found' ELSE 'provider_id_not_in_candidate_set' END END AS rejection,
  n % 7 <> 0 AND (n % 5 = 0 OR n % 3 = 0) AND n % 11 <> 0 AS repaired, CASE WHEN n % 7 = 0 THEN 'TimeoutError: no answer' END AS error, CASE WHEN n % 7 <> 0 AND (n % 5 <> 0 OR (n % 2 = 0 AND n % 11 <> 0)) THEN 'MATCH' END AS said FROM (SELECT c_custkey, c_custkey % 500 AS n FROM customer)""")
def repaired_answers(spark, sf_dir):
    """Answers of a model that errs: refused ones are asked for once more, failed calls stay alone."""
    c = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(c.alias("record_id"), F.array(F.lit("P1")).alias("allowed"), F.array(F.lit("P1.npi")).alias("evidence"), F.to_json(F.struct((c % 500).alias("n"))).alias("prompt"))
    cache = spark.createDataFrame([], "cache_key string, answer string")
    answers, _ = adjudicate.adjudicated(asked, cache, _model, "p", "m", "v1")
    return answers.select("record_id", "rejection", "repaired", "error", F.col("answer_decision").alias("said"))
