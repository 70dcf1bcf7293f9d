"""Queries of ingestion, adjudication, listings and streams, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.operators import adjudicate, ingest, search
from rowkin.queries import query, table
from rowkin.sources.tables import absent
from rowkin.streaming import streams

HEADERS = ["RecKey", "LName", "ST", "ExclDate"]


def _cell(text, kind: str = "s"):
    return F.when(text.isNotNull(), F.struct(text.alias("text"), F.lit(kind).alias("kind")))


@query("""
WITH b AS (SELECT o_orderkey AS k, concat('R', o_custkey) AS record_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 <> 0 THEN 'TX' END AS state,
    CASE WHEN o_orderkey % 13 = 0 THEN 'row has 1 cell(s) beyond the last header column' WHEN o_orderkey % 17 = 0 THEN 'a cell holds a spreadsheet formula, not data' WHEN o_orderkey % 11 = 0 THEN 'row has no last name or organization name' END AS reason FROM orders)
, f AS (SELECT record_id, min(k) AS first FROM b WHERE reason IS NULL GROUP BY 1)
SELECT b.k AS "row", b.record_id, state, strftime(day, '%Y-%m-%d') AS exclusion_date, CASE WHEN state IS NULL THEN 1 ELSE 0 END AS n_warnings, CASE WHEN reason IS NULL AND k > first THEN concat('record key ''', record_id, ''' already used by row ', first) ELSE reason END AS reason FROM b LEFT JOIN f USING (record_id)
""")
def ingest_rows(spark, sf_dir):
    """Rows of a file with proposed mapping: accepted, refused with a reason, or with warnings; the first row of a key stays."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.when(k % 17 == 0, "=1+1").when(k % 11 != 0, F.concat(F.lit("Name "), F.col("o_orderpriority")))
    when = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "MMM d, yyyy"))
    more = F.when(k % 13 == 0, F.lit("beyond"))
    cells = F.array(_cell(F.concat(F.lit("R"), F.col("o_custkey").cast("string"))), _cell(name), _cell(F.when(k % 7 == 0, "Texas").otherwise("tx")), _cell(when), _cell(more))
    rows = table(spark, sf_dir, "orders").select(k.alias("row"), cells.alias("cells"))
    mapping = {field: header for field, (header, _) in ingest.proposed(HEADERS).items()}
    out = ingest.parsed(rows, HEADERS, mapping, "LIST")
    return out.select("row", "record_id", "state", F.date_format("exclusion_date", "yyyy-MM-dd").alias("exclusion_date"), F.size("warnings").alias("n_warnings"), "reason")


@query("""
WITH c AS (SELECT c_custkey AS k, 'name' AS header, c_name AS t FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END FROM customer)
, g AS (SELECT header, t, count(*) AS n, min(k) AS f FROM c WHERE t IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY f) AS i FROM g)
SELECT header, CAST(sum(n) AS BIGINT) AS filled, string_agg(t, '|' ORDER BY i) FILTER (WHERE i <= 3) AS samples FROM r GROUP BY 1
""")
def column_profile(spark, sf_dir):
    """Filled cells and first distinct samples of each column."""
    df = table(spark, sf_dir, "customer")
    rows = df.select(F.col("c_custkey").alias("row"), F.array(_cell(F.col("c_name")), _cell(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))).alias("cells"))
    return ingest.profile(rows, ["name", "segment"]).select("header", "filled", F.array_join("samples", "|").alias("samples"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def insert_if_absent(spark, sf_dir):
    """Keys that a store lacks, once each."""
    stored = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("user_id"))
    return absent(table(spark, sf_dir, "events").select("user_id"), stored, ["user_id"])


@query("""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'no_json_found' WHEN 1 THEN 'schema_validation_failed' WHEN 2 THEN 'confidence_out_of_range' WHEN 3 THEN 'decision_match_without_provider_id' WHEN 4 THEN 'provider_id_not_in_candidate_set' WHEN 5 THEN 'cited_evidence_not_supplied' END AS rejection FROM customer
""")
def adjudication_checks(spark, sf_dir):
    """Answers of a model held against what it was given: every kind of rejection."""
    head = '{"decision": "%s", "provider_id": %s, "confidence": %s, "evidence_cited": ["%s"], "reasoning": "r"}'
    answers = ["I can't say.", '{"decision": "YES"}', head % ("MATCH", '"P1"', "7", "P1.dob"), head % ("MATCH", "null", "0.9", "P1.dob"), head % ("MATCH", '"P9"', "0.9", "P1.dob"), head % ("MATCH", '"P1"', "0.9", "P1.shoe"), "```json\n" + head % ("MATCH", '"P1"', "0.9", "P1.dob") + "\n```"]
    text = F.element_at(F.array(*map(F.lit, answers)), (F.col("c_custkey") % 7 + 1).cast("int"))
    df = table(spark, sf_dir, "customer").select("c_custkey", text.alias("answer"), F.array(F.lit("P1"), F.lit("P2")).alias("allowed"), F.array(F.lit("P1.dob"), F.lit("P1.state")).alias("evidence"))
    return adjudicate.validated(df).select("c_custkey", "rejection")


@query("SELECT c_custkey FROM customer WHERE contains(upper(c_name), 'ER#00000001') OR c_custkey::VARCHAR = '17'")
def directory_search(spark, sf_dir):
    """Master rows by part of the folded name."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("provider_id"), F.lit(None).cast("string").alias("npi"), F.col("c_name").alias("organization_name"), F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"))
    return df.filter(search.providers("er#00000001") | search.providers("17") & (F.col("provider_id") == "17")).select("c_custkey")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY 1")
def stream_volume(spark, sf_dir):
    """Events by day, counted by a stream that runs until it has caught up."""
    events = streams.arrivals(spark, f"{sf_dir}/events*.parquet")
    return streams.caught_up(streams.volume(events, "ts", "1 day"), "volume").select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n")
