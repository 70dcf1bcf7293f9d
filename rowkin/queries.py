"""The engine's operators as queries over the tables of a folder, and DuckDB SQL for each that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin import people
from rowkin.functions import lexicons
from rowkin.functions import text as T
from rowkin.functions.metrics import jaro_winkler_udf, token_set_udf
from rowkin.functions.phonetics import sound_keys_udf
from rowkin.operators import blocking, compare, decide, evaluate, learn, runs, stats
from rowkin.operators.compare import with_metric
from rowkin.schema import level
from rowkin.session import ship_package

MASTER_SQL, RECORDS_SQL = people.sql(False)
WITH_PEOPLE = f"WITH master AS ({MASTER_SQL}), records AS ({RECORDS_SQL})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ship_package(spark)
    return people.load(spark, sf_dir)


# --- normalization and string joins -------------------------------------------


@query(r"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, coalesce(list_aggregate(list_transform(t, lambda x: length(x)), 'max'), 0) AS longest
FROM (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents)
""")
def norm_tokens(spark, sf_dir):
    """Words of every whole text: how many, and the longest."""
    docs = table(spark, sf_dir, "documents").withColumn("t", T.split_words(T.strip_punctuation(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.coalesce(F.array_max(F.transform("t", lambda x: F.length(x).cast("long"))), F.lit(0).cast("long")).alias("longest"))


def _names(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(" ", "first_name", "last_name").alias("value")).distinct()


TRIGRAM_SQL = """
, names_a AS (SELECT DISTINCT concat(first_name, ' ', last_name) AS v FROM records), names_b AS (SELECT DISTINCT concat(first_name, ' ', last_name) AS v FROM master)
, ga AS (SELECT v, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT v, concat('  ', replace(v, ' ', ''), ' ') AS p FROM names_a))
, gb AS (SELECT v, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT v, concat('  ', replace(v, ' ', ''), ' ') AS p FROM names_b))
, sim AS (SELECT ga.v AS a, gb.v AS b, len(list_intersect(ga.g, gb.g)) / (len(ga.g) + len(gb.g) - len(list_intersect(ga.g, gb.g)))::DOUBLE AS similarity FROM ga, gb)
, best AS (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM sim WHERE similarity >= 0.3)
"""


@query(f"{WITH_PEOPLE} {TRIGRAM_SQL} SELECT a, b, round(similarity, 9) AS similarity, CAST(rank AS INTEGER) AS rank, round(jaro_winkler_similarity(a, b), 9) AS jw FROM best WHERE rank <= 3")
def trigram_topk(spark, sf_dir):
    """For each distinct record name the three most similar master names by trigram Jaccard, with their Jaro-Winkler."""
    master, records = linked(spark, sf_dir)
    near = blocking.similar_strings(_names(records), _names(master))
    best = blocking.top_k(near, ["a"], [F.desc("similarity"), F.asc("b")], 3)
    scored = with_metric(best, jaro_winkler_udf, F.col("a"), F.col("b"), F.lit(True), "jw")
    return scored.select("a", "b", F.round("similarity", 9).alias("similarity"), "rank", F.round("jw", 9).alias("jw"))


@query("""
WITH n AS (SELECT DISTINCT p_name AS v FROM part)
SELECT x.v AS a, y.v AS b, round(jaro_winkler_similarity(x.v, y.v), 9) AS jw, CAST(levenshtein(x.v, y.v) AS INTEGER) AS edits FROM n x JOIN n y ON x.v < y.v AND substr(x.v, 1, 1) = substr(y.v, 1, 1)
""")
def jw_pairs(spark, sf_dir):
    """Jaro-Winkler and edit distance of distinct part names that begin alike."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    a, b = names.select(F.col("p_name").alias("a"), F.left("p_name", F.lit(1)).alias("k")), names.select(F.col("p_name").alias("b"), F.left("p_name", F.lit(1)).alias("k"))
    return a.join(b, "k").filter("a < b").select("a", "b", F.round(jaro_winkler_udf("a", "b"), 9).alias("jw"), F.levenshtein("a", "b").alias("edits"))


@query()
def token_set_pairs(spark, sf_dir):
    """Token-set ratio and common sound keys of distinct part names that share a word."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    words = lambda x: names.select(F.col("p_name").alias(x), F.explode(F.split("p_name", " ")).alias("w"))
    met = words("a").join(words("b"), "w").filter("a < b").select("a", "b").distinct()
    keys = names.select("p_name", sound_keys_udf("p_name").alias("keys"))
    out = met.withColumn("token_set", token_set_udf("a", "b")).join(keys.withColumnsRenamed({"p_name": "a", "keys": "ka"}), "a").join(keys.withColumnsRenamed({"p_name": "b", "keys": "kb"}), "b")
    return out.select("a", "b", "token_set", F.arrays_overlap("ka", "kb").alias("alike"))


# --- blocking --------------------------------------------------------------------


def _keys(df: DataFrame, id_col: str, query: bool) -> DataFrame:
    years = [F.col("birth_year") + d for d in ((0, -1, 1) if query else (0,))]
    parts = [
        F.array(F.when(F.col("license") != "", F.struct(F.lit("license").alias("block"), F.col("license").alias("key")))),
        F.transform(F.array(*years), lambda y: F.struct(F.lit("state_dob").alias("block"), F.concat_ws("|", F.col("state").cast("string"), y.cast("string"), F.left("last_name", F.lit(1))).alias("key"))),
        F.array(F.struct(F.lit("zip_name3").alias("block"), F.concat_ws("|", F.col("state").cast("string"), F.left("last_name", F.lit(3)), F.left("first_name", F.lit(3))).alias("key"))),
    ]
    return df.select(F.col(id_col).alias("record_id"), F.explode(F.array_compact(F.concat(*parts))).alias("k")).select("record_id", "k.block", "k.key")


BLOCKS_SQL = """
, rk AS (SELECT record_id, 'license' AS block, license AS key FROM records WHERE license <> ''
  UNION SELECT record_id, 'state_dob', concat_ws('|', state::VARCHAR, (birth_year + d)::VARCHAR, substr(last_name, 1, 1)) FROM records, (VALUES (0), (-1), (1)) y(d)
  UNION SELECT record_id, 'zip_name3', concat_ws('|', state::VARCHAR, substr(last_name, 1, 3), substr(first_name, 1, 3)) FROM records)
, mk AS (SELECT provider_id, 'license' AS block, license AS key FROM master WHERE license <> ''
  UNION SELECT provider_id, 'state_dob', concat_ws('|', state::VARCHAR, birth_year::VARCHAR, substr(last_name, 1, 1)) FROM master
  UNION SELECT provider_id, 'zip_name3', concat_ws('|', state::VARCHAR, substr(last_name, 1, 3), substr(first_name, 1, 3)) FROM master)
, hit AS (SELECT record_id, provider_id, count(DISTINCT block) AS n_blocks, string_agg(DISTINCT block, ',' ORDER BY block) AS blocks FROM rk JOIN mk USING (block, key) GROUP BY 1, 2)
, cand AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n_blocks DESC, provider_id) AS rank FROM hit)
"""


def _candidates(spark: SparkSession, sf_dir: str, cap: int = 50, asked: list[Column] | None = None, held: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and their candidates; ``asked`` and ``held``: columns of the record and of the master row that come along with a candidate."""
    master, records = linked(spark, sf_dir)
    own = lambda df, name, columns: df.filter(F.col(name).isNotNull()).select(F.col(name).alias("id"), *columns) if columns else None
    keys = _keys(master, "provider_id", False).withColumn("ordinal", F.col("record_id"))
    found = blocking.best_hits(_keys(records, "record_id", True), keys, cap, own(records, "record_id", asked), own(master, "provider_id", held))
    return records, found.withColumnRenamed("other_id", "provider_id")


@query(f"{WITH_PEOPLE} {BLOCKS_SQL} SELECT record_id, provider_id, blocks, CAST(rank AS INTEGER) AS rank FROM cand WHERE rank <= 50")
def exact_blocks(spark, sf_dir):
    """Candidates by exact blocks, adjacent birth years included, ranked by how many blocks agree."""
    found = _candidates(spark, sf_dir)[1]
    return found.select("record_id", "provider_id", F.array_join(F.array_sort("blocks"), ",").alias("blocks"), "rank")


@query("""
WITH y AS (SELECT o_custkey AS k, o_orderstatus AS s, CAST(date_part('year', o_orderdate) AS INTEGER) AS yr, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT a.k AS custkey, a.yr AS year, CAST(sum(b.n) AS BIGINT) AS near FROM y a JOIN y b ON a.k = b.k AND a.s = b.s AND abs(a.yr - b.yr) <= 1 GROUP BY 1, 2
""")
def adjacent_key_block(spark, sf_dir):
    """A band join written as an equality join: the asking side names the year and its neighbours."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    asks = per.select("custkey", "s", "year", F.explode(F.array(*(F.col("year") + d for d in (-1, 0, 1)))).alias("y"))
    return asks.join(per.select("custkey", "s", F.col("year").alias("y"), "n"), ["custkey", "s", "y"]).groupBy("custkey", "year").agg(F.sum("n").alias("near"))


@query(f"""{WITH_PEOPLE} {BLOCKS_SQL}
, t AS (SELECT segment, count(*) AS evaluated, count(c.provider_id) AS found FROM records r LEFT JOIN (SELECT * FROM cand WHERE rank <= 50) c ON r.record_id = c.record_id AND r.expected_id = c.provider_id GROUP BY ROLLUP (segment))
SELECT segment AS scenario, evaluated, found, found / evaluated::DOUBLE AS recall FROM t
""")
def block_recall(spark, sf_dir):
    """How many records have their expected master row among the candidates, by segment and in all."""
    records, found = _candidates(spark, sf_dir, asked=[F.col("expected_id")])
    truth = records.select("record_id", F.array("expected_id").alias("expected_ids"), F.col("segment").alias("scenario"))
    return evaluate.blocking_recall(truth, found.filter("provider_id = expected_id"))


@query(f"""{WITH_PEOPLE} {BLOCKS_SQL}
, e AS (SELECT unnest(string_split(blocks, ',')) AS block, r.expected_id = c.provider_id AS ok, n_blocks FROM (SELECT * FROM cand WHERE rank <= 50) c JOIN records r USING (record_id))
SELECT block, count(*) AS candidates, count(*) FILTER (WHERE ok) AS found, count(*) FILTER (WHERE ok AND n_blocks = 1) AS sole FROM e GROUP BY 1
""")
def block_contribution(spark, sf_dir):
    """What each block proposes, finds, and finds alone."""
    found = _candidates(spark, sf_dir, asked=[F.col("expected_id")])[1]
    return evaluate.contribution(found, F.col("provider_id") == F.col("expected_id"))


@query(f"""{WITH_PEOPLE} {BLOCKS_SQL}
SELECT segment AS scenario, count(*) AS missed FROM records r WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.record_id = r.record_id AND c.provider_id = r.expected_id AND c.rank <= 50) GROUP BY 1
""")
def block_misses(spark, sf_dir):
    """Records whose expected row no block proposes, by segment."""
    records, found = _candidates(spark, sf_dir, asked=[F.col("expected_id")])
    return evaluate.misses(records.select("record_id", F.array("expected_id").alias("expected_ids"), F.col("segment").alias("scenario")), found.filter("provider_id = expected_id"))


@query(f"""{WITH_PEOPLE} {BLOCKS_SQL}
, per AS (SELECT r.record_id, count(c.provider_id) AS c FROM records r LEFT JOIN (SELECT * FROM cand WHERE rank <= 50) c USING (record_id) GROUP BY 1)
, o AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM per)
SELECT (SELECT sum(c)::DOUBLE / count(*) FROM per) AS mean, (SELECT c FROM o WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95, (SELECT max(c) FROM per) AS most
""")
def candidate_counts(spark, sf_dir):
    """Mean, exact 95th percentile and maximum of candidates a record."""
    records, found = _candidates(spark, sf_dir)
    return evaluate.candidate_counts(records, found)


# --- comparison, scoring, routing ---------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of five fields in native comparisons: license, last name, first name, birth, state."""
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("first_name", "last_name", "state", "birth_year", "birth_month", "license")]
    records, p = _candidates(spark, sf_dir, asked=[F.col("expected_id"), *side("r")], held=side("m"))
    c = F.col
    lic = F.when(c("r_license") == "", 0).when(c("r_license") == c("m_license"), 2).otherwise(1)
    last = F.when(c("r_last_name") == c("m_last_name"), 2).when(F.levenshtein("r_last_name", "m_last_name") <= 1, 1).otherwise(0)
    first = F.when(c("r_first_name") == c("m_first_name"), 2).when(T.given_name(c("r_first_name"), False) == c("m_first_name"), 1).otherwise(0)
    born = F.when(c("r_birth_year") != c("m_birth_year"), 0).when(c("r_birth_month") != c("m_birth_month"), 1).otherwise(2)
    where = F.when(c("r_state") == c("m_state"), 1).otherwise(0)
    return records, p.select("record_id", "provider_id", "expected_id", F.array(*(x.cast("int") for x in (lic, last, first, born, where))).alias("vector"))


_PAIRS = ", ".join(f"('{s}', '{lexicons.NICKNAME_MAP.get(s, s)}')" for s in people.SHORT)
VECTORS_SQL = f"""
, nick(s, g) AS (VALUES {_PAIRS})
, vec AS (SELECT c.record_id, c.provider_id, r.expected_id,
    CASE WHEN r.license = '' THEN 0 WHEN r.license = m.license THEN 2 ELSE 1 END AS v1,
    CASE WHEN r.last_name = m.last_name THEN 2 WHEN levenshtein(r.last_name, m.last_name) <= 1 THEN 1 ELSE 0 END AS v2,
    CASE WHEN r.first_name = m.first_name THEN 2 WHEN k.g = m.first_name THEN 1 ELSE 0 END AS v3,
    CASE WHEN r.birth_year <> m.birth_year THEN 0 WHEN r.birth_month <> m.birth_month THEN 1 ELSE 2 END AS v4,
    CASE WHEN r.state = m.state THEN 1 ELSE 0 END AS v5
  FROM (SELECT * FROM cand WHERE rank <= 50) c JOIN records r USING (record_id) JOIN master m USING (provider_id) LEFT JOIN nick k ON r.first_name = k.s)
"""
#: Level weights of the five fields, in bits.
WEIGHTS = ((0.0, -5.0, 9.5), (-3.25, 2.5, 4.75), (-2.5, 3.0, 4.25), (-2.75, 0.5, 5.0), (-1.5, 3.5))
PRIOR_BITS = -6.0
_W = " + ".join(f"CASE v{i + 1} " + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(ws)) + " END" for i, ws in enumerate(WEIGHTS))
SCORED_SQL = f", scored AS (SELECT *, CAST({_W} AS DOUBLE) AS weight FROM vec), posted AS (SELECT *, 1 / (1 + exp(-(weight + {PRIOR_BITS}) * ln(2))) AS confidence FROM scored)"


@query(f"{WITH_PEOPLE} {BLOCKS_SQL} {VECTORS_SQL} SELECT concat_ws('', v1, v2, v3, v4, v5) AS pattern, count(*) AS n, count(*) FILTER (WHERE provider_id = expected_id) AS matches FROM vec GROUP BY 1")
def pattern_tally(spark, sf_dir):
    """Comparison vectors of all candidate pairs and how often each occurs."""
    _, p = _vectors(spark, sf_dir)
    return p.groupBy(F.array_join("vector", "").alias("pattern")).agg(F.count("*").alias("n"), F.count_if(F.col("provider_id") == F.col("expected_id")).alias("matches"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records, p = _vectors(spark, sf_dir)
    total = F.lit(0.0)
    for i, w in enumerate(WEIGHTS):
        total = total + F.element_at(F.array(*map(F.lit, w)), F.col("vector")[i] + 1)
    return records, p.withColumn("weight", total).withColumn("confidence", 1 / (1 + F.exp(-(F.col("weight") + PRIOR_BITS) * F.log(F.lit(2.0)))))


@query(f"{WITH_PEOPLE} {BLOCKS_SQL} {VECTORS_SQL} {SCORED_SQL} SELECT record_id, provider_id, weight, round(confidence, 9) AS confidence FROM posted")
def fs_score(spark, sf_dir):
    """Weight and posterior of every candidate pair under given tables."""
    return _scored(spark, sf_dir)[1].select("record_id", "provider_id", "weight", F.round("confidence", 9).alias("confidence"))


ROUTED_SQL = """
, top AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY confidence DESC, weight DESC, provider_id) AS rk FROM posted)
, agg AS (SELECT record_id, max(confidence) FILTER (WHERE rk = 1) AS c1, max(confidence) FILTER (WHERE rk = 2) AS c2, max(provider_id) FILTER (WHERE rk = 1) AS p1,
    min(rk) FILTER (WHERE v1 = 2) AS ex, count(*) FILTER (WHERE v1 = 2) AS holders FROM top WHERE rk <= 5 GROUP BY 1)
, ex AS (SELECT a.record_id, t.provider_id AS xp, t.confidence AS xc, (CASE WHEN t.v4 = 0 THEN 1 ELSE 0 END + CASE WHEN t.v5 = 0 THEN 1 ELSE 0 END + CASE WHEN t.v2 = 0 THEN 1 ELSE 0 END) AS clash FROM agg a JOIN top t ON a.record_id = t.record_id AND a.ex = t.rk)
, res AS (SELECT r.record_id, r.expected_id, r.segment,
    CASE WHEN a.c1 IS NULL THEN 'NO_CANDIDATES' WHEN holders > 0 AND (clash >= 2 OR holders > 1) THEN 'NPI_EXACT_CONFLICT' WHEN holders > 0 AND clash = 0 THEN 'NPI_EXACT'
      WHEN c1 >= 0.9 AND c1 - c2 < 0.05 THEN 'THIN_MARGIN' WHEN c1 >= 0.9 THEN 'ABOVE_ACCEPT' WHEN c1 < 0.2 THEN 'BELOW_REJECT' ELSE 'GREY_BAND' END AS reason,
    a.p1, a.c1, e.xp, e.xc FROM records r LEFT JOIN agg a USING (record_id) LEFT JOIN ex e USING (record_id))
, decided AS (SELECT *, CASE reason WHEN 'NO_CANDIDATES' THEN 'NO_MATCH' WHEN 'BELOW_REJECT' THEN 'NO_MATCH' WHEN 'NPI_EXACT' THEN 'MATCH' WHEN 'ABOVE_ACCEPT' THEN 'MATCH' ELSE 'AMBIGUOUS' END AS decision,
    CASE WHEN reason IN ('NPI_EXACT', 'NPI_EXACT_CONFLICT') THEN xp WHEN reason IN ('NO_CANDIDATES', 'BELOW_REJECT') THEN NULL ELSE p1 END AS provider_id,
    CASE WHEN reason = 'NPI_EXACT' THEN greatest(xc, 0.9) WHEN reason = 'NPI_EXACT_CONFLICT' THEN xc ELSE c1 END AS confidence FROM res)
"""


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records, p = _scored(spark, sf_dir)
    v = F.col("vector")
    clashes = F.array_compact(F.array(F.when(v[3] == 0, "dob"), F.when(v[4] == 0, "state"), F.when(v[1] == 0, "last_name")))
    p = p.select("record_id", "provider_id", F.lit(0).alias("rank"), "confidence", F.col("weight").alias("match_weight"), F.lit(False).alias("cross_type"), F.lit(0.9).alias("t_accept"), F.lit(0.2).alias("t_reject"), (v[0] == 2).alias("npi_exact"), clashes.alias("conflicts"))
    return records, decide.routed(records, decide.ranked(p))


@query(f"{WITH_PEOPLE} {BLOCKS_SQL} {VECTORS_SQL} {SCORED_SQL} {ROUTED_SQL} SELECT record_id, decision, reason, provider_id, round(confidence, 9) AS confidence FROM decided")
def route_decisions(spark, sf_dir):
    """One decision a record: exact identifiers, then accept, reject, thin margins and the grey band."""
    return _routed(spark, sf_dir)[1].select("record_id", "decision", "reason", "provider_id", F.round("confidence", 9).alias("confidence"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, done = _routed(spark, sf_dir)
    expected = F.when(F.col("expected_id") % 13 == 0, "NO_MATCH").otherwise("MATCH")
    return done.join(blocking.by_rows(records.select("record_id", "expected_id", "segment")), "record_id").withColumn("expected", expected).withColumn("scenario", F.col("segment"))


EVALUATED_SQL = ", ev AS (SELECT *, CASE WHEN expected_id % 13 = 0 THEN 'NO_MATCH' ELSE 'MATCH' END AS expected FROM decided)"


@query(f"""{WITH_PEOPLE} {BLOCKS_SQL} {VECTORS_SQL} {SCORED_SQL} {ROUTED_SQL} {EVALUATED_SQL}
, f AS (SELECT segment AS scenario, reason AS kind, decision = 'MATCH' AS hit, expected = 'MATCH' AS is_m, provider_id IS NOT DISTINCT FROM expected_id AS ok, decision FROM ev)
, g AS (SELECT kind, scenario, count(*) AS n, count(*) FILTER (WHERE hit AND is_m AND ok) AS tp, count(*) FILTER (WHERE hit AND NOT (is_m AND ok)) AS fp, count(*) FILTER (WHERE is_m AND NOT (hit AND ok)) AS fn,
    count(*) FILTER (WHERE NOT is_m AND NOT hit) AS tn, count(*) FILTER (WHERE hit AND is_m AND NOT ok) AS wrong_provider, count(*) FILTER (WHERE decision = 'AMBIGUOUS') AS ambiguous FROM f GROUP BY GROUPING SETS ((), (kind), (scenario)))
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM g
""")
def eval_tally(spark, sf_dir):
    """Confusion counts and rates in all, by reason and by segment, in one pass of grouping sets."""
    return evaluate.tally(_evaluated(spark, sf_dir).withColumn("kind", F.col("reason")))


@query(f"""{WITH_PEOPLE} {BLOCKS_SQL} {VECTORS_SQL} {SCORED_SQL} {ROUTED_SQL} {EVALUATED_SQL}
SELECT expected, count(*) FILTER (WHERE decision = 'MATCH') AS "MATCH", count(*) FILTER (WHERE decision = 'AMBIGUOUS') AS "AMBIGUOUS", count(*) FILTER (WHERE decision = 'NO_MATCH') AS "NO_MATCH" FROM ev GROUP BY 1
""")
def confusion(spark, sf_dir):
    """Expected by decided outcome."""
    return evaluate.confusion(_evaluated(spark, sf_dir))


@query()
def em_fit(spark, sf_dir):
    """Weights that expectation-maximization learns from the vectors of the whole linkage, as (kind, field, level, bits)."""
    from rowkin.schema import FIELDS

    _, pairs = _full(spark, sf_dir)
    rows = [(k, f, n, w) for k, m in learn.fit_tally(learn.pattern_tally(pairs)).items() for (f, names), ws in zip(FIELDS[k].items(), m.weights(), strict=True) for n, w in zip(names, ws, strict=True)]
    return spark.createDataFrame(rows, "kind string, field string, level string, bits double")


def _full(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records and candidate vectors of the complete engine: the derived people in the schemas of master and records."""
    from rowkin.operators import linkage

    master, records = linked(spark, sf_dir)
    text = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    shared = ["first_name", "last_name", F.concat(F.col("birth_year").cast("string"), F.lit("-"), F.lpad(F.col("birth_month").cast("string"), 2, "0"), F.lit("-15")).alias("dob"), F.concat((F.col("birth_month") * 37).cast("string"), F.lit(" Oak St")).alias("address_line1"), F.element_at(F.array(*map(F.lit, STATE_CODES)), F.col("state") + 1).alias("state"), F.lpad((F.col("state") * 701 + 10000).cast("string"), 5, "0").alias("zip"), F.col("license").alias("license_number"), F.lit("TX").alias("license_state"), F.lit(False).alias("is_organization"), *text("npi", "middle_name", "suffix", "address_line2", "city", "specialty", "organization_name", "dba_name", "ein")]
    providers = master.select(F.col("provider_id").cast("string").alias("provider_id"), F.col("provider_id").alias("ordinal"), *shared)
    sanctions = records.select(F.col("record_id").cast("string").alias("record_id"), F.col("record_id").alias("ordinal"), *shared)
    normal, _, pairs = linkage.prepared(providers, sanctions)
    return normal, pairs


STATE_CODES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO".split()


@query()
def reconcile(spark, sf_dir):
    """The complete engine on the derived people: normalize, block, compare, learn, calibrate, route."""
    from rowkin.operators import linkage

    normal, pairs = _full(spark, sf_dir)
    truth = linked(spark, sf_dir)[1].select(F.col("record_id").cast("string").alias("record_id"), F.col("expected_id").cast("string").alias("expected_id"))
    return linkage.decided(normal, pairs, linkage.fitted(pairs, truth))


# --- calibration ---------------------------------------------------------------

KNOTS = [(0.0, 0.02), (200.0, 0.1), (800.0, 0.35), (2000.0, 0.6), (6000.0, 0.9), (20000.0, 0.98)]
_LABELLED = "SELECT l.doc_id, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS w FROM labels l JOIN documents d USING (doc_id)"
_CAL = "CASE WHEN w <= 0 THEN 0.02 " + " ".join(f"WHEN w < {x1} THEN {y0} + (w - {x0}) * (({y1} - {y0}) / ({x1} - {x0}))" for (x0, y0), (x1, y1) in zip(KNOTS, KNOTS[1:])) + " ELSE 0.98 END"
CONFIDENT_SQL = f"WITH p AS (SELECT doc_id, label, round(CAST({_CAL} AS DOUBLE), 6) AS confidence FROM ({_LABELLED}))"


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("w"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), F.round(learn.calibrated(F.col("w"), KNOTS), 6).alias("confidence"))


@query(f"{CONFIDENT_SQL} SELECT * FROM p")
def calibrator_apply(spark, sf_dir):
    """Piecewise linear calibration of a score."""
    return _confident(spark, sf_dir)


@query(f"""{CONFIDENT_SQL}, b AS (SELECT least(greatest(CAST(trunc(confidence * 10) AS INTEGER), 0), 9) AS bin, count(*) AS n, round(avg(confidence), 9) AS mean_p, round(avg(label), 9) AS mean_y FROM p GROUP BY 1)
SELECT CAST(r.i AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, mean_y, round(abs(mean_p - mean_y), 8) AS gap FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i""")
def reliability_bins(spark, sf_dir):
    """Ten reliability bins, empty ones included."""
    out = evaluate.reliability(_confident(spark, sf_dir))
    return out.select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("mean_y", 9).alias("mean_y"), F.round(F.abs(F.round("mean_p", 9) - F.round("mean_y", 9)), 8).alias("gap"))


@query(f"""{CONFIDENT_SQL}, l AS (SELECT confidence AS cut, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM p GROUP BY 1)
, c AS (SELECT *, CAST(sum(n) OVER (ORDER BY cut DESC) AS BIGINT) AS n_above, CAST(sum(pos) OVER (ORDER BY cut DESC) AS BIGINT) AS pos_above FROM l)
SELECT cut, n, pos, n_above, pos_above, pos_above / n_above::DOUBLE AS precision, CAST((SELECT sum(pos) FROM l) - pos_above AS BIGINT) AS pos_below FROM c""")
def thresholds_cumulative(spark, sf_dir):
    """Precision and misses at every distinct cut."""
    return learn.cumulative_cuts(_confident(spark, sf_dir))


@query(f"""{CONFIDENT_SQL}, q AS (SELECT confidence AS c, label AS y, CAST(doc_id % 3 + 1 AS DOUBLE) AS w FROM p), l AS (SELECT c, sum(w) AS w, sum(w * y) AS pos FROM q GROUP BY 1)
, r AS (SELECT *, sum(w) OVER (ORDER BY c DESC) AS above, sum(pos) OVER (ORDER BY c DESC) AS hit, sum(pos) OVER (ORDER BY c) AS below, sum(pos) OVER () AS every, lead(c) OVER (ORDER BY c) AS nxt FROM l)
, t AS (SELECT coalesce(min(c) FILTER (WHERE hit / above >= 0.6), 1.0) AS accept, max(coalesce(nxt, c)) FILTER (WHERE (every - below) / every >= 0.9) AS up, min(c) AS least, min((every - below) / every) FILTER (WHERE (every - below) / every >= 0.9) AS rec, max(hit / above) AS best FROM r)
, z AS (SELECT accept, least(accept, coalesce(up, t.least)) AS reject, coalesce((SELECT hit / above FROM r WHERE r.c = accept AND hit / above >= 0.6), best) AS "precision", coalesce(rec, 1.0) AS recall, EXISTS (SELECT 1 FROM r WHERE hit / above >= 0.6) AS precision_met, rec IS NOT NULL AS recall_met FROM t)
SELECT accept, reject, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(coalesce((SELECT sum(w) FROM l WHERE c >= reject AND c < accept), 0.0) / (SELECT sum(w) FROM l), 9) AS grey, precision_met, recall_met FROM z""")
def threshold_choice(spark, sf_dir):
    """Accept and reject cuts on weighted rows for targets of 0.6 and 0.9, and what they achieve."""
    rows = _confident(spark, sf_dir).withColumn("w", F.col("doc_id") % 3 + 1)
    out = learn.threshold_table(rows, 0.6, 0.9, weight="w")
    return out.select("accept", "reject", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "grey")), "precision_met", "recall_met")


@query(f"{CONFIDENT_SQL} SELECT round(sum((doc_id % 3 + 1) * (confidence - label) * (confidence - label)) / sum(doc_id % 3 + 1), 9) AS brier, round(-avg(label * ln(confidence) + (1 - label) * ln(1 - confidence)), 9) AS loss FROM p")
def brier_score(spark, sf_dir):
    """Brier score of weighted rows, and log loss."""
    rows = _confident(spark, sf_dir).withColumn("w", F.col("doc_id") % 3 + 1)
    return rows.agg(F.round(evaluate.brier(weight="w"), 9).alias("brier"), F.round(learn.log_loss(), 9).alias("loss"))


@query(f"{CONFIDENT_SQL}, b AS (SELECT least(greatest(CAST(trunc(confidence * 10) AS INTEGER), 0), 9) AS bin, count(*) AS n, abs(avg(confidence) - avg(label)) AS gap FROM p GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 9) AS ece, round(max(gap), 9) AS mce FROM b")
def calibration_errors(spark, sf_dir):
    """Expected and largest calibration error."""
    out = evaluate.calibration_error(evaluate.reliability(_confident(spark, sf_dir)))
    return out.select(F.round("ece", 9).alias("ece"), F.round("mce", 9).alias("mce"))


@query(f"{CONFIDENT_SQL} SELECT count(*) AS n, round(avg(CASE WHEN confidence >= 0.7 THEN 1.0 ELSE 0 END), 9) AS accepted, round(avg(CASE WHEN confidence < 0.3 THEN 1.0 ELSE 0 END), 9) AS rejected, round(avg(confidence) FILTER (WHERE confidence >= 0.7), 9) AS expected_precision, round(sum(confidence) FILTER (WHERE confidence < 0.3) / sum(confidence), 9) AS expected_missed FROM p")
def expected_outcomes(spark, sf_dir):
    """What two cuts are expected to do, from calibrated scores alone."""
    cuts = learn.Thresholds(0.7, 0.3, 0.0, 0.0, 0.0, True, True)
    return learn.expected_shares(_confident(spark, sf_dir), cuts).select("n", *(F.round(c, 9).alias(c) for c in ("accepted", "rejected", "expected_precision", "expected_missed")))


@query("""WITH p AS (SELECT round_even(log2(greatest(d.n_chars, 1)) / 0.5, 0) * 0.5 AS x, l.quality AS y FROM labels l JOIN documents d USING (doc_id))
, lev AS (SELECT x, count(*) AS n, sum(y) AS y FROM p GROUP BY 1), ran AS (SELECT x, n, y, sum(n) OVER (ORDER BY x) AS cn, sum(y) OVER (ORDER BY x) AS cy FROM lev)
, mean AS (SELECT i.x, a.x AS a, min((b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)::DOUBLE) AS least FROM ran i JOIN ran a ON a.x <= i.x JOIN ran b ON b.x >= i.x GROUP BY 1, 2)
, fit AS (SELECT x, round(max(least), 9) AS confidence FROM mean GROUP BY 1), block AS (SELECT confidence, min(x) AS low, max(x) AS high FROM fit GROUP BY 1)
SELECT low AS weight, confidence FROM block UNION SELECT high, confidence FROM block""")
def isotonic_fit(spark, sf_dir):
    """Knots of the isotonic fit of text length against quality: at each level the largest mean from it down of the least means from it up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.log2(F.greatest(F.col("n_chars"), F.lit(1))).alias("weight"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    return spark.createDataFrame([(x, round(y, 9)) for x, y in learn.isotonic_knots(rows)], "weight double, confidence double")


# --- sampling, hashing, versions ------------------------------------------------

_SHARE = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0"


@query(f"SELECT o_orderkey, {_SHARE.format("concat('holdout:', o_orderkey::VARCHAR)")} < 0.3 AS held FROM orders")
def holdout_split(spark, sf_dir):
    """A hold-out by hash, the same on every run."""
    return table(spark, sf_dir, "orders").select("o_orderkey", (T.hash_share(F.lit("holdout:"), F.col("o_orderkey").cast("string")) < 0.3).alias("held"))


@query(f"SELECT event_id, event_type FROM events WHERE event_type <> 'purchase' AND {_SHARE.format("concat('audit:', event_id::VARCHAR)")} < 0.05")
def audit_sample(spark, sf_dir):
    """An audit sample of five in a hundred, drawn by hash."""
    return table(spark, sf_dir, "events").filter("event_type <> 'purchase'").filter(T.hash_share(F.lit("audit:"), F.col("event_id").cast("string")) < 0.05).select("event_id", "event_type")


def _snapshot_sql(name: str, columns: str) -> str:
    return f"""WITH d AS (SELECT sha256(concat_ws(chr(31), {columns})) AS d FROM {name}), b AS (SELECT substr(d, 1, 3) AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS h FROM d GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM b"""


@query(_snapshot_sql("orders", "coalesce(o_orderkey::VARCHAR, ''), coalesce(o_custkey::VARCHAR, ''), coalesce(o_orderstatus, ''), coalesce(o_orderpriority, '')"))
def snapshot_hash(spark, sf_dir):
    """A hash of a table that does not depend on row order."""
    return runs.snapshot_hash(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


def _run(orders: DataFrame, name: str) -> DataFrame:
    keep, status, price = {
        "a": (F.col("o_orderkey") % 10 != 3, F.col("o_orderstatus"), F.col("o_totalprice")),
        "b": (F.col("o_orderkey") % 10 != 7, F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))),
    }[name]
    return orders.filter(keep).select(F.col("o_orderkey").alias("record_id"), status.alias("decision"), F.col("o_custkey").alias("provider_id"), price.alias("confidence"))


RUNS_SQL = """WITH a AS (SELECT o_orderkey AS record_id, o_orderstatus AS decision, o_custkey AS provider_id, o_totalprice AS confidence FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS decision, o_custkey AS provider_id, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS confidence FROM orders WHERE o_orderkey % 10 <> 7)
, d AS (SELECT coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN a.record_id IS NULL THEN 'new' WHEN b.record_id IS NULL THEN 'removed' WHEN a.decision IS DISTINCT FROM b.decision OR a.provider_id IS DISTINCT FROM b.provider_id THEN 'decision'
  WHEN coalesce(abs(a.confidence - b.confidence) > 0.01, false) THEN 'confidence' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (record_id))"""


@query(f"{RUNS_SQL} SELECT record_id, change FROM d")
def diff_runs(spark, sf_dir):
    """What changed between two runs, record by record."""
    orders = table(spark, sf_dir, "orders")
    return runs.diff(_run(orders, "a"), _run(orders, "b")).select("record_id", "change")


@query(f"{RUNS_SQL} SELECT CASE change WHEN 'new' THEN 'unexpected' WHEN 'removed' THEN 'missing' WHEN 'unchanged' THEN 'same' ELSE 'drifted' END AS verdict, count(*) AS n FROM d GROUP BY 1")
def replay_verdicts(spark, sf_dir):
    """Verdicts of a replay against the stored run."""
    orders = table(spark, sf_dir, "orders")
    return runs.replayed(_run(orders, "a"), _run(orders, "b"), 0.01).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS record_id, o_orderkey * 2 AS result_id, CASE WHEN o_orderkey % 9 = 0 THEN 5 WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2 + 1 END AS superseded_by FROM orders""")
def supersede_current(spark, sf_dir):
    """New results replace the open ones of their records; earlier links stay."""
    orders = table(spark, sf_dir, "orders")
    current = orders.select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") * 2).alias("result_id"), F.when(F.col("o_orderkey") % 9 == 0, F.lit(5).cast("long")).alias("superseded_by"))
    new = orders.filter("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") * 2 + 1).alias("result_id"))
    return runs.supersede(current, new).select("record_id", "result_id", "superseded_by")


@query("""WITH o AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 8 <> 1),
n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 8 <> 2)
SELECT o.k, o.seg, o.nat, n.k IS NULL OR (o.seg IS NOT DISTINCT FROM n.seg AND o.nat IS NOT DISTINCT FROM n.nat) AS is_current, CAST(1 AS BIGINT) AS version FROM o LEFT JOIN n ON o.k = n.k
UNION ALL SELECT n.k, n.seg, n.nat, true, CAST(2 AS BIGINT) FROM n LEFT JOIN o ON o.k = n.k WHERE o.k IS NULL OR o.seg IS DISTINCT FROM n.seg OR o.nat IS DISTINCT FROM n.nat""")
def scd2_merge(spark, sf_dir):
    """Versioned ingestion: unchanged, retired, replaced and new rows."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    current = c.filter("k % 8 <> 1").withColumn("is_current", F.lit(True)).withColumn("version", F.lit(1).cast("long"))
    incoming = c.filter("k % 8 <> 2").withColumn("seg", F.when(F.col("k") % 5 == 0, "MOVED").otherwise(F.col("seg")))
    return runs.merge_versions(current, incoming, ["k"], ["seg", "nat"], F.lit(2).cast("long"))


# --- dashboards and listings ------------------------------------------------------


@query("SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(1, 11) r(i) LEFT JOIN (SELECT least(10, CAST(floor(l_discount * 100 * 10 / (10 * (1 + 1e-9))) AS INTEGER) + 1) AS b, count(*) AS n FROM lineitem GROUP BY 1) ON b = i")
def confidence_histogram(spark, sf_dir):
    """Ten equal bins, empty ones included."""
    return stats.histogram(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_discount") * 100), "v", 10, 0.0, 10.0)


@query("WITH c AS (SELECT coalesce(n_name, '??') AS value, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rk FROM c) SELECT CASE WHEN rk <= 8 THEN value ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def state_distribution(spark, sf_dir):
    """Customers by nation: the eight largest, and the rest as other."""
    nations = table(spark, sf_dir, "nation")
    df = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return stats.with_other(stats.distribution(df, "n_name"), 8)


for _unit in ("day", "week", "month"):

    def _volume(spark, sf_dir, unit=_unit):
        """Events by period, with sums."""
        out = stats.volume(table(spark, sf_dir, "events"), "ts", unit, purchases=(F.col("event_type") == "purchase").cast("int"))
        return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n", "purchases")

    _volume.__name__ = f"volume_{_unit}"
    query(f"SELECT strftime(date_trunc('{_unit}', ts), '%Y-%m-%d') AS period, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1")(_volume)


@query("SELECT count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_custkey) AS customers, CAST(max(o_orderkey) AS BIGINT) AS newest FROM orders")
def kpis(spark, sf_dir):
    """Tiles of counts in one pass."""
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.countDistinct("o_custkey").alias("customers"), F.max("o_orderkey").alias("newest"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'EXCLUDED' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'UNDER_REVIEW' ELSE 'CLEAR' END AS standing FROM customer""")
def compliance_exists(spark, sf_dir):
    """Standing of each master row, from two existence joins."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return stats.standing(table(spark, sf_dir, "customer").select("c_custkey"), orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderstatus = 'O'"), "c_custkey")


_QUEUE = "event_type = 'purchase' AND value >= 10 AND value <= 90 AND user_id % 5 = 2"


@query(f"SELECT event_id, user_id, value, (SELECT count(*) FROM events WHERE {_QUEUE}) AS total FROM events WHERE {_QUEUE} ORDER BY value DESC NULLS LAST, event_id LIMIT 50 OFFSET 20")
def queue_page(spark, sf_dir):
    """A page of the review queue in a total order, with the count of all its rows (a page is what is asked for)."""
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("event_type").alias("decision"), F.col("value").alias("confidence"), F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("state"))
    df = own.filter(stats.queue_filter(decision="purchase", least=10, most=90, state="S2")).select("event_id", "user_id", "value")
    return stats.counted_page(df, [F.desc_nulls_last("value"), F.asc("event_id")], 20, 50)


_RESULTS = "SELECT o_orderkey AS record_id, o_custkey AS provider_id, CASE WHEN o_orderstatus = 'P' THEN 'AMBIGUOUS' ELSE 'MATCH' END AS decision, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS superseded_by FROM orders"


@query(f"WITH r AS ({_RESULTS}), n AS (SELECT * FROM r WHERE superseded_by IS NULL AND decision = 'MATCH') SELECT record_id, provider_id, c.claims FROM n JOIN (SELECT provider_id, count(DISTINCT record_id) AS claims FROM n GROUP BY 1 HAVING count(DISTINCT record_id) > 1) c USING (provider_id)")
def conflict_members(spark, sf_dir):
    """Current results that share their provider with other records."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("record_id"), F.col("o_custkey").alias("provider_id"), F.when(F.col("o_orderstatus") == "P", "AMBIGUOUS").otherwise("MATCH").alias("decision"), F.when(k % 4 == 0, k + 1).alias("superseded_by"))
    return stats.conflict_members(rows).select("record_id", "provider_id", "claims")


@query("SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def facet_counts(spark, sf_dir):
    """Counts by value of two columns in one pass."""
    return stats.facets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    """The newest event of each user."""
    return runs.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


# --- identifiers and dates --------------------------------------------------------

_BODY = "CAST(100000000 + (CAST(c_custkey AS BIGINT) * 1237919) % 899999999 AS VARCHAR)"


@query(f"""WITH b AS (SELECT c_custkey, {_BODY} AS body FROM customer), s AS (SELECT c_custkey, body, (10 - (24 + list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(substr(body, i, 1) AS INTEGER) * 2) % 10 + (CAST(substr(body, i, 1) AS INTEGER) * 2) // 10 ELSE CAST(substr(body, i, 1) AS INTEGER) END))) % 10) % 10 AS d FROM b)
SELECT c_custkey, CAST(d AS INTEGER) AS digit, 'VALID' AS good, CASE WHEN d = 0 THEN 'VALID' ELSE 'CHECKSUM_FAIL' END AS zero, CASE WHEN c_custkey % 3 = 0 THEN 'MALFORMED' WHEN c_custkey % 3 = 1 THEN 'PLACEHOLDER_TEXT' ELSE 'SENTINEL' END AS odd FROM s""")
def npi_luhn(spark, sf_dir):
    """Check digits of ten-digit identifiers with any first digit, how the numbers with the right digit (separated in several ways) and with 0 are classified, and what is no number."""
    body = (F.lit(100000000) + (F.col("c_custkey") * 1237919) % 899999999).cast("string")
    df = table(spark, sf_dir, "customer").select("c_custkey", body.alias("body")).withColumn("digit", T.luhn_digit(F.col("body")).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, ("_", "-", ".", " ", "/", ""))), (F.col("c_custkey") % 6 + 1).cast("int"))
    good = F.concat(F.left("body", F.lit(3)), mark, F.substr("body", F.lit(4)), F.col("digit").cast("string"))
    odd = F.when(F.col("c_custkey") % 3 == 0, F.col("body")).when(F.col("c_custkey") % 3 == 1, "not_available").otherwise("0123456789")
    return df.select("c_custkey", "digit", T.npi(good)["status"].alias("good"), T.npi(F.concat("body", F.lit("0")))["status"].alias("zero"), T.npi(odd)["status"].alias("odd"))


def _code(kind: str, field: str, name: str) -> int:
    return level(kind, field, name)


def _case(field: str, kind: str, *steps: tuple[str, str], other: str) -> str:
    """SQL of a level code: the first condition that holds names the level."""
    return "CAST(CASE " + " ".join(f"WHEN {test} THEN {_code(kind, field, name)}" for test, name in steps) + f" ELSE {_code(kind, field, other)} END AS INTEGER)"


LEVELS_SQL = f"""
WITH d AS (SELECT o_orderkey AS k, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(date_part('month', o_orderdate) AS INTEGER) END AS m, CASE WHEN o_orderkey % 5 >= 3 THEN NULL ELSE CAST(date_part('day', o_orderdate) AS INTEGER) END AS d FROM orders)
, e AS (SELECT *, CASE k % 7 WHEN 2 THEN y + 1 WHEN 5 THEN NULL ELSE y END AS y2, CASE k % 7 WHEN 1 THEN d WHEN 3 THEN NULL ELSE m END AS m2, CASE k % 7 WHEN 1 THEN m WHEN 4 THEN d % 28 + 1 WHEN 6 THEN NULL ELSE d END AS d2,
  CASE WHEN k % 6 = 0 THEN concat('B', k % 2) ELSE '' END AS box, CASE WHEN k % 4 = 0 THEN 'B0' ELSE '' END AS box2, concat('L', k % 4) AS line, CASE WHEN k % 11 = 0 THEN '' ELSE concat('L', k % 3) END AS line2,
  CASE WHEN k % 13 = 0 THEN '' ELSE concat('1000', k % 3) END AS zip, CASE WHEN k % 3 = 0 THEN '10099' ELSE concat('1000', k % 2) END AS zip2, CASE WHEN k % 5 = 0 THEN 0.95 ELSE 0.5 END AS o,
  CASE WHEN k % 9 = 0 THEN '' ELSE concat('N', k % 3) END AS v, concat('N', k % 4) AS v2, CASE WHEN k % 8 = 0 THEN 'A' ELSE concat('A', k % 3) END AS f, concat('A', k % 5) AS f2, CASE WHEN k % 4 = 0 THEN 0.95 WHEN k % 4 = 1 THEN 0.86 ELSE 0.1 END AS jw FROM d)
SELECT k,
  {_case("dob", "individual", ("y IS NULL OR y2 IS NULL", "MISSING"), ("y = y2 AND m IS NOT DISTINCT FROM m2 AND d IS NOT DISTINCT FROM d2", "EXACT"), ("y = y2 AND m IS NOT NULL AND d IS NOT NULL AND m2 IS NOT NULL AND d2 IS NOT NULL AND m = d2 AND d = m2", "TRANSPOSED"), ("y <> y2", "DISAGREE"), ("m IS NULL OR m2 IS NULL", "YEAR_ONLY"), ("m = m2", "YEAR_MONTH"), other="DISAGREE")} AS dob,
  {_case("address", "individual", ("box <> '' AND box2 <> '' AND box = box2", "EXACT"), ("box <> '' AND box2 <> ''", "DISAGREE"), ("line2 = '' AND zip <> '' AND zip = zip2", "SAME_ZIP_ONLY"), ("line2 = ''", "MISSING"), ("line = line2 AND k % 2 = k % 3", "EXACT"), ("line = line2", "SAME_STREET_DIFF_UNIT"), ("o >= 0.9", "TOKEN_SET"), ("zip <> '' AND zip = zip2", "SAME_ZIP_ONLY"), other="DISAGREE")} AS address,
  {_case("zip", "individual", ("zip = ''", "MISSING"), ("zip = zip2", "ZIP5"), other="ZIP3")} AS zip_code,
  {_case("state", "individual", ("v = ''", "MISSING"), ("v = v2", "EXACT"), other="DISAGREE")} AS state,
  {_case("npi", "individual", ("v = ''", "ONE_INVALID"), ("v = v2", "VALID_EXACT"), other="VALID_DISAGREE")} AS npi,
  {_case("license", "individual", ("v = ''", "MISSING"), ("v <> v2", "DISAGREE"), ("k % 2 = k % 5", "EXACT"), other="EXACT_DIFF_STATE")} AS license,
  {_case("last_name", "individual", ("v = ''", "MISSING"), ("v = v2", "EXACT"), ("k % 10 < 2", "PHONETIC"), ("jw >= 0.92", "JW_HIGH"), ("jw >= 0.85", "JW_LOW"), other="DISAGREE")} AS last_name,
  {_case("first_name", "individual", ("f = f2", "EXACT"), ("k % 7 = 0", "NICKNAME"), ("length(f) = 1", "INITIAL"), ("jw >= 0.85", "JW_LOW"), other="DISAGREE")} AS first_name,
  {_case("legal_name", "organization", ("v = ''", "MISSING"), ("v = v2", "EXACT"), ("v = concat('N', k % 5) OR v = concat('N', k % 6)", "ACRONYM"), ("o >= 0.9", "TOKEN_SET"), ("jw >= 0.85", "JW_LOW"), other="DISAGREE")} AS legal_name,
  {_case("dba_alias", "organization", ("(line2 <> '' AND (line = line2 OR v = line2)) OR line = v2", "EXACT"), ("o >= 0.9", "TOKEN_SET"), other="DISAGREE")} AS dba_alias
FROM e
"""


@query(LEVELS_SQL)
def comparison_levels(spark, sf_dir):
    """Level codes of every comparator on made-up pairs, one an order; metrics are given."""
    k, day = F.col("k"), F.col("day")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("day"))
    text = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    none = F.lit(None).cast("int")
    y, m, d = F.year(day), F.when(k % 5 == 4, none).otherwise(F.month(day)), F.when(k % 5 >= 3, none).otherwise(F.dayofmonth(day))
    y2 = F.when(k % 7 == 2, y + 1).when(k % 7 == 5, none).otherwise(y)
    m2, d2 = F.when(k % 7 == 1, d).when(k % 7 == 3, none).otherwise(m), F.when(k % 7 == 1, m).when(k % 7 == 4, d % 28 + 1).when(k % 7 == 6, none).otherwise(d)
    date = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, ("year", "month", "day"), strict=True)))
    place = lambda box, line, unit, zip5: F.struct(box.alias("po_box"), line.alias("line"), unit.alias("unit"), zip5.alias("zip5"))
    line2, v = F.when(k % 11 == 0, "").otherwise(text("L", 3)), F.when(k % 9 == 0, "").otherwise(text("N", 3))
    a = place(F.when(k % 6 == 0, text("B", 2)).otherwise(""), text("L", 4), k % 2, F.when(k % 13 == 0, "").otherwise(text("1000", 3)))
    b = place(F.when(k % 4 == 0, "B0").otherwise(""), line2, k % 3, F.when(k % 3 == 0, "10099").otherwise(text("1000", 2)))
    side = lambda **x: F.struct(*(c.alias(n) for n, c in x.items()))
    p = side(last_norm=v, phonetic_keys=F.array(text("K", 2)), first_raw=F.when(k % 8 == 0, "A").otherwise(text("A", 3)), first_norm=text("F", 7), license_number=v, license_state=text("S", 2), org_name_norm=v, dba_name_norm=text("L", 4), org_acronym_key=F.lit(""), dba_acronym_key=F.lit(""))
    q = side(last_norm=text("N", 4), phonetic_keys=F.array(text("K", 10)), first_raw=text("A", 5), first_norm=F.lit("F0"), license_number=text("N", 4), license_state=text("S", 5), org_name_norm=text("N", 4), dba_name_norm=line2, org_acronym_key=text("N", 5), dba_acronym_key=text("N", 6))
    df = df.select("k", date(y, m, d).alias("d1"), date(y2, m2, d2).alias("d2"), a.alias("a"), b.alias("b"), p.alias("p"), q.alias("q"), F.when(k % 5 == 0, 0.95).otherwise(0.5).alias("o"), F.when(k % 4 == 0, 0.95).when(k % 4 == 1, 0.86).otherwise(0.1).alias("jw"))
    a, b, p, q, o, jw = (F.col(c) for c in ("a", "b", "p", "q", "o", "jw"))
    levels = {
        "dob": compare.birth_date(F.col("d1"), F.col("d2")),
        "address": compare.address(a, b, o),
        "zip_code": compare.zip_code(a["zip5"], b["zip5"]),
        "state": compare.state(p["last_norm"], q["last_norm"]),
        "npi": compare.identifier(p["last_norm"], q["last_norm"]),
        "license": compare.license_(p, q),
        "last_name": compare.last_name(p, q, jw),
        "first_name": compare.first_name(p, q, jw),
        "legal_name": compare.legal_name(p, q, o, jw),
        "dba_alias": compare.trade_name(p, q, [o, o, o]),
    }
    return df.select("k", *(c.cast("int").alias(n) for n, c in levels.items()))


@query("SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(date_part('month', o_orderdate) AS INTEGER) END AS m, CASE WHEN o_orderkey % 5 IN (3, 4) THEN NULL ELSE CAST(date_part('day', o_orderdate) AS INTEGER) END AS d FROM orders")
def parse_partial_date(spark, sf_dir):
    """Dates written in five ways, read back into year, month and day."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "MM/dd/yyyy")).when(kind == 2, F.date_format(day, "dd-MMM-yyyy")).when(kind == 3, F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "yyyy"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", T.partial_date(text).alias("p"))
    return df.select("o_orderkey", F.col("p.year").alias("y"), F.col("p.month").alias("m"), F.col("p.day").alias("d"))


@query("SELECT c_custkey, concat('K-', upper(substr(sha256(concat_ws(chr(31), upper(c_name), upper(c_mktsegment), c_nationkey::VARCHAR)), 1, 20))) AS record_key FROM customer")
def record_key(spark, sf_dir):
    """Keys derived from folded content."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.record_key(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("record_key"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rowkin import intake_queries, learning_queries, listing_queries, record_queries, state_queries, vector_queries, workflow_queries  # noqa: F401  (register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
