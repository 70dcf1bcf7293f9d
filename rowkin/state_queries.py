"""Queries of normal forms, searches, phases, cases, listings and baselines, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rowkin.functions import text as T
from rowkin.operators import adjudicate, decide, ingest, listings, runs, search, stats
from rowkin.plans import assistant
from rowkin.queries import query, table
from rowkin.sources import tables

#: What is written, and its normal form, by normalizer; rows take them in turn.
FORMS = {
    "ein": [("12-3456789", "12-3456789"), ("123456789", "12-3456789"), (" 12 345 6789 ", "12-3456789"), ("1234567", ""), ("", "")],
    "state": [("tx", "TX"), ("Texas", "TX"), ("Calif.", "CA"), ("NEW  YORK", "NY"), ("Mass", "MA"), ("TX 77001", "TX"), ("Nowhere", ""), ("D.C.", "DC")],
    "zip5": [("77001-1234", "77001"), ("770011234", "77001"), ("7700", ""), (" 02134 ", "02134")],
    "license_number": [("a-00123", "A123"), ("MD 0045", "MD45"), ("ABC", "ABC"), ("0000", "0000"), ("x1y02", "XY102")],
    "org": [("Cedar Ridge Health, L.L.C.", "CEDAR RIDGE HEALTH"), ("Smith & Jones Associates", "SMITH AND JONES ASSOCIATES"), ("Valley SNF", "VALLEY SKILLED NURSING FACILITY"), ("Oak P.A. Inc.", "OAK"), ("", "")],
    "legal_form": [("Cedar Ridge Health, L.L.C.", "LLC"), ("Smith & Jones Associates", ""), ("Acme Incorporated", "INC"), ("Oak P.A. Inc.", "INC"), ("Lake Company", "CO")],
    "acronym": [("CEDAR RIDGE HEALTH", "CRH"), ("THE HOUSE OF CARE", "HC"), ("SINGLE", ""), ("A B C", "BC")],
    "ordered": [("Dr. Bob Smith, MD", "ROBERT SMITH"), ("JIM O'Neil Jr", "JAMES O NEIL"), ("Élodie Müller-Lang NP", "ELODIE MULLER LANG"), ("Mary Bob", "MARIA BOB")],
    "sorted": [("Dr. Bob Smith, MD", "ROBERT SMITH"), ("Zoe Adams RN", "ADAMS ZOE"), ("Mary Bob", "BOB MARIA")],
    "given": [("Bob", "ROBERT"), ("liz", "ELIZABETH"), ("Robert", "ROBERT"), ("Xanthe", "XANTHE"), ("Peggy Sue", "MARGARET"), ("", "")],
    "npi": [("1234567893", "VALID"), ("1234567894", "CHECKSUM_FAIL"), ("0000000000", "SENTINEL"), ("n/a", "PLACEHOLDER_TEXT"), ("12345", "MALFORMED"), ("", "MISSING")],
    "year": [("7", "2007"), ("26", "2026"), ("27", "1927"), ("99", "1999"), ("1987", "1987")],
    "line": [("12 N Main St Apt 4B", "12 NORTH MAIN STREET"), ("500 Oak Blvd.", "500 OAK BOULEVARD"), ("P.O. Box 77", "P O BOX 77"), ("9 Elm Ct Suite 5", "9 ELM COURT")],
    "unit": [("12 N Main St Apt 4B", "APT 4B"), ("500 Oak Blvd.", ""), ("9 Elm Ct Suite 5", "SUITE 5")],
    "box": [("P.O. Box 77", "77"), ("500 Oak Blvd.", ""), ("PO BOX", "UNKNOWN")],
}


def _empty() -> Column:
    return F.lit(None).cast("string")


def _form(name: str, v: Column) -> Column:
    address = lambda part: T.address(v, _empty(), _empty(), _empty(), _empty())[part]
    person = lambda part: T.person_name(v, _empty(), _empty())[part]
    return {
        "ein": lambda: T.ein(v), "state": lambda: T.state(v), "zip5": lambda: T.zip5(v), "license_number": lambda: T.license_number(v), "org": lambda: T.org_name(v)["name"], "legal_form": lambda: T.org_name(v)["legal_form"],
        "acronym": lambda: T.org_acronym(v), "ordered": lambda: person("ordered"), "sorted": lambda: person("sorted"), "given": lambda: T.given_name(v), "npi": lambda: T.npi(v)["status"], "year": lambda: T.four_digit_year(v.cast("int")).cast("string"),
        "line": lambda: address("line"), "unit": lambda: address("unit"), "box": lambda: address("po_box"),
    }[name]()


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("SELECT c_custkey, " + ", ".join(f"list_extract([{', '.join(_quoted(y) for _, y in pairs)}], CAST(c_custkey % {len(pairs)} AS INTEGER) + 1) AS {name}" for name, pairs in FORMS.items()) + " FROM customer")
def normal_forms(spark, sf_dir):
    """Known answers of the normalizers, one of each a row."""
    rows = table(spark, sf_dir, "customer")
    pick = lambda pairs: F.element_at(F.array(*(F.lit(x) for x, _ in pairs)), (F.col("c_custkey") % len(pairs)).cast("int") + 1)
    raw = rows.select("c_custkey", *(pick(pairs).alias(f"_{name}") for name, pairs in FORMS.items()))
    return raw.select("c_custkey", *(_form(name, F.col(f"_{name}")).alias(name) for name in FORMS))


@query("""WITH r AS (SELECT c_custkey AS k, lower(c_name) AS name, 'R' || c_custkey AS record_id, CASE WHEN c_custkey % 2 = 0 THEN (1000000000 + c_custkey)::VARCHAR END AS npi FROM customer)
SELECT 'name' AS asked, k FROM r WHERE contains(record_id, 'Mer#00000001') OR coalesce(contains(npi, 'Mer#00000001'), FALSE) OR contains(name, 'mer#00000001') UNION ALL SELECT 'key', k FROM r WHERE contains(record_id, 'R12') OR contains(name, 'r12') UNION ALL SELECT 'npi', k FROM r WHERE coalesce(contains(npi, '00077'), FALSE) OR contains(record_id, '00077') OR contains(name, '00077')""")
def sanction_search(spark, sf_dir):
    """Records by part of the name in any case, of the key, and of the identifier."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_name").alias("organization_name"), _empty().alias("first_name"), _empty().alias("last_name"), F.concat(F.lit("R"), k.cast("string")).alias("record_id"), F.when(k % 2 == 0, (1000000000 + k).cast("string")).alias("npi"))
    out = None
    for name, asked in (("name", "Mer#00000001"), ("key", "R12"), ("npi", "00077")):
        one = rows.where(search.sanctions(asked)).select(F.lit(name).alias("asked"), "k")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, event_type LIKE 'p%' AS family, event_type = 'click' AS one, CASE WHEN event_id % 3 < 2 AND ts < TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 30 MINUTES THEN 'STALE' WHEN event_id % 3 = 0 THEN 'QUEUED' WHEN event_id % 3 = 1 THEN 'RUNNING' ELSE 'DONE' END AS status FROM events")
def audit_and_status(spark, sf_dir):
    """Audit actions by family and name, and the status of silent jobs."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").startswith("p"), F.concat(F.lit("p."), "event_type")).otherwise(F.col("event_type")).alias("action"), F.when(e % 3 == 0, "QUEUED").when(e % 3 == 1, "RUNNING").otherwise("DONE").alias("status"), F.col("ts").alias("updated_at"))
    return rows.select("event_id", search.audit("p.").alias("family"), search.audit("click").alias("one"), search.stale(F.lit("2024-01-10 12:00:00").cast("timestamp")).alias("status"))


_CASES = "SELECT o_orderkey AS case_id, o_custkey AS provider_id, o_custkey AS record_id, CASE WHEN o_orderkey % 4 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status, CAST(o_orderdate AS DATE) AS start_date FROM orders"


def _cases(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("case_id"), F.col("o_custkey").alias("provider_id"), F.col("o_custkey").alias("record_id"), F.when(k % 4 == 0, "CLOSED").otherwise("ACTIVE").alias("status"), F.to_date("o_orderdate").alias("start_date"), (k % 12).cast("int").alias("months"))
    return rows.withColumn("end_date", F.when(F.col("months") > 0, runs.case_end(F.col("start_date"), F.col("months"))))


@query(f"""WITH c AS ({_CASES}), d AS (SELECT *, CASE WHEN case_id % 12 > 0 THEN CAST(start_date + to_months(CAST(case_id % 12 AS INTEGER)) AS DATE) END AS end_date FROM c)
SELECT case_id, CASE WHEN status = 'CLOSED' THEN 'CLOSED' WHEN start_date > DATE '1996-06-01' THEN 'PENDING' WHEN end_date < DATE '1996-06-01' THEN 'EXPIRED' ELSE 'ACTIVE' END AS phase, status = 'ACTIVE' AND coalesce(end_date < DATE '1996-06-01', FALSE) AS expires FROM d""")
def case_phases(spark, sf_dir):
    """The phase of each case on a day, and which expire."""
    rows, today = _cases(spark, sf_dir), F.lit("1996-06-01").cast("date")
    gone = runs.expired(rows, today).select("case_id", F.lit(True).alias("expires"))
    return rows.withColumn("closed", F.col("status") == "CLOSED").select("case_id", runs.case_phase(today).alias("phase")).join(gone, "case_id", "left").withColumn("expires", F.coalesce("expires", F.lit(False)))


@query("""WITH a AS (SELECT o_custkey AS p, o_orderkey % 50 AS r, min(o_orderdate) AS opened FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2), live AS (SELECT DISTINCT o_custkey AS p, o_orderkey % 50 AS r FROM orders WHERE o_orderkey % 6 = 0)
, f AS (SELECT *, year(opened) AS y FROM a WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.p = a.p AND live.r = a.r)), n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY opened, r, p) AS i FROM f)
SELECT p AS provider_id, r AS record_id, strftime(CAST(opened AS DATE) + to_months(3), '%Y-%m-%d') AS end_date, y AS year FROM n""")
def opened_cases(spark, sf_dir):
    """Cases for approvals that have no active one; a repeated approval opens one."""
    orders = table(spark, sf_dir, "orders")
    pair = [F.col("o_custkey").alias("provider_id"), (F.col("o_orderkey") % 50).alias("record_id")]
    cases = orders.where("o_orderkey % 6 = 0").select(*pair, F.lit("ACTIVE").alias("status"))
    approvals = orders.where("o_orderkey % 2 = 1").select(*pair, F.col("o_orderdate").alias("opened_at"))
    used = spark.createDataFrame([(1996, 40)], "year int, last long")
    return runs.opened(cases, approvals, used).select("provider_id", "record_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), F.col("year").cast("long").alias("year"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'not_found' WHEN o_orderstatus <> 'O' THEN 'case_not_active' WHEN o_orderkey % 7 = 0 THEN 'reason_required' END AS error, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'O' AND o_orderkey % 7 <> 0 THEN 'CLOSED' WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'EXPIRED' END AS status FROM orders""")
def closed_cases(spark, sf_dir):
    """One outcome a request to close a case."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cases = orders.where("o_orderkey % 5 <> 0").select(k.alias("case_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("EXPIRED").alias("status"))
    return runs.closed(cases, orders.select(k.alias("case_id"), F.when(k % 7 == 0, "  ").otherwise("done").alias("reason"))).select(F.col("case_id").alias("k"), "error", "status")


@query("""SELECT 'status' AS what, v AS value, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(v) UNION ALL SELECT 'page', o_orderkey::VARCHAR, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) FROM (SELECT * FROM orders WHERE o_custkey = 7)
UNION ALL SELECT 'current', o_orderkey::VARCHAR, 1 FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'scoped', o_orderkey::VARCHAR, 1 FROM orders WHERE o_custkey % 4 = 2 UNION ALL SELECT 'patterns', o_custkey::VARCHAR, 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 1)""")
def listings_of_states(spark, sf_dir):
    """Counts of a closed list of states, a provider's listing, current and scoped rows, runs with patterns."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    n = F.lit(1).cast("long").alias("n")
    mine = listings.listing(orders, "o_orderdate", "o_orderkey", o_custkey=7)
    parts = [
        stats.zero_filled(orders, F.col("o_orderstatus"), ["F", "O", "P", "X"]).select(F.lit("status").alias("what"), "value", "n"),
        mine.select(F.lit("page").alias("what"), k.alias("value"), F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("n")),
        tables.current(orders.withColumn("superseded_by", F.when(F.col("o_orderkey") % 9 == 0, 1))).select(F.lit("current").alias("what"), k.alias("value"), n),
        tables.scoped(orders.withColumn("file_id", (F.col("o_custkey") % 4).cast("string")), "2").select(F.lit("scoped").alias("what"), k.alias("value"), n),
        listings.with_patterns(orders.select(F.col("o_custkey").alias("run_id")).distinct(), orders.where("o_custkey % 3 = 1").select(F.col("o_custkey").alias("run_id"), F.lit("x").alias("pattern"))).select(F.lit("patterns").alias("what"), F.col("run_id").cast("string").alias("value"), n),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'N' || o_custkey % 400 ELSE '' END AS npi FROM orders), m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_custkey % 350 ELSE '' END AS npi FROM customer WHERE c_custkey < 500)
, h AS (SELECT r.id, count(*) AS n, min(m.id) AS p FROM r JOIN m ON r.npi = m.npi AND r.npi <> '' GROUP BY 1)
SELECT r.id AS record_id, CASE WHEN n = 1 THEN 'MATCH' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS decision, p AS provider_id FROM r LEFT JOIN h USING (id)""")
def deterministic_baseline(spark, sf_dir):
    """Decisions by the identifier alone, through the dispatch of strategies."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    records = table(spark, sf_dir, "orders").select(k.alias("record_id"), F.when(k % 3 > 0, F.concat(F.lit("N"), (F.col("o_custkey") % 400).cast("string"))).otherwise("").alias("npi"))
    master = table(spark, sf_dir, "customer").where("c_custkey < 500").select(c.alias("record_id"), F.when(c % 2 == 0, F.concat(F.lit("N"), (c % 350).cast("string"))).otherwise("").alias("npi"))
    return decide.decided_by("deterministic", records, master, None)


@query("""WITH p AS (SELECT l_orderkey AS r, l_suppkey * 10 + l_linenumber AS p, max(round((l_partkey % 100) / 100.0::DOUBLE, 2)) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s DESC, p) AS i FROM p)
SELECT o_orderkey AS record_id, CASE WHEN s >= 0.88 THEN 'MATCH' WHEN s >= 0.7 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS decision, CASE WHEN s >= 0.7 THEN p END AS provider_id, s AS score FROM orders LEFT JOIN b ON o_orderkey = r AND i = 1""")
def banded_baseline(spark, sf_dir):
    """The best pair's score against two cuts."""
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("provider_id")).agg(F.max(F.round((F.col("l_partkey") % 100) / 100.0, 2)).alias("score"))
    return decide.banded(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id")), pairs)


@query("""SELECT c_custkey, 'K-' || upper(substr(sha256(concat_ws(chr(31), 'board', lower(c_mktsegment), 'x y', '', CASE WHEN c_custkey % 2 = 0 THEN (c_custkey)::VARCHAR ELSE '' END, '', 'tx', CASE WHEN c_custkey % 3 = 0 THEN '2024-05-0' || (1 + c_custkey % 9) ELSE '' END)), 1, 20)) AS record_key FROM customer""")
def derived_keys(spark, sf_dir):
    """Keys of uploaded rows that bring none."""
    k = F.col("c_custkey")
    cells = {"last_name": F.concat(F.lit("  "), "c_mktsegment"), "first_name": F.lit("X   y "), "organization_name": _empty(), "npi": F.when(k % 2 == 0, k.cast("string")), "dob": _empty(), "state": F.lit("TX"), "exclusion_date": F.when(k % 3 == 0, F.to_date(F.concat(F.lit("2024-05-0"), (1 + k % 9).cast("string"))))}
    return table(spark, sf_dir, "customer").select("c_custkey", ingest.derived_key(F.lit(" Board "), lambda name: cells[name]).alias("record_key"))


@query("""WITH rec AS (SELECT c_custkey AS record_id, CASE WHEN c_custkey % 3 = 0 THEN 'Org ' || c_custkey WHEN c_custkey % 3 = 1 THEN 'Ann Lee' END AS subject FROM customer)
SELECT 'matches' AS view, o_orderkey AS k, subject AS name, NULL AS phase FROM orders JOIN rec ON o_custkey = record_id WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 'cases', p_partkey, NULL, CASE WHEN p_size % 3 = 0 AND DATE '2024-01-01' + CAST(p_size AS INTEGER) > DATE '2024-01-20' THEN 'PENDING' WHEN p_size % 3 = 0 THEN 'ACTIVE' ELSE 'CLOSED' END FROM part
UNION ALL SELECT 'providers', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Bo B Ray Jr' END, NULL FROM supplier UNION ALL SELECT 'sanctions', record_id, subject, NULL FROM rec UNION ALL SELECT 'runs', n_nationkey, 'v' || n_regionkey, NULL FROM nation""")
def assistant_views(spark, sf_dir):
    """The five views that questions may read: current rows, names in one column, phases, versions of configs."""
    text = lambda name: _empty().alias(name)
    k, c, s = F.col("o_orderkey"), F.col("c_custkey"), F.col("s_suppkey")
    matches = table(spark, sf_dir, "orders").select(k.alias("result_id"), F.col("o_custkey").alias("record_id"), F.when(k % 4 == 0, k + 1).alias("superseded_by"))
    sanctions = table(spark, sf_dir, "customer").select(c.alias("record_id"), F.lit("A").alias("source_authority"), F.when(c % 3 == 0, F.concat(F.lit("Org "), c.cast("string"))).alias("organization_name"), F.when(c % 3 == 1, "Ann").alias("first_name"), text("middle_name"), F.when(c % 3 == 1, "Lee").alias("last_name"), text("suffix"), F.lit(False).alias("is_organization"), text("npi"), text("state"), text("sanction_type"), F.lit(None).cast("date").alias("exclusion_date"), F.lit(None).cast("date").alias("reinstatement_date"))
    cases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") % 3 == 0, "ACTIVE").otherwise("CLOSED").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("start_date"))
    named = lambda value: F.when(s % 2 == 1, value)
    providers = table(spark, sf_dir, "supplier").select(s.alias("provider_id"), F.when(s % 2 == 0, F.col("s_name")).alias("organization_name"), named("Bo").alias("first_name"), named("B").alias("middle_name"), named("Ray").alias("last_name"), named("Jr").alias("suffix"), text("npi"), F.lit(False).alias("is_organization"), text("city"), text("state"), text("specialty"), text("status"))
    own_runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_regionkey").alias("config_id"))
    configs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("config_id"), F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("version"))
    views = assistant.views(matches, sanctions, cases, providers, own_runs, configs, F.lit("2024-01-20").cast("date"))
    show = lambda view, key, name=None, phase=None: views[f"assistant_{view}"].select(F.lit(view).alias("view"), F.col(key).cast("long").alias("k"), (_empty() if name is None else name).alias("name"), (_empty() if phase is None else phase).alias("phase"))
    parts = [show("matches", "result_id", F.col("subject_name")), show("cases", "case_id", phase=F.col("phase")), show("providers", "provider_id", F.col("full_name")), show("sanctions", "record_id", F.col("subject_name")), show("runs", "run_id", F.col("config_version"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN (user_id * 2.5 + event_id % 100 * 10.0) / 1000000 WHEN 1 THEN (user_id * 0.15 + event_id % 100 * 0.6) / 1000000 ELSE 0 END::DOUBLE, 12) AS cost FROM events")
def call_costs(spark, sf_dir):
    """Prices of calls; an unknown model costs nothing."""
    e = F.col("event_id")
    model = F.when(e % 3 == 0, "large").when(e % 3 == 1, "small").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", F.round(adjudicate.cost(model, F.col("user_id"), e % 100, {"large": (2.5, 10.0), "small": (0.15, 0.6)}), 12).alias("cost"))


@query("""WITH a AS (SELECT o_orderkey AS record_id, 'prompt ' || o_custkey % 40 AS prompt, sha256('p' || chr(31) || 'm' || chr(31) || 'v1' || chr(31) || 'prompt ' || o_custkey % 40) AS cache_key, o_custkey % 40 AS n FROM orders)
SELECT record_id, cache_key, CASE WHEN n % 3 = 0 THEN 'stored ' || n ELSE 'PROMPT ' || n END AS answer FROM a""")
def cached_answers(spark, sf_dir):
    """Answers from the cache, and of the model for prompts that it lacks, each asked once."""
    n = F.col("o_custkey") % 40
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("prompt "), n.cast("string")).alias("prompt"))
    stored = table(spark, sf_dir, "orders").select(n.alias("n")).distinct().where("n % 3 = 0").select(adjudicate.cache_key("p", "m", "v1", F.concat(F.lit("prompt "), F.col("n").cast("string"))).alias("cache_key"), F.concat(F.lit("stored "), F.col("n").cast("string")).alias("answer"))
    return adjudicate.answered(asked, stored, str.upper, "p", "m", "v1")[0].select("record_id", "cache_key", "answer")


@query("SELECT o_orderkey AS entity_id, 'case.closed' AS action, 'case' AS entity_type, 'system' AS actor, '{\"status\":\"' || o_orderstatus || '\"}' AS before, '{\"status\":\"CLOSED\",\"by\":' || o_custkey || '}' AS after FROM orders")
def audit_log(spark, sf_dir):
    """Rows of the audit log for a batch of changes."""
    rows = table(spark, sf_dir, "orders")
    out = tables.audit_rows(rows, "case.closed", "case", F.col("o_orderkey"), F.struct(F.col("o_orderstatus").alias("status")), F.struct(F.lit("CLOSED").alias("status"), F.col("o_custkey").alias("by")))
    return out.withColumn("entity_id", F.col("entity_id").cast("long"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_custkey % 5 END AS one FROM orders)
SELECT o_orderkey, concat_ws(',', one, CASE WHEN o_orderkey % 3 = 0 AND one IS DISTINCT FROM 'P1' THEN 'P1' END, CASE WHEN o_orderkey % 3 = 0 AND one IS DISTINCT FROM 'P0' THEN 'P0' END) AS expected FROM r""")
def expected_sets(spark, sf_dir):
    """Expected master rows of each record: the named one, then those of its scenario, once each."""
    k = F.col("o_orderkey")
    one = F.when(k % 2 == 0, F.concat(F.lit("P"), (F.col("o_custkey") % 5).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(listings.expected_set(one, F.when(k % 3 == 0, F.array(F.lit("P1"), F.lit("P0")))), ",").alias("expected"))
