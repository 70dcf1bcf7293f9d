"""The record and master pair that the queries link: people derived from customers by arithmetic, and a corrupted copy of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = "ROBERT WILLIAM MARGARET ELIZABETH JAMES JOHN MICHAEL CHARLES JOSEPH THOMAS ANTHONY DANIEL MATTHEW ANDREW DAVID KENNETH EDWARD GREGORY SAMUEL BARBARA SUSAN DEBORAH KATHERINE JENNIFER CYNTHIA REBECCA THERESA VICTORIA PAMELA ANGELA DOROTHY MARIA".split()
SHORT = "BOB BILL PEGGY BETH JIM JACK MIKE CHUCK JOE TOM TONY DAN MATT ANDY DAVE KEN TED GREG SAM BARB SUE DEB KATE JEN CINDY BECKY TERRY VICKY PAM ANGIE DOT MARY".split()
LAST = "THOMPSON NAKAMURA SOLBERG RIVERA HOFFMAN LINDQVIST OKAFOR PETERSEN GALLAGHER VASQUEZ WHITAKER BERGSTROM CHAUDHRY DELACRUZ FITZGERALD GUTIERREZ HENDERSON IVANOV JOHANSSON KOWALSKI LOMBARDI MCALLISTER NOVAK ORTEGA PAPADOPOULOS QUINTERO ROSENBERG SCHNEIDER TANAKA UNDERWOOD VILLANUEVA WASHINGTON XAVIER YAMAMOTO ZIMMERMAN ABERNATHY".split()


def _array(words: list[str], spark: bool) -> str:
    body = ", ".join(f"'{w}'" for w in words)
    return f"array({body})" if spark else f"[{body}]"


def sql(spark: bool) -> tuple[str, str]:
    """SELECTs of the master and of the records, for Spark or for DuckDB; integer arithmetic makes them agree."""
    at = (lambda a, i: f"element_at({a}, cast({i} as int) + 1)") if spark else (lambda a, i: f"list_extract({a}, cast({i} AS INTEGER) + 1)")
    given, short, last = (_array(w, spark) for w in (GIVEN, SHORT, LAST))
    g, s, n = f"(c_custkey * 7919) % {len(GIVEN)}", f"(c_custkey * 7919) % {len(GIVEN)}", f"(c_custkey * 104729) % {len(LAST)}"
    year = "1940 + (c_custkey * 31) % 60"
    master = f"""
SELECT c_custkey AS provider_id, {at(given, g)} AS first_name, {at(last, n)} AS last_name, c_nationkey AS state,
  {year} AS birth_year, 1 + (c_custkey * 13) % 12 AS birth_month, concat('L', cast((c_custkey * 48271) % 999983 AS string)) AS license,
  c_mktsegment AS segment FROM customer"""
    records = f"""
SELECT c_custkey + 1000000000 AS record_id, c_custkey AS expected_id,
  CASE WHEN c_custkey % 3 = 0 THEN {at(short, s)} ELSE {at(given, g)} END AS first_name,
  CASE WHEN c_custkey % 5 = 0 THEN concat(substr({at(last, n)}, 1, 2), substr({at(last, n)}, 4)) ELSE {at(last, n)} END AS last_name,
  CASE WHEN c_custkey % 7 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS state,
  CASE WHEN c_custkey % 11 = 0 THEN {year} + 1 ELSE {year} END AS birth_year, 1 + (c_custkey * 13) % 12 AS birth_month,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('L', cast((c_custkey * 48271) % 999983 AS string)) END AS license,
  c_mktsegment AS segment FROM customer"""
    if not spark:
        master, records = (q.replace("AS string)", "AS VARCHAR)") for q in (master, records))
    return master, records


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(master, records) over the customers of a folder."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return tuple(spark.sql(q.replace("FROM customer", "FROM {customer}"), customer=customers) for q in sql(True))
