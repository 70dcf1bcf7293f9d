"""The steps of the whole linkage that have a row a pair: what they join, and what they send to Python."""

from pyspark.sql import functions as F

from rowkin import storage
from rowkin.operators import blocking, compare, linkage
from rowkin.operators.normalize import normalize, stored_normal
from rowkin.schema import PROVIDERS, SANCTIONS

CAP = 5


def people(spark, schema, rows):
    """Rows of a schema from dicts; what a dict lacks is null."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def tables(spark):
    """Records with full lists of candidates, with short ones, and organizations."""
    import datetime

    crowd = [{"provider_id": f"P{i}", "ordinal": i, "first_name": "Robert", "last_name": ("Thompson", "Thomson", "Tompson")[i % 3], "dob": datetime.date(1970, 5, 1 + i % 9), "state": "TX", "zip": "78701", "address_line1": f"{i % 4} Oak St", "license_number": f"A{i}", "license_state": "TX"} for i in range(30)]
    others = [{"provider_id": "Q1", "ordinal": 100, "first_name": "Xiomara", "last_name": "Quintero", "state": "NY", "zip": "10001"}, {"provider_id": "Q2", "ordinal": 101, "organization_name": "Cedar Ridge Health LLC", "is_organization": True, "state": "OH", "zip": "44101"}]
    asks = [{"record_id": f"R{i}", "ordinal": i, "first_name": "Bob", "last_name": "Thompson", "dob": "1970-05-03", "state": "TX", "zip": "78701", "address_line1": "3 Oak Street", "license_number": f"A{i}", "license_state": "TX"} for i in range(4)]
    asks += [{"record_id": "R8", "ordinal": 8, "first_name": "Xiomara", "last_name": "Quintera", "state": "NY", "zip": "10001"}, {"record_id": "R9", "ordinal": 9, "organization_name": "Cedar Ridge Health", "is_organization": True, "state": "OH", "zip": "44101"}]
    return people(spark, PROVIDERS, crowd + others), people(spark, SANCTIONS, asks)


def rows(df):
    return sorted((r.record_id, r.provider_id, tuple(r.blocks), r["rank"], r.kind, r.cross_type, tuple(r.vector)) for r in df.collect())


def test_full_lists_are_compared_where_they_are_listed(spark, monkeypatch):
    providers, sanctions = tables(spark)
    joined, whole = [], compare.vectors
    monkeypatch.setattr(compare, "vectors", lambda found, *sides: joined.append(found) or whole(found, *sides))
    records, master, pairs = linkage.prepared(providers, sanctions, CAP)
    got = rows(pairs)
    assert {r for r, *_ in got} == {"R0", "R1", "R2", "R3", "R8", "R9"} and sum(r[0] < "R4" for r in got) == 4 * CAP
    assert {r.record_id for r in joined[0].select("record_id").distinct().collect()} == {"R8", "R9"}  # before: all
    assert got == rows(whole(blocking.candidates(records, master, CAP), records, master))


def test_stored_forms_equal_normalized_rows(spark):
    _, sanctions = tables(spark)
    plain = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert plain(stored_normal(sanctions, "record_id", "records", claims=True)) == plain(normalize(sanctions, "record_id", claims=True))


def test_pairs_go_to_python_once(spark):
    side = "named_struct('is_organization', false, 'npi', '', 'ein', '', 'name_norm', '', 'first_norm', '', 'first_raw', '', 'last_norm', {}, 'phonetic_keys', array('X'), 'dob', named_struct('year', 1, 'month', 1, 'day', 1), 'org_name_norm', '', 'org_acronym_key', '', 'dba_name_norm', '', 'dba_acronym_key', '', 'license_number', '', 'license_state', '', 'address', named_struct('line', '', 'unit', '', 'state', '', 'zip5', '', 'po_box', ''))"
    found = spark.range(3).select(F.col("id").alias("record_id"), F.expr(side.format("concat('A', id)")).alias("r"), F.expr(side.format("'B'")).alias("p"))
    plan = compare.compared(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Exchange" not in plan  # before: one for each metric


def test_staged_tables_run_no_method_that_is_too_large_to_compile(spark, monkeypatch):
    key, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(key, None)
    with storage.compiled(spark):
        seen.append(int(spark.conf.get(key)))
    assert seen == [8000] and spark.conf.get(key, None) == before
    assert storage.staged(spark.range(3), "x").count() == 3
