"""The generated master, records and truth."""

from pyspark.sql import functions as F

from rowkin import schema
from rowkin.functions import text as T
from rowkin.operators import generate


def test_same_on_every_run(spark):
    one, two = (generate.sanctions(spark, 300, 500, 0.5)[0] for _ in range(2))
    assert one.exceptAll(two.repartition(3)).count() == 0 and one.columns == [c.split()[0] for c in schema.SANCTIONS.split(", ")]
    assert one.exceptAll(generate.sanctions(spark, 300, 500, 0.5, seed=1)[0]).count() > 250


def test_providers(spark):
    df = generate.providers(spark, 500)
    assert df.filter(T.npi(F.col("npi"))["status"] == "VALID").count() == 500 == df.select("npi").distinct().count()
    rows = {r["ordinal"]: r for r in df.collect()}
    assert rows[11]["last_name"] == rows[10]["last_name"] and rows[11]["dob"] == rows[10]["dob"] and rows[11]["address_line1"] == rows[10]["address_line1"]
    assert rows[13]["first_name"] == rows[12]["first_name"] and rows[13]["suffix"] == "JR" and rows[13]["dob"].year == rows[12]["dob"].year + 28
    assert rows[17]["organization_name"] == rows[16]["organization_name"] and rows[17]["npi"] != rows[16]["npi"]


def test_clean_records_are_their_providers(spark):
    records, truth = generate.sanctions(spark, 400, 500, 0.0)
    df = records.join(truth, F.col("record_id") == F.col("sanction_record_id")).join(generate.providers(spark, 500).select(F.col("provider_id").alias("expected_provider_id"), F.col("npi").alias("own"), F.col("last_name").alias("surname")), "expected_provider_id", "left")
    assert df.filter("expected_outcome = 'MATCH' and not (npi <=> own and last_name <=> surname)").count() == 0
    assert 0.08 < df.filter("expected_outcome = 'NO_MATCH'").count() / 400 < 0.25
    assert generate.inspected(records, truth).agg(F.sum("n")).first()[0] == 400
