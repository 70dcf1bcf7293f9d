"""The workbook data source: round trips, caps, failures while writing."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from rowkin.sources import workbook, workbook_source

SCHEMA = "authority string, record_id string, last_name string, n double, excluded date, active boolean"
ROWS = [("Board <A>", f"r{k}", None if k == 3 else f"Name {k} & <Söhne> \x01", float(k) if k % 2 else k + 0.5, date(2024, 1, 1 + k), k % 2 == 0) for k in range(9)] + [("State", "s1", "  Two  words ", None, None, None)]


@pytest.fixture()
def source(spark):
    workbook_source.register(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


def cells(df):
    return {(os.path.basename(r.path), r.row): [c and (c.text, c.kind) for c in r.cells] for r in df.collect()}


def test_round_trip_with_own_headers(spark, source, tmp_path):
    path = str(tmp_path / "books")
    options = {"fileColumn": "authority", "header.record_id": "RECKEY", "header.last_name": "LASTNAME", "title": "Exclusions"}
    source.repartition(2, "authority").sortWithinPartitions("authority", "record_id").write.format("workbook").options(**options).mode("overwrite").save(path)
    names = sorted(os.listdir(path))
    assert [n.split("-")[0] for n in names] == ["board_a", "state"]
    got = cells(spark.read.format("workbook").load(path))
    book = names[0]
    assert got[book, 1] == [("RECKEY", "s"), ("LASTNAME", "s"), ("n", "s"), ("excluded", "s"), ("active", "s")]
    assert got[book, 2] == [("r0", "s"), ("Name 0 & <Söhne>", "s"), ("0.5", "n"), ("2024-01-01", "s"), ("Y", "s")]
    assert got[book, 3][2:] == [("1", "n"), ("2024-01-02", "s"), ("N", "s")] and got[book, 5][1] is None
    assert got[names[1], 2] == [("s1", "s"), ("Two  words", "s")] and len(got) == 12
    by_blob = cells(workbook.workbooks(spark, path))
    assert {k[1]: v for k, v in by_blob.items() if k[0] == book} == {k[1]: v for k, v in got.items() if k[0] == book}
    headers, rows = workbook.sheet(spark.read.format("workbook").load(path), f"{path}/{book}")
    assert headers == ["RECKEY", "LASTNAME", "n", "excluded", "active"] and rows.count() == 9


def test_equal_rows_give_equal_files(spark, source, tmp_path):
    blobs = []
    for n in "ab":
        source.coalesce(1).write.format("workbook").mode("overwrite").save(str(tmp_path / n))
        (file,) = os.listdir(tmp_path / n)
        blobs.append((tmp_path / n / file).read_bytes())
    assert blobs[0] == blobs[1]


def test_cap_is_checked_while_reading(spark, source, tmp_path):
    path = str(tmp_path / "b")
    source.coalesce(1).write.format("workbook").mode("overwrite").save(path)
    assert spark.read.format("workbook").option("maxRows", 10).load(path).count() == 11
    with pytest.raises(Exception, match="more than 9 rows"):
        spark.read.format("workbook").option("maxRows", 9).load(path).count()


def test_full_sheets_begin_another_file(spark, source, tmp_path):
    path = str(tmp_path / "b")
    source.coalesce(1).write.format("workbook").option("maxRows", 4).mode("overwrite").save(path)
    assert len(os.listdir(path)) == 3
    assert spark.read.format("workbook").load(path).count() == 13  # a header a file


def test_append_keeps_and_overwrite_replaces(spark, source, tmp_path):
    path = str(tmp_path / "b")
    for _ in range(2):
        source.coalesce(1).write.format("workbook").mode("append").save(path)
    assert len(os.listdir(path)) == 2
    source.limit(0).write.format("workbook").mode("overwrite").save(path)
    assert [n for n in os.listdir(path) if n.endswith(".xlsx")] == []


def test_failed_write_leaves_the_old_files(spark, source, tmp_path):
    path = str(tmp_path / "b")
    source.coalesce(1).write.format("workbook").mode("overwrite").save(path)
    before = os.listdir(path)
    broken = source.repartition(3).withColumn("n", F.when(F.col("record_id") == "r4", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("workbook").mode("overwrite").save(path)
    assert os.listdir(path) == before


def test_rows_of_any_shape_are_kept(spark, tmp_path):
    """Short, long and junk rows come as they are; ingestion judges them."""
    workbook_source.register(spark)
    book = workbook_source._Book(open(tmp_path / "odd.xlsx", "wb"), "x", ["Key", "Name", "State"])
    for row in (["only", "two"], [f"e{k}" for k in range(6)], ["=SUM(A1:A9)", 12345, None], [None, None, None], ["k", "n", "TX"]):
        book.row(row)
    book.close()
    got = cells(spark.read.format("workbook").load(str(tmp_path / "odd.xlsx")))
    assert [len(got["odd.xlsx", k]) for k in (1, 2, 3)] == [3, 2, 6] and got["odd.xlsx", 4][:2] == [("=SUM(A1:A9)", "s"), ("12345", "n")]
    assert ("odd.xlsx", 5) not in got and got["odd.xlsx", 6][2] == ("TX", "s")
    assert spark.read.format("workbook").load(str(tmp_path)).count() == 5
