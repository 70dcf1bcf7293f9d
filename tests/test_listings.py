"""Listings and labels on small made-up tables; the queries are held against DuckDB with all others."""

from datetime import datetime

from pyspark.sql import functions as F

from rowkin.operators import listings
from rowkin.sources import tables


def test_newest_verdict_and_weight(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    feedback = spark.createDataFrame([(1, 10, "TRUE_MATCH", at(1)), (2, 10, "FALSE_MATCH", at(2)), (3, 11, "TRUE_MATCH", at(1)), (4, 11, "FALSE_MATCH", at(1)), (5, 12, "TRUE_MATCH", at(3)), (6, 13, "TRUE_MATCH", at(3)), (7, 99, "TRUE_MATCH", at(3))], "feedback_id long, result_id long, verdict string, created_at timestamp")
    results = spark.createDataFrame([(10, 1, "NO_MATCH", True), (11, 1, "NO_MATCH", False), (12, 1, "MATCH", None), (13, 2, "NO_MATCH", True)], "result_id long, run_id long, decision string, audit_sampled boolean")
    runs = spark.createDataFrame([(1, 0.25), (2, None)], "run_id long, audit_rate double")
    got = {r["result_id"]: tuple(r)[1:] for r in listings.collected_labels(feedback, results, runs, 1).collect()}
    assert got == {10: (0, "audit", 4.0, True), 11: (0, "voluntary", 1.0, True), 12: (1, "review", 1.0, True), 13: (1, "voluntary", 1.0, False)}
    assert listings.collected_labels(feedback.limit(0), results, runs).count() == 0


def test_judged_clips_and_has_null_rates(spark):
    rows = spark.createDataFrame([(0.9, 1.2, 1.0), (0.5, 0.0, 2.0)], "confidence double, label double, weight double")
    got = listings.judged(rows, 0.8, 0.2).first()
    assert (got["n"], got["precision"], got["recall"], got["missed"], got["review_share"]) == (2, 1.0, 1.0, 0.0, round(2 / 3, 6))
    none = listings.judged(rows.withColumn("confidence", F.lit(0.5)), 0.8, 0.2).first()
    assert none["precision"] is None and none["review_share"] == 1.0


def test_stratum_without_sample_counts_as_none(spark):
    rows = spark.createDataFrame([("a", True, 1, 0, 0), ("a", False, 1, 0, 0), ("b", False, 1, 0, 0)], "s string, seen boolean, tp int, fp int, review int")
    got = listings.stratified(rows, "s", F.col("seen"), F.count("*")).first()
    assert (got["tp"], got["precision"], round(got["recall"], 9)) == (2.0, 1.0, round(2 / 3, 9))


def test_ordinals_are_dense_and_windows_have_no_gaps(spark):
    new = spark.createDataFrame([(x,) for x in (900, 3, 70000, 5, 140000)], "k long")
    assert [r["ordinal"] for r in listings.with_ordinals(new, "k", None).orderBy("k").collect()] == [0, 1, 2, 3, 4]
    assert [r["ordinal"] for r in listings.with_ordinals(new, "k", 7, width=10).orderBy("k").collect()] == [8, 9, 10, 11, 12]
    assert [r["ordinal"] for r in tables.batch(new.withColumnRenamed("k", "ordinal"), 1, 2).collect()] == [5, 900]


def test_delta_pivot_and_sets(spark):
    assert listings.config_delta({"a": 1, "r": {"x": 1, "y": 2}}, {"a": 1, "r": {"x": 3}, "z": 0}) == {"r.x": (1, 3), "r.y": (2, None), "z": (None, 0)}
    cells = spark.createDataFrame([(0.1, "fuzzy", 0.5), (0.1, "exact", 0.4), (0.2, "fuzzy", 0.3)], "level double, strategy string, f1 double")
    assert {tuple(r) for r in listings.by_strategy(cells, ["exact", "fuzzy"]).collect()} == {(0.1, 0.4, 0.5), (0.2, None, 0.3)}
    rows = spark.createDataFrame([("a", ["b", "a"]), (None, ["c"]), ("d", None)], "e string, p array<string>")
    assert [r[0] for r in rows.select(listings.expected_set(F.col("e"), F.col("p"))).collect()] == [["a", "b"], ["c"], ["d"]]
    runs, patterns = spark.createDataFrame([(1,), (2,)], "run_id long"), spark.createDataFrame([(2, "x"), (2, "y")], "run_id long, pattern string")
    assert [r[0] for r in listings.with_patterns(runs, patterns).collect()] == [2]
    assert [r["level"] for r in listings.listing(cells, "f1", "level", strategy="fuzzy").collect()] == [0.1, 0.2]
