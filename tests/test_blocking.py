"""Candidates by exact blocks without all hits: against the full join, and the queries that use them on copies with heavy keys."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_engine import DATA, plain

from rowkin import queries
from rowkin.operators import blocking

NAMES = "block_contribution block_misses block_recall candidate_counts confusion eval_tally exact_blocks fs_score pattern_tally route_decisions".split()
COPIES = 40


def _keys(spark, n, first, wide):
    draw = random.Random(n)
    rows = []
    for i in range(n):
        years = {draw.randrange(4) + d for d in ((0, 1) if wide else (0,))}
        keys = {("license", f"L{i % 301}"), *(("state_dob", f"{i % 3}|{y}") for y in years), *(("zip_name3", str(draw.randrange(5))) for _ in range(2))}
        keys |= {("phonetic_state", str(draw.randrange(40)))} if i % 4 else set()
        rows += [(i + first, b, k) for b, k in sorted(keys)]
    return spark.createDataFrame(rows, "record_id long, block string, key string")


@pytest.mark.parametrize("cap, light", [(5, 0), (5, 2), (50, 8), (50, 10**6)])
def test_best_hits_equal_the_full_join(spark, cap, light):
    left, right = _keys(spark, 150, 1000, True), _keys(spark, 400, 0, False).withColumn("ordinal", F.col("record_id") * 7919 % 10007)
    every = blocking.key_hits(left, right).join(right.select(F.col("record_id").alias("other_id"), "ordinal").distinct(), "other_id")
    want = blocking.top_k(every, ["record_id"], [F.desc(F.size("blocks")), F.asc("ordinal")], cap)
    columns = ["record_id", "other_id", "blocks", "rank"]
    got = blocking.best_hits(left, right, cap, light=light)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_a_key_that_all_rows_share(spark):
    """Ten thousand rows a side in one key are a hundred million hits; no step lists them."""
    n, one = 10_000, lambda df: df.select(F.col("id").alias("record_id"), F.lit("license").alias("block"), F.lit("L1").alias("key"))
    got = blocking.best_hits(one(spark.range(n)), one(spark.range(n)).withColumn("ordinal", -F.col("record_id")), 5)
    row = got.agg(F.count("*"), F.min("other_id"), F.max("other_id"), F.count_if(F.col("other_id") + F.col("rank") == n)).first()
    assert tuple(row) == (5 * n, n - 5, n - 1, 5 * n)


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Customers repeated with shifted keys, so that blocks hold more rows than are listed."""
    to, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    path = f"{DATA}/customer.parquet"
    source = path + "/*.parquet" if os.path.isdir(path) else path
    shift = con.execute(f"SELECT max(c_custkey) + 1 FROM read_parquet('{source}')").fetchone()[0]
    con.execute(f"COPY (SELECT * REPLACE (c_custkey + {shift} * i AS c_custkey) FROM read_parquet('{source}'), range({COPIES}) r(i)) TO '{to}/customer.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{to}/customer.parquet')")
    return con, str(to)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_where_keys_are_heavy(spark, copies, name):
    con, folder = copies
    got = queries.queries()[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert plain(got.collect()) == plain(con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["pair_vectors", "block_contribution"])
def test_row_sized_tables_are_not_broadcast(spark, name):
    """Files of records are small against their rows; joins with them must not send them through the driver."""
    plan = queries.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["block_contribution", "block_recall", "block_misses"])
def test_the_true_ones_are_told_where_candidates_are_listed(spark, name):
    """Whether a candidate is the expected row is seen in its own columns; only such rows, or none, are dealt by pairs after that."""
    plan = queries.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"= [^ ,]*expected_id", plan)
    assert name != "block_contribution" or not re.search(r"hashpartitioning\(record_id#\w+, provider_id#", plan)


def test_best_hits_of_null_ids_and_payloads(spark):
    """Records without an id keep their hits; payloads of several rows multiply them, as joins do."""
    left = spark.createDataFrame([(None, "license", "A"), (None, "state_dob", "x"), (1, "state_dob", "x"), (2, "license", "A")], "record_id long, block string, key string")
    right = spark.createDataFrame([(10 + i, i, "state_dob", "x") for i in range(12)] + [(30, 99, "license", "A")], "record_id long, ordinal long, block string, key string")
    got = sorted(map(tuple, blocking.best_hits(left, right, 3, light=8).select("record_id", "other_id", "blocks", "rank").collect()), key=str)
    of = lambda who: [(o, b, r) for w, o, b, r in got if w == who]
    assert of(2) == [(30, ["license"], 1)] and of(1) == [(10 + i, ["state_dob"], i + 1) for i in range(3)]
    assert of(None) == [(10 + i, ["state_dob"], i + 1) for i in range(3)]
    paid = blocking.best_hits(left, right, 3, spark.createDataFrame([(1, "p"), (1, "q")], "id long, more string"))
    assert sorted(map(tuple, paid.select("record_id", "other_id", "more").collect())) == sorted((1, 10 + i, m) for i in range(3) for m in "pq")
