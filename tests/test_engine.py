"""Scalar tables, decisions and the queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rowkin import queries
from rowkin.functions import text as T
from rowkin.functions.metrics import jaro_winkler, token_set
from rowkin.functions.phonetics import sound_keys
from rowkin.operators import decide, learn, runs

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def values(spark, expression, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_fold(spark):
    assert values(spark, T.fold, [None, "  ", "Smith", "  Jose   Garcia ", "Muñoz", "O'Brien", "a\tb\nc"]) == ["", "", "SMITH", "JOSE GARCIA", "MUNOZ", "O'BRIEN", "A B C"]
    assert values(spark, T.tokens, ["  Mary-Jane  O'Neill "]) == [["MARY", "JANE", "O", "NEILL"]]


def test_dates(spark):
    got = [tuple(v) for v in values(spark, T.partial_date, ["1973-10-16", "10/16/1973", "16-OCT-1973", "19731016", "10-16-73", "October 16, 1973", "16/10/1973", "OCT 1973", "10/1973", "1973", "", None, "not a date"])]
    assert got == [(1973, 10, 16)] * 7 + [(1973, 10, None)] * 2 + [(1973, None, None)] + [(None, None, None)] * 3


def test_names_and_places(spark):
    assert values(spark, T.given_name, ["Bob", "Robert", "Peggy", "Xiomara", None]) == ["ROBERT", "ROBERT", "MARGARET", "XIOMARA", ""]
    assert [tuple(v) for v in values(spark, T.org_name, ["Cedar Ridge Health, L.L.C.", "Smith & Jones Associates", "Oak P.A.", "Valley SNF"])] == [("CEDAR RIDGE HEALTH", "LLC"), ("SMITH AND JONES ASSOCIATES", ""), ("OAK", "PA"), ("VALLEY SKILLED NURSING FACILITY", "")]
    assert values(spark, T.state, ["TX", "Texas", "Calif", "new york", "N Carolina", "D.C.", "Narnia"]) == ["TX", "TX", "CA", "NY", "NC", "DC", ""]
    assert values(spark, T.license_number, ["A-012345", "  a012345 ", "38-01388"]) == ["A12345", "A12345", "3801388"]
    assert values(spark, T.ein, ["12-3456789", "1234567"]) == ["12-3456789", ""]
    row = spark.range(1).select(T.address(F.lit("123 N Oak St"), F.lit("Suite 300"), F.lit("Austin"), F.lit("Texas"), F.lit("78701-1234")).alias("a")).first()["a"]
    assert tuple(row) == ("123 NORTH OAK STREET", "SUITE 300", "123", "AUSTIN", "TX", "78701", "")


def test_npi(spark):
    got = [v["status"] for v in values(spark, T.npi, ["1234567893", " 1234567893 ", "1234-567-893", None, "  ", "0000000000", "1234567890", "UNKNOWN", "n/a", "-", "12345", "1234567894"])]
    assert got == ["VALID"] * 3 + ["MISSING"] * 2 + ["SENTINEL"] * 2 + ["PLACEHOLDER_TEXT"] * 3 + ["MALFORMED", "CHECKSUM_FAIL"]


def test_trigrams(spark):
    assert [sorted(v) for v in values(spark, T.trigrams, ["SMITH", "", None])] == [sorted(["  S", " SM", "SMI", "MIT", "ITH", "TH "]), [], []]


@pytest.mark.parametrize("pair", "Smith/Smyth Wright/Rite Knight/Night Philips/Filips Catherine/Katherine Gonzalez/Gonzales Jackson/Jaxon Meyer/Meier Carlson/Karlson Rodgers/Rogers".split())
def test_sounds_alike(pair):
    a, b = pair.split("/")
    assert set(sound_keys(a)) & set(sound_keys(b))


def test_metrics():
    assert not set(sound_keys("Smith")) & set(sound_keys("Jones")) and sound_keys("12345") == ()
    assert jaro_winkler("", "A") == 0 and jaro_winkler("THOMPSON", "THOMSON") >= 0.92 > jaro_winkler("THOMPSON", "THOMLINSON") >= 0.85
    assert token_set("OAK STREET 14", "14 OAK STREET") == 1 and token_set("A", None) == 0


def test_em_recovers_share():
    import numpy as np

    rng = np.random.default_rng(4242)
    sizes = [4, 6, 6, 6, 6, 3, 4, 4]
    match = rng.random(20000) < 0.08
    draw = lambda s, up: rng.choice(s, p=(2.0 ** np.arange(s))[:: 1 if up else -1] / (2.0**s - 1))
    rows = [tuple(int(draw(s, m)) for s in sizes) for m in match]
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    model = learn.fit("individual", [(list(v), n) for v, n in sorted(counts.items())])
    assert abs(model.share - match.mean()) < 0.01
    assert all(w[-1] > w[0] for w in model.weights())
    with pytest.raises(learn.Degenerate):
        learn.fit("individual", [([0] * 8, 10)])


def test_kind_with_few_pairs_is_refused(spark):
    rows = [("individual", [i % 2] * 8, 100) for i in range(2)] + [("organization", [0] * 12, 3)]
    with pytest.raises(learn.Degenerate, match="organization"):
        learn.fit_tally(spark.createDataFrame(rows, "kind string, vector array<int>, n long"))


def test_routes(spark):
    records = spark.createDataFrame([(i,) for i in range(1, 8)], "record_id int")
    schema = "record_id int, provider_id int, rank int, confidence double, match_weight double, cross_type boolean, t_accept double, t_reject double, npi_exact boolean, conflicts array<string>"
    pair = lambda r, p, c, exact=False, clash=(): (r, p, 0, c, c, False, 0.7, 0.3, exact, list(clash))
    rows = [pair(1, 1, 0.9, True), pair(2, 1, 0.9, True, ["dob", "state"]), pair(3, 1, 0.9), pair(3, 2, 0.88), pair(4, 1, 0.9), pair(5, 1, 0.5), pair(6, 1, 0.1)]
    got = {r.record_id: (r.decision, r.reason) for r in decide.routed(records, decide.ranked(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: ("MATCH", "NPI_EXACT"), 2: ("AMBIGUOUS", "NPI_EXACT_CONFLICT"), 3: ("AMBIGUOUS", "THIN_MARGIN"), 4: ("MATCH", "ABOVE_ACCEPT"), 5: ("AMBIGUOUS", "GREY_BAND"), 6: ("NO_MATCH", "BELOW_REJECT"), 7: ("NO_MATCH", "NO_CANDIDATES")}


def test_snapshot_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, v string")
    one, two = (runs.snapshot_hash(x, ["k", "v"]).first() for x in (df, df.orderBy(F.desc("k")).withColumn("v", F.coalesce("v", F.lit("")))))
    assert one == two and one != runs.snapshot_hash(df.filter("k < 3"), ["k", "v"]).first()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert plain(got.collect()) == plain(duck.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_partial_dates_and_addresses_compare_as_told(spark):
    from pyspark.sql import functions as F

    from rowkin.operators import compare
    from rowkin.schema import INDIVIDUAL

    place = "named_struct('po_box', {!r}, 'line', {!r}, 'unit', {!r}, 'zip5', {!r})"
    rows = [
        (("B1", "", "", "10001"), ("B2", "", "", "10001"), 0.0, "DISAGREE"),
        (("", "1 OAK", "", "10001"), ("", "1 OAK", "", "20001"), 0.0, "EXACT"),
        (("", "1 OAK", "", "10001"), ("", "OAK 1", "", "20001"), 0.95, "TOKEN_SET"),
    ]
    for a, b, overlap, want in rows:
        got = spark.range(1).select(compare.address(F.expr(place.format(*a)), F.expr(place.format(*b)), F.lit(overlap)).alias("x")).first().x
        assert INDIVIDUAL["address"][got] == want
    date = lambda y, m, d: F.struct(*(F.lit(v).cast("int").alias(n) for v, n in ((y, "year"), (m, "month"), (d, "day"))))
    for a, b, want in (((1980, None, None), (1980, None, None), "EXACT"), ((1980, 5, None), (1980, 5, None), "EXACT"), ((1980, 5, None), (1980, 5, 3), "YEAR_MONTH"), ((1980, None, None), (1980, 5, 3), "YEAR_ONLY")):
        assert INDIVIDUAL["dob"][spark.range(1).select(compare.birth_date(date(*a), date(*b)).alias("x")).first().x] == want


def test_identifiers_of_any_first_digit(spark):
    from pyspark.sql import functions as F

    from rowkin.functions import text as T

    rows = spark.createDataFrame([(f"323456789{d}",) for d in range(10)], "v string").select(T.npi(F.col("v"))["status"].alias("s")).collect()
    assert sorted(r.s for r in rows) == ["CHECKSUM_FAIL"] * 9 + ["VALID"]
    got = spark.createDataFrame([("not_available",), ("_",), ("1_2",), ("0123456789",)], "v string").select(T.npi(F.col("v"))["status"].alias("s")).collect()
    assert [r.s for r in got] == ["PLACEHOLDER_TEXT", "PLACEHOLDER_TEXT", "MALFORMED", "SENTINEL"]


def test_vectors_and_levels_are_inverse(spark):
    from pyspark.sql import functions as F

    from rowkin.operators import compare

    vector = [3, 0, 2, 5, 1, 2, 0, 1]
    df = spark.createDataFrame([(vector,)], "v array<int>").select(compare.coded(compare.described(F.col("v"), "individual"), "individual").alias("v"))
    assert df.first().v == vector


def test_strategies_are_dispatched(spark):
    import pytest as pt

    from rowkin.operators import decide

    with pt.raises(ValueError, match="no strategy"):
        decide.decided_by("guess", None, None, None)
    with pt.raises(ValueError, match="vectors"):
        decide.decided_by("probabilistic", None, None, None)


def test_metrics_are_sql_functions(spark):
    from rowkin.session import register_functions

    register_functions(spark)
    row = spark.sql("SELECT jaro_winkler('martha', 'marhta') AS a, token_set('b a', 'a b') AS b").first()
    assert abs(row.a - 0.9611111) < 1e-6 and row.b == 1.0


def test_restarts_keep_the_likelier_fit():
    import numpy as np

    from rowkin.operators import learn

    rng = np.random.default_rng(0)
    patterns = {}
    for k in range(4000):
        match = k % 10 == 0
        v = tuple(int(rng.random() < (0.9 if match else 0.1)) * (n - 1) for n in (4, 6, 6, 6, 6, 3, 4, 4))
        patterns[v] = patterns.get(v, 0) + 1
    rows = [(list(v), n) for v, n in patterns.items()]
    best = learn.best_fit("individual", rows)
    assert abs(best.share - 0.1) < 0.02 and best.trace[-1] >= learn.fit("individual", rows).trace[-1] - 1e-6
