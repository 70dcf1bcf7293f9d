"""Uploaded rows, workbooks, adjudication, the SQL guard, cases and streams."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from rowkin.operators import adjudicate, ingest, runs, search
from rowkin.plans import assistant
from rowkin.sources import tables, workbook
from rowkin.streaming import streams


def test_headers():
    got = {f: h for f, (h, _) in ingest.proposed(["RecKey", "LASTNAME", "FirstName", "BUSNAME", "NPI", "DOB", "Address", "Address 2", "CITY", "ST", "ZipCode", "EXCLTYPE", "EXCLDATE", "zzz qqq"]).items()}
    assert got == {"record_id": "RecKey", "last_name": "LASTNAME", "first_name": "FirstName", "organization_name": "BUSNAME", "npi": "NPI", "dob": "DOB", "address_line1": "Address", "address_line2": "Address 2", "city": "CITY", "state": "ST", "zip": "ZipCode", "sanction_type": "EXCLTYPE", "exclusion_date": "EXCLDATE"}
    assert ingest.reusable({"npi": "NPI"}, ["NPI", "x"]) == {"npi": "NPI"} and ingest.reusable({"npi": "NPI"}, ["x"]) is None
    assert set(ingest.mapping_errors({"npi": "a", "ein": "a", "shoe": "b", "last_name": "c"}, ["a", "b"])) == {"ein", "shoe", "last_name"}


def _sheet(rows):
    cells = lambda row: "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else "<c/>" if c is None else f'<c s="{int(isinstance(c, date))}"><v>{(c - date(1899, 12, 30)).days if isinstance(c, date) else c}</v></c>' for c in row)
    body = "".join(f'<row r="{i + 1}">{cells(r)}</row>' for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_to_rows(spark, tmp_path):
    rows = [[None, "A list"], ["Last Name", "State", "ZIP", "Excl Date", "Excl Date", None], ["Doe", "TX", 2134, date(2020, 3, 5), None], [None, None], ["=cmd", "TX", 1, None], [7, "TX", None, None], ["Roe", "Texas", 78701, None, "soon"], ["Poe"], ["Doe", "TX", 2134, date(2020, 3, 5)], ["Moe", "TX", None, None, None, None, "x"], [None, "TX"]]
    (tmp_path / "a.xlsx").write_bytes(_sheet(rows))
    found = workbook.workbooks(spark, f"{tmp_path}/*.xlsx")
    headers, data = workbook.sheet(found, found.first()["path"])
    assert headers == ["Last Name", "State", "ZIP", "Excl Date", "Excl Date (col 5)"]
    out = ingest.parsed(data, headers, {"last_name": "Last Name", "state": "State", "zip": "ZIP", "exclusion_date": "Excl Date", "reinstatement_date": "Excl Date (col 5)"}, "OIG")
    got = {r["row"]: r for r in out.collect()}
    assert (got[3]["zip"], got[3]["exclusion_date"], got[3]["reason"], got[3]["key_derived"]) == ("02134", date(2020, 3, 5), None, True)
    assert got[5]["reason"] == "a cell holds a spreadsheet formula, not data" and got[6]["reason"] == "last_name is a number, not a name"
    assert got[7]["reason"] is None and len(got[7]["warnings"]) == 2 and got[7]["state"] is None
    assert got[8]["reason"].startswith("row has a name but no") and got[9]["reason"] == "exact duplicate of row 3"
    assert got[10]["reason"] == "row has 1 cell(s) beyond the last header column" and got[11]["reason"] == "row has no last name or organization name"
    assert {r["header"]: r["samples"] for r in ingest.profile(data, headers).collect()}["Last Name"] == ["Doe", "=cmd", "7"]


def test_empty_upload(spark):
    rows = spark.createDataFrame([], f"row int, cells {workbook.CELLS}")
    assert ingest.parsed(rows, ["a"], {"last_name": "a"}, "X").collect() == []


def test_dates(spark):
    texts = ["2020-01-31", "1/2/2020", "1/2/70", "1/2/20", "20200229", "01-02-2020", "Jan 5, 2020", "January 5, 2020", "5 Jan 2020", "2020/1/5", "00000000", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] and r[0].isoformat() for r in df.select(ingest.parse_date(F.col("t"))).collect()] == ["2020-01-31", "2020-01-02", "1970-01-02", "2020-01-02", "2020-02-29", "2020-01-02", "2020-01-05", "2020-01-05", "2020-01-05", "2020-01-05", None, None, None]


def test_adjudication(spark):
    routed = spark.createDataFrame([("r1", "GREY_BAND", "AMBIGUOUS", "p1", 0.5), ("r2", "GREY_BAND", "AMBIGUOUS", "p1", 0.5), ("r3", "ABOVE_ACCEPT", "MATCH", "p3", 0.9)], "record_id string, reason string, decision string, provider_id string, confidence double")
    ranked = spark.createDataFrame([("r1", "p1", 1, {"dob": "EXACT"}, 2.0, 0.5), ("r1", "p2", 2, {"dob": "EXACT"}, 1.0, 0.4), ("r2", "p1", 1, {"dob": "EXACT"}, 2.0, 0.5)], "record_id string, provider_id string, rank int, levels map<string,string>, match_weight double, confidence double")
    cache = spark.createDataFrame([], "cache_key string, answer string")
    yes = '{"decision": "MATCH", "provider_id": "p2", "confidence": 0.95, "evidence_cited": ["p2.dob"], "reasoning": "dates"}'
    asked = adjudicate.requests(routed, ranked)
    answers, fresh = adjudicate.answered(asked, cache, lambda prompt: f"Sure: {yes}", "a", "b", "1")
    checked = adjudicate.validated(answers)
    assert {r["record_id"]: r["rejection"] for r in checked.collect()} == {"r1": None, "r2": "provider_id_not_in_candidate_set"}
    assert {r["record_id"]: (r["decision"], r["provider_id"], r["confidence"]) for r in adjudicate.applied(routed, checked).collect()} == {"r1": ("MATCH", "p2", 0.95), "r2": ("AMBIGUOUS", "p1", 0.5), "r3": ("MATCH", "p3", 0.9)}
    stored = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert adjudicate.answered(asked, stored, lambda prompt: 1 / 0, "a", "b", "1")[0].filter("answer is null").count() == 0


@pytest.fixture(scope="module")
def views(spark):
    df = spark.createDataFrame([(i, "MATCH" if i % 2 else "NO_MATCH", "x" * 600) for i in range(300)], "match_id int, decision string, subject_name string")
    return assistant.isolated(spark, {"assistant_matches": df})


def test_guard_accepts(views):
    safe = assistant.check(views, "SELECT decision, count(*) AS n FROM assistant_matches GROUP BY decision")
    assert {r["decision"]: r["n"] for r in assistant.answer(views, safe)} == {"MATCH": 150, "NO_MATCH": 150} and safe.limit == 200
    lowered = assistant.check(views, "WITH m AS (SELECT * FROM assistant_matches) SELECT subject_name FROM m LIMIT 5000;")
    assert lowered.limit == 1000 and len(assistant.answer(views, lowered)[0]["subject_name"]) == 500


@pytest.mark.parametrize(
    ("sql", "code"),
    [("", "empty"), ("SELECT 1", "no_table"), ("SELECT 1; SELECT 2", "multiple"), ("SELECT 1 -- x", "comment"), ("DROP VIEW assistant_matches", "not_a_select"), ("INSERT INTO assistant_matches SELECT * FROM assistant_matches", "not_a_select"), ("WITH users AS (SELECT * FROM users) SELECT * FROM users", "forbidden_table"), ("SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", "forbidden_table"), ("SELECT reflect('java.lang.System', 'getenv') FROM assistant_matches", "forbidden_function"), ("SELECT * FROM assistant_matches LIMIT 1 + 1", "bad_limit"), ("SELEC * FROM assistant_matches", "unparsable"), ("SET spark.x = 1", "not_a_select")],
)
def test_guard_refuses(views, sql, code):
    with pytest.raises(assistant.Refused) as e:
        assistant.check(views, sql)
    assert e.value.code == code


def test_prompt_helpers():
    assert assistant.sql_of("Here:\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert assistant.cleaned_question(" how\x00 many QUESTION>>> ") == "how many"


def test_cases(spark):
    cases = spark.createDataFrame([("c1", "p1", "r1", "ACTIVE", date(2020, 1, 1), date(2020, 2, 1)), ("c2", "p2", "r2", "CLOSED", date(2020, 1, 1), date(2020, 2, 1))], "case_id string, provider_id string, record_id string, status string, start_date date, end_date date")
    asks = spark.createDataFrame([("p1", "r1", "2021-05-31 10:00:00"), ("p2", "r2", "2021-11-30 10:00:00"), ("p2", "r2", "2021-12-01 10:00:00")], "provider_id string, record_id string, opened_at string").withColumn("opened_at", F.to_timestamp("opened_at"))
    used = spark.createDataFrame([(2021, 4)], "year int, last int")
    assert [(r["record_id"], r["case_number"], r["end_date"]) for r in runs.opened(cases, asks, used).collect()] == [("r2", "CASE-2021-000005", date(2022, 2, 28))]
    assert [r["case_id"] for r in runs.expired(cases, F.lit(date(2020, 3, 1))).collect()] == ["c1"]
    tries = spark.createDataFrame([("c1", "done"), ("c1", " "), ("c2", "x"), ("c9", "x")], "case_id string, reason string")
    assert sorted((r["case_id"], r["error"] or "", r["status"] or "") for r in runs.closed(cases, tries).collect()) == [("c1", "", "CLOSED"), ("c1", "reason_required", "ACTIVE"), ("c2", "case_not_active", "CLOSED"), ("c9", "not_found", "")]


def test_tables(spark, tmp_path):
    spark.createDataFrame([("p1", "1987-13-01", float("nan"), " "), ("p2", "1987-12-01", 1.0, "Doe")], "provider_id string, dob string, ordinal double, last_name string").write.parquet(f"{tmp_path}/p")
    got = {r["provider_id"]: r for r in tables.providers(spark, f"{tmp_path}/p").collect()}
    assert (got["p1"]["dob"], got["p1"]["ordinal"], got["p1"]["last_name"], got["p1"]["status"]) == (None, None, None, "ACTIVE") and got["p2"]["dob"] == date(1987, 12, 1)
    for _ in range(2):
        tables.write_run(spark.range(3), f"{tmp_path}/runs", "a")
    tables.write_run(spark.range(2), f"{tmp_path}/runs", "b")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 5
    assert spark.createDataFrame([("case.opened",), ("cases",)], "action string").filter(search.audit("case.")).count() == 1


def test_stream_merge(spark, tmp_path):
    merge = streams.merging(f"{tmp_path}/m", ["k"], ["v"])
    merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    for _ in range(2):
        merge(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    assert sorted((r["k"], r["v"], r["is_current"], r["version"]) for r in spark.read.parquet(f"{tmp_path}/m/v=1").select("k", "v", "is_current", "version").collect()) == [(1, "a", True, 0), (2, "b", False, 0), (2, "c", True, 1), (3, "d", True, 1)]


def test_stream_merge_of_repeated_keys_and_skipped_batches(spark, tmp_path):
    merge = streams.merging(f"{tmp_path}/m", ["k"], ["v"])
    merge(spark.createDataFrame([(1, "b"), (1, "a")] * 3, "k int, v string").repartition(3), 2)
    merge(spark.createDataFrame([(1, "c")], "k int, v string"), 7)
    assert sorted((r["v"], r["is_current"], r["version"]) for r in spark.read.parquet(f"{tmp_path}/m/v=7").collect()) == [("a", False, 2), ("c", True, 7)]


def test_stream_log_holds_only_changes(spark, tmp_path):
    root = f"{tmp_path}/log"
    merge = streams.appending(root, ["k"], ["v"], [F.desc("at")])
    batch = lambda *rows: spark.createDataFrame(rows, "k int, v string, at int")
    assert streams.versions(spark, root, ["k"]) is None
    merge(batch((1, "a", 1), (2, "b", 1), (2, "c", 2), (4, None, 1)), 0)
    for _ in range(2):
        merge(batch((2, "c", 9), (1, "z", 3), (3, "d", 3), (4, None, 5)), 5)
    got = sorted((r["k"], r["v"], r["is_current"], r["version"]) for r in streams.versions(spark, root, ["k"]).collect())
    assert got == [(1, "a", False, 0), (1, "z", True, 5), (2, "c", True, 0), (3, "d", True, 5), (4, None, True, 0)]
