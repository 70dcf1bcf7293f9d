"""Reviews, labels, versions, documents, isolation and repair on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from rowkin.operators import adjudicate, decide, feedback, learn
from rowkin.schema import FIELDS
from rowkin.sources import documents

FLAT = {k: learn.Model(k, *([[[1 / len(x)] * len(x) for x in FIELDS[k].values()]] * 2), 0.1) for k in FIELDS}
BUNDLES = {k: decide.Bundle(m, [(-1.0, 0.1), (1.0, 0.9)], 0.8, 0.2) for k, m in FLAT.items()}


def test_vectors_are_read_back(spark):
    names = {f: levels[-1] for f, levels in FIELDS["individual"].items()}
    rows = [(1, names, "individual"), (2, names, "organization"), (3, names | {"npi": "NO"}, None), (4, {}, None), (5, None, "individual"), (6, names | {"more": "x"}, None)]
    df = spark.createDataFrame(rows, "k int, levels map<string,string>, model string")
    got = {r.k: r.v for r in df.select("k", feedback.vector_of(F.col("levels"), F.col("model")).alias("v")).collect()}
    want = ("individual", [len(x) - 1 for x in FIELDS["individual"].values()])
    assert all(tuple(got[k]) == want for k in (1, 2, 6)) and got[3] is got[4] is got[5] is None


def test_versions(spark):
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "version string")
    got = {r.version: r.next for r in feedback.next_versions(names("em", "em.r1", "em.r4", "x.r9", "a.r1.r2"), names("em.r1", "em.r2", "em.r5", "em.r05", "other")).collect()}
    assert got == {"em": "em.r3", "em.r1": "em.r3", "em.r4": "em.r6", "x.r9": "x.r10", "a.r1.r2": "a.r1.r3"}


def test_shifted_keeps_a_band():
    assert feedback.shifted(BUNDLES, 0.06)["individual"].accept == 0.74 and feedback.shifted(BUNDLES, 0.9)["individual"].accept == 0.21


def test_config_round_trip(spark, tmp_path):
    path = str(tmp_path / "c.json")
    documents.write_config(spark, path, BUNDLES, version="v1")
    documents.write_config(spark, path, BUNDLES, version="v2")
    assert documents.read_config(spark, path) == BUNDLES and json.loads((tmp_path / "c.json").read_text())["version"] == "v2"
    broken = json.loads((tmp_path / "c.json").read_text())
    del broken["bundles"]["individual"]["m"]["dob"]
    (tmp_path / "d.json").write_text(json.dumps(broken))
    with pytest.raises(ValueError, match="individual"):
        documents.read_config(spark, str(tmp_path / "d.json"))


def test_file_cache(spark, tmp_path):
    for key, text in (("abcd", '{"answer": 1}'), ("abee", '{"answer": [2, {"x": "ü"}]}'), ("ffff", '{"answer": ')):
        (tmp_path / key[:2]).mkdir(exist_ok=True)
        (tmp_path / key[:2] / f"{key}.json").write_text(text)
    cache = documents.file_cache(spark, str(tmp_path))
    assert {r.cache_key: r.readable for r in cache.collect()} == {"abcd": True, "abee": True, "ffff": False}
    asked = spark.createDataFrame([("abcd",), ("ffff",), ("none",)], "cache_key string")
    assert {r.cache_key: r.hit for r in documents.looked_up(asked, cache).collect()} == {"abcd": True, "ffff": False, "none": False}


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    documents.write_report(spark, str(tmp_path / "r.json"), table=df, n=3)
    assert json.loads((tmp_path / "r.json").read_text()) == {"table": [{"k": 1}, {"k": 2, "v": "b"}], "n": 3}
    with pytest.raises(ValueError, match="more than 1"):
        documents.write_report(spark, str(tmp_path / "r.json"), most=1, table=df)


def test_bad_records_fail_alone(spark):
    good = [0] * len(FIELDS["individual"])
    pairs = [("a", "p1", "individual", good), ("a", "p2", "individual", good), ("b", "p1", "individual", [99, *good[1:]]), ("b", "p2", "individual", good), ("c", "p1", None, good), ("d", "p1", "individual", None), ("e", "p1", "individual", [None, *good[1:]]), ("f", "p1", "organization", good)]
    schema = "record_id string, provider_id string, kind string, vector array<int>"
    records = spark.createDataFrame([(x,) for x in "abcdefg"], "record_id string")
    df = lambda rows: spark.createDataFrame(rows, schema).withColumn("cross_type", F.lit(False))
    got = {r.record_id: r for r in decide.isolated(records, df(pairs), BUNDLES).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": "level out of range", "c": "unknown kind: none", "d": "no vector", "e": "level out of range", "f": f"vector of length {len(good)}", "g": None}
    alone = {r.record_id: r for r in decide.isolated(records, df(pairs[:2]), BUNDLES).collect()}
    assert got["a"] == alone["a"] and got["g"].decision == "NO_MATCH" and got["b"].decision is None and len(got) == 7


def test_one_repair_and_isolated_calls(spark, tmp_path):
    good = '{"decision": "MATCH", "provider_id": "p1", "confidence": 0.9, "evidence_cited": [], "reasoning": "r"}'
    asked = spark.createDataFrame([(k, ["p1"], ["p1.npi"], f"prompt {k % 5}") for k in range(10)], "record_id int, allowed array<string>, evidence array<string>, prompt string")
    log = str(tmp_path / "calls")

    def ask(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if "prompt 4" in prompt:
            raise OSError("down")
        if "refused_answer" in prompt:
            return good if "prompt 1" in prompt else "still no"
        return good if "prompt 0" in prompt else "no"

    cache = spark.createDataFrame([], "cache_key string, answer string")
    answers, rows = adjudicate.adjudicated(asked, cache, ask, "p", "m", "v")
    got = {r.record_id: (r.rejection, r.repaired, r.answer_provider_id) for r in answers.collect()}
    assert {k: got[k] for k in range(5)} == {k - 5: got[k] for k in range(5, 10)} and got[0] == (None, False, "p1") and got[1] == (None, True, "p1") and got[2] == ("no_json_found", True, None) and got[4] == ("call_failed", False, None)
    stored = spark.createDataFrame(rows.collect(), rows.schema)
    assert stored.count() == 7 and len(open(log).readlines()) == 8  # five prompts, three second rounds, whatever is read how often
    counts = adjudicate.adjudication_counts(answers).first()
    assert (counts.calls, counts.adjudicated, counts.matched, counts.repairs, counts.abstentions, counts.rejections) == (10, 4, 4, 6, 6, {"call_failed": 2, "no_json_found": 4})
    again, more = adjudicate.adjudicated(asked, stored, ask, "p", "m", "v")
    assert {r.record_id: (r.rejection, r.repaired, r.answer_provider_id) for r in again.collect()} == got and more.count() == 0 and len(open(log).readlines()) == 9
    none = adjudicate.nobody(asked)
    assert adjudicate.adjudication_counts(none).first().abstentions == 10
