"""Comparison vectors of constructed pairs by the engine's own comparators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.operators import compare
from rowkin.queries import query, table
from rowkin.schema import level

_LAST = (("THOMPSON", ("TMPS",)), ("THOMSON", ("TMSN",)), ("NAKAMURA", ("NKMR",)), ("SMITH", ("SM0", "XMT")), ("SCHMIDT", ("XMT", "SMT")), ("", ()))
_FIRST = (("BOB", "ROBERT"), ("ROBERT", "ROBERT"), ("B", "B"), ("MARY", "MARIA"), ("MARIAN", "MARIAN"), ("ROBERTA", "ROBERTA"), ("", ""))
_ORGS = (("CEDAR RIDGE HEALTH", "CRH"), ("CRH", ""), ("LAKE CLINIC", "LC"), ("LAKE CLINICS", "LC"), ("", ""))
_LINES = ("12 OAK STREET", "9 ELM COURT", "")


def _list(values) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, tuple) else f"'{v}'" for v in values) + "]"


def _code(kind: str, field: str, name: str) -> str:
    return str(level(kind, field, name))


def _cases(kind: str, field: str, *steps: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {_code(kind, field, name)}" for test, name in steps) + f" ELSE {_code(kind, field, other)} END"


#: One side of a pair from a number ``n``.
_SIDE = f"""(SELECT c_custkey AS k, n, n % 9 = 0 AS org, CASE WHEN n % 4 = 0 THEN '' ELSE 'N' || n % 50 END AS npi, CASE WHEN n % 5 = 0 THEN '' ELSE 'E' || n % 3 END AS ein,
  list_extract({_list([a for a, _ in _LAST])}, CAST(n % {len(_LAST)} AS INTEGER) + 1) AS last, list_extract({_list([b for _, b in _LAST[:-1]] + [("-",)])}, CAST(n % {len(_LAST)} AS INTEGER) + 1) AS sounds,
  list_extract({_list([a for a, _ in _FIRST])}, CAST(n % {len(_FIRST)} AS INTEGER) + 1) AS first, list_extract({_list([b for _, b in _FIRST])}, CAST(n % {len(_FIRST)} AS INTEGER) + 1) AS norm,
  list_extract({_list([a for a, _ in _ORGS])}, CAST(n % {len(_ORGS)} AS INTEGER) + 1) AS legal, list_extract({_list([b for _, b in _ORGS])}, CAST(n % {len(_ORGS)} AS INTEGER) + 1) AS acr, CASE WHEN n % 6 = 1 THEN 'LAKE CLINIC' ELSE '' END AS dba,
  CASE WHEN n % 10 > 0 THEN 1950 + n % 3 END AS y, CASE WHEN n % 10 > 1 THEN 1 + n % 4 END AS m, CASE WHEN n % 10 > 2 THEN 1 + n % 5 END AS d,
  list_extract({_list(_LINES)}, CAST(n % 3 AS INTEGER) + 1) AS line, CASE WHEN n % 2 = 0 THEN '' ELSE 'APT 1' END AS unit, CASE WHEN n % 11 = 0 THEN '7' || n % 2 ELSE '' END AS box, CASE WHEN n % 7 = 0 THEN '' ELSE '77' || n % 2 || '0' || n % 3 END AS zip, CASE WHEN n % 7 = 0 THEN '' ELSE 'S' || n % 2 END AS st,
  CASE WHEN n % 5 = 0 THEN '' ELSE 'L' || n % 4 END AS lic, CASE WHEN n % 2 = 0 THEN 'TX' ELSE '' END AS licst FROM (SELECT c_custkey, {{0}} AS n FROM customer))"""
_PAIRS_SQL = f"""WITH r AS {_SIDE.format("c_custkey")}, p AS {_SIDE.format("c_custkey * 7 + c_custkey % 2")}
, whole AS (SELECT *, trim(first || ' ' || last) AS full_name FROM r), q AS (SELECT *, trim(first || ' ' || last) AS full_name FROM p)
, t AS (SELECT r.k, r.org OR p.org AS is_org, r.org <> p.org AS crossed, r.npi AS an, p.npi AS bn, r.ein AS ae, p.ein AS be, r.last AS al, p.last AS bl, list_has_any(r.sounds, p.sounds) AND r.last <> '' AND p.last <> '' AS alike, r.first AS af, p.first AS bf, r.norm AS anorm, p.norm AS bnorm,
    r.y AS ay, r.m AS am, r.d AS ad, p.y AS by_, p.m AS bm, p.d AS bd, r.line AS aline, p.line AS bline, r.unit AS aunit, p.unit AS bunit, r.box AS abox, p.box AS bbox, r.zip AS azip, p.zip AS bzip, r.st AS ast, p.st AS bst, r.lic AS alic, p.lic AS blic, r.licst AS als, p.licst AS bls,
    CASE WHEN r.org THEN r.legal ELSE r.full_name END AS ao, CASE WHEN p.org THEN p.legal ELSE p.full_name END AS bo, r.dba AS adba, p.dba AS bdba,
    CASE WHEN r.org THEN r.acr WHEN contains(r.full_name, ' ') THEN substr(r.first, 1, 1) || substr(r.last, 1, 1) ELSE '' END AS aacr, CASE WHEN p.org THEN p.acr WHEN contains(p.full_name, ' ') THEN substr(p.first, 1, 1) || substr(p.last, 1, 1) ELSE '' END AS bacr FROM whole r JOIN q p USING (k))"""


def _identifier(a: str, b: str) -> str:
    return _cases("individual", "npi", (f"{a} = '' AND {b} = ''", "BOTH_INVALID"), (f"{a} = '' OR {b} = ''", "ONE_INVALID"), (f"{a} = {b}", "VALID_EXACT"), other="VALID_DISAGREE")


_ADDRESS = _cases("individual", "address", ("abox <> '' AND bbox <> '' AND abox = bbox", "EXACT"), ("abox <> '' AND bbox <> ''", "DISAGREE"), ("(aline = '' OR bline = '') AND azip <> '' AND azip = bzip", "SAME_ZIP_ONLY"), ("aline = '' OR bline = ''", "MISSING"), ("aline = bline AND aunit = bunit", "EXACT"), ("aline = bline", "SAME_STREET_DIFF_UNIT"), ("azip <> '' AND azip = bzip", "SAME_ZIP_ONLY"), other="DISAGREE")
_STATE = _cases("individual", "state", ("ast = '' OR bst = ''", "MISSING"), ("ast = bst", "EXACT"), other="DISAGREE")
_ZIP = _cases("individual", "zip", ("azip = '' OR bzip = ''", "MISSING"), ("azip = bzip", "ZIP5"), ("substr(azip, 1, 3) = substr(bzip, 1, 3)", "ZIP3"), other="DISAGREE")
_PERSON = ", ".join((
    _identifier("an", "bn"),
    _cases("individual", "last_name", ("al = '' OR bl = ''", "MISSING"), ("al = bl", "EXACT"), ("alike", "PHONETIC"), ("jaro_winkler_similarity(al, bl) >= 0.92", "JW_HIGH"), ("jaro_winkler_similarity(al, bl) >= 0.85", "JW_LOW"), other="DISAGREE"),
    _cases("individual", "first_name", ("af = '' OR bf = ''", "MISSING"), ("af = bf", "EXACT"), ("anorm = bnorm", "NICKNAME"), ("(length(af) = 1 OR length(bf) = 1) AND substr(af, 1, 1) = substr(bf, 1, 1)", "INITIAL"), ("jaro_winkler_similarity(af, bf) >= 0.85", "JW_LOW"), other="DISAGREE"),
    _cases("individual", "dob", ("ay IS NULL OR by_ IS NULL", "MISSING"), ("ay = by_ AND am IS NOT DISTINCT FROM bm AND ad IS NOT DISTINCT FROM bd", "EXACT"), ("ay = by_ AND am = bd AND ad = bm", "TRANSPOSED"), ("ay <> by_", "DISAGREE"), ("am IS NULL OR bm IS NULL", "YEAR_ONLY"), ("am = bm", "YEAR_MONTH"), other="DISAGREE"),
    _ADDRESS, _STATE, _ZIP,
    _cases("individual", "license", ("alic = '' OR blic = ''", "MISSING"), ("alic <> blic", "DISAGREE"), ("als = bls AND als <> ''", "EXACT"), other="EXACT_DIFF_STATE"),
))
_STANDS = "({0} <> '' AND NOT contains({0}, ' ') AND length({0}) <= 8 AND ({0} = {1} OR {0} = ''))"
_TRADE = "greatest(" + ", ".join(f"CASE WHEN {a} = '' OR {b} = '' THEN NULL WHEN {a} = {b} THEN {_code('organization', 'dba_alias', 'EXACT')} ELSE {_code('organization', 'dba_alias', 'DISAGREE')} END" for a, b in (("adba", "bdba"), ("bdba", "ao"), ("bo", "adba"))) + ")"
_ORGANIZATION = ", ".join((
    _identifier("an", "bn"), _identifier("ae", "be"),
    _cases("organization", "legal_name", ("ao = '' OR bo = ''", "MISSING"), ("ao = bo", "EXACT"), (f"{_STANDS.format('ao', 'bacr')} OR {_STANDS.format('bo', 'aacr')}", "ACRONYM"), ("ao IN ('LAKE CLINIC', 'LAKE CLINICS') AND bo IN ('LAKE CLINIC', 'LAKE CLINICS')", "TOKEN_SET"), ("jaro_winkler_similarity(ao, bo) >= 0.85", "JW_LOW"), other="DISAGREE"),
    f"coalesce({_TRADE}, {_code('organization', 'dba_alias', 'MISSING')})", _ADDRESS, _STATE, _ZIP,
))


def _side(spark, sf_dir, number: str, key: str):
    pick = lambda values: F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") for v in values)), (F.col("n") % len(values)).cast("int") + 1)
    n, text = F.col("n"), lambda x: x.cast("string")
    lit = F.lit
    first, last = pick([a for a, _ in _FIRST]), pick([a for a, _ in _LAST])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(key), F.expr(number).alias("n"))
    return rows.select(
        F.col(key).alias("record_id"), (n % 9 == 0).alias("is_organization"), F.when(n % 4 == 0, "").otherwise(F.concat(lit("N"), text(n % 50))).alias("npi"), F.when(n % 5 == 0, "").otherwise(F.concat(lit("E"), text(n % 3))).alias("ein"),
        last.alias("last_norm"), pick([b for _, b in _LAST]).alias("phonetic_keys"), first.alias("first_raw"), pick([b for _, b in _FIRST]).alias("first_norm"), F.trim(F.concat_ws(" ", first, last)).alias("name_norm"),
        pick([a for a, _ in _ORGS]).alias("org_name_norm"), pick([b for _, b in _ORGS]).alias("org_acronym_key"), F.when(n % 6 == 1, "LAKE CLINIC").otherwise("").alias("dba_name_norm"), lit("").alias("dba_acronym_key"),
        F.struct(F.when(n % 10 > 0, 1950 + n % 3).cast("int").alias("year"), F.when(n % 10 > 1, 1 + n % 4).cast("int").alias("month"), F.when(n % 10 > 2, 1 + n % 5).cast("int").alias("day")).alias("dob"),
        F.struct(pick(_LINES).alias("line"), F.when(n % 2 == 0, "").otherwise("APT 1").alias("unit"), F.when(n % 11 == 0, F.concat(lit("7"), text(n % 2))).otherwise("").alias("po_box"), F.when(n % 7 == 0, "").otherwise(F.concat(lit("77"), text(n % 2), lit("0"), text(n % 3))).alias("zip5"), F.when(n % 7 == 0, "").otherwise(F.concat(lit("S"), text(n % 2))).alias("state")).alias("address"),
        F.when(n % 5 == 0, "").otherwise(F.concat(lit("L"), text(n % 4))).alias("license_number"), F.when(n % 2 == 0, "TX").otherwise("").alias("license_state"),
    )


@query(f"{_PAIRS_SQL} SELECT k AS record_id, CASE WHEN is_org THEN 'organization' ELSE 'individual' END AS kind, crossed AS cross_type, CASE WHEN is_org THEN concat_ws(',', {_ORGANIZATION}) ELSE concat_ws(',', {_PERSON}) END AS vector FROM t")
def pair_vectors(spark, sf_dir):
    """Vectors of pairs of persons, organizations, and persons against organizations."""
    records, master = _side(spark, sf_dir, "c_custkey", "c"), _side(spark, sf_dir, "c_custkey * 7 + c_custkey % 2", "c")
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_custkey").alias("provider_id"), F.array(F.lit("npi")).alias("blocks"), F.lit(1).alias("rank"))
    out = compare.vectors(found, records, master)
    return out.select("record_id", "kind", "cross_type", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"))
