"""Level codes of candidate pairs. Cheap equalities are Columns; string metrics run for the pairs that they leave open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions import text as T
from rowkin.functions.metrics import jaro_winkler_udf, token_set_udf
from rowkin.functions.text import let
from rowkin.operators.blocking import by_rows
from rowkin.schema import FIELDS, level

HIGH, LOW = 0.92, 0.85
ADDRESS_SET, NAME_SET = 0.90, 0.90


def with_metrics(pairs: DataFrame, asks: dict[str, tuple]) -> DataFrame:
    """Adds metrics of two string columns each: name to (function, a, b, where), 0 for rows that do not need it.

    All go to Python together, with the strings that need it only. Nothing is shuffled; a pair that a batch repeats is computed once.
    """
    names = pairs.columns
    need = lambda a, b, where: where & (a != "") & (b != "")
    asked = pairs.select(*names, *(x for out, (_, a, b, where) in asks.items() for x in (F.when(need(a, b, where), a).alias(f"{out}_a"), F.when(need(a, b, where), b).alias(f"{out}_b"))))
    return asked.select(*names, *(udf(f"{out}_a", f"{out}_b").alias(out) for out, (udf, *_) in asks.items()))


def with_metric(pairs: DataFrame, udf, a: Column, b: Column, where: Column, out: str) -> DataFrame:
    return with_metrics(pairs, {out: (udf, a, b, where)})


def _levels(kind: str, field: str):
    return lambda name: F.lit(level(kind, field, name))


def identifier(a: Column, b: Column) -> Column:
    n = _levels("individual", "npi")
    return F.when((a == "") & (b == ""), n("BOTH_INVALID")).when((a == "") | (b == ""), n("ONE_INVALID")).when(a == b, n("VALID_EXACT")).otherwise(n("VALID_DISAGREE"))


def last_name(p: Column, q: Column, jw: Column) -> Column:
    n = _levels("individual", "last_name")
    a, b = p["last_norm"], q["last_norm"]
    return F.when((a == "") | (b == ""), n("MISSING")).when(a == b, n("EXACT")).when(F.arrays_overlap(p["phonetic_keys"], q["phonetic_keys"]), n("PHONETIC")).when(jw >= HIGH, n("JW_HIGH")).when(jw >= LOW, n("JW_LOW")).otherwise(n("DISAGREE"))


def first_name(p: Column, q: Column, jw: Column) -> Column:
    n = _levels("individual", "first_name")
    a, b = p["first_raw"], q["first_raw"]
    initial = ((F.length(a) == 1) | (F.length(b) == 1)) & (F.left(a, F.lit(1)) == F.left(b, F.lit(1)))
    return F.when((a == "") | (b == ""), n("MISSING")).when(a == b, n("EXACT")).when(p["first_norm"] == q["first_norm"], n("NICKNAME")).when(initial, n("INITIAL")).when(jw >= LOW, n("JW_LOW")).otherwise(n("DISAGREE"))


def birth_date(a: Column, b: Column) -> Column:
    n = _levels("individual", "dob")
    whole = lambda d: d["year"].isNotNull() & d["month"].isNotNull() & d["day"].isNotNull()
    swapped = whole(a) & whole(b) & (a["year"] == b["year"]) & (a["month"] == b["day"]) & (a["day"] == b["month"])
    return (
        F.when(a["year"].isNull() | b["year"].isNull(), n("MISSING"))
        .when(a.eqNullSafe(b), n("EXACT"))
        .when(F.coalesce(swapped, F.lit(False)), n("TRANSPOSED"))
        .when(a["year"] != b["year"], n("DISAGREE"))
        .when(a["month"].isNull() | b["month"].isNull(), n("YEAR_ONLY"))
        .when(a["month"] == b["month"], n("YEAR_MONTH"))
        .otherwise(n("DISAGREE"))
    )


def address(a: Column, b: Column, overlap: Column) -> Column:
    n = _levels("individual", "address")
    same_zip = (a["zip5"] != "") & (a["zip5"] == b["zip5"])
    return (
        F.when((a["po_box"] != "") & (b["po_box"] != ""), F.when(a["po_box"] == b["po_box"], n("EXACT")).otherwise(n("DISAGREE")))
        .when((a["line"] == "") | (b["line"] == ""), F.when(same_zip, n("SAME_ZIP_ONLY")).otherwise(n("MISSING")))
        .when(a["line"] == b["line"], F.when(a["unit"] == b["unit"], n("EXACT")).otherwise(n("SAME_STREET_DIFF_UNIT")))
        .when(overlap >= ADDRESS_SET, n("TOKEN_SET"))
        .when(same_zip, n("SAME_ZIP_ONLY"))
        .otherwise(n("DISAGREE"))
    )


def state(a: Column, b: Column) -> Column:
    n = _levels("individual", "state")
    return F.when((a == "") | (b == ""), n("MISSING")).when(a == b, n("EXACT")).otherwise(n("DISAGREE"))


def zip_code(a: Column, b: Column) -> Column:
    n = _levels("individual", "zip")
    return F.when((a == "") | (b == ""), n("MISSING")).when(a == b, n("ZIP5")).when(F.left(a, F.lit(3)) == F.left(b, F.lit(3)), n("ZIP3")).otherwise(n("DISAGREE"))


def license_(p: Column, q: Column) -> Column:
    n = _levels("individual", "license")
    a, b = p["license_number"], q["license_number"]
    return F.when((a == "") | (b == ""), n("MISSING")).when(a != b, n("DISAGREE")).when((p["license_state"] == q["license_state"]) & (p["license_state"] != ""), n("EXACT")).otherwise(n("EXACT_DIFF_STATE"))


def legal_name(p: Column, q: Column, overlap: Column, jw: Column) -> Column:
    n = _levels("organization", "legal_name")
    a, b = p["org_name_norm"], q["org_name_norm"]
    stands_for = lambda x, other: (x != "") & ~x.contains(" ") & (F.length(x) <= 8) & ((x == other["org_acronym_key"]) | (x == other["dba_acronym_key"]))
    acronym = stands_for(a, q) | stands_for(b, p)
    return F.when((a == "") | (b == ""), n("MISSING")).when(a == b, n("EXACT")).when(acronym, n("ACRONYM")).when(overlap >= NAME_SET, n("TOKEN_SET")).when(jw >= LOW, n("JW_LOW")).otherwise(n("DISAGREE"))


#: Pairs of names that trading names are compared by; the two legal names are another field's.
TRADE_PAIRS = (("dba_name_norm", "dba_name_norm"), ("dba_name_norm", "org_name_norm"), ("org_name_norm", "dba_name_norm"))


def trade_name(p: Column, q: Column, overlaps: list[Column]) -> Column:
    """Best agreement over both slots of both sides; ``overlaps``: token sets of TRADE_PAIRS."""
    n = _levels("organization", "dba_alias")
    levels = [F.when((p[x] == "") | (q[y] == ""), F.lit(None)).when(p[x] == q[y], n("EXACT")).when(o >= NAME_SET, n("TOKEN_SET")).otherwise(n("DISAGREE")) for (x, y), o in zip(TRADE_PAIRS, overlaps, strict=True)]
    return F.coalesce(F.greatest(*levels), n("MISSING"))


#: What is read of a record to compare it.
COMPARED = ("is_organization", "npi", "ein", "name_norm", "first_norm", "first_raw", "last_norm", "phonetic_keys", "dob", "org_name_norm", "org_acronym_key", "dba_name_norm", "dba_acronym_key", "license_number", "license_state")
PLACE = ("line", "unit", "state", "zip5", "po_box")


def side(df: DataFrame, name: str, id_col: str = "id") -> DataFrame:
    """The id of each record, and as a struct ``name`` what is read of it to compare it."""
    return df.select(F.col("record_id").alias(id_col), F.struct(*COMPARED, F.struct(*(F.col(f"address.{x}").alias(x) for x in PLACE)).alias("address")).alias(name))


def vectors(found: DataFrame, records: DataFrame, master: DataFrame) -> DataFrame:
    """Candidates with ``kind`` (organization where either side is one) and ``vector``, level codes in the order of FIELDS."""
    pairs = found.join(by_rows(side(records, "r", "r_id")), found["record_id"] == F.col("r_id")).join(by_rows(side(master, "p", "p_id")), F.col("provider_id") == F.col("p_id"))
    return compared(pairs.drop("r_id", "p_id"))


def compared(pairs: DataFrame) -> DataFrame:
    """``vectors`` of pairs that bring their sides along, ``r`` and ``p``: a row stays in its task."""
    r, p = F.col("r"), F.col("p")
    org = r["is_organization"] | p["is_organization"]
    given = [c for c in pairs.columns if c not in ("r", "p")]

    def as_organization(x: Column, field: str, made: Callable[[Column], Column]) -> Column:
        """A person against an organization is compared as one: the whole name, which is folded by now, is its legal name."""
        return F.when(org & ~F.coalesce(x["is_organization"], F.lit(False)), let(T.org_name(x["name_norm"], unicode=False)["name"], made)).otherwise(x[field])

    # made only for the pairs of a person and an organization
    names = {f"{n}_{f}": as_organization(x, f, made) for n, x in (("r", r), ("p", p)) for f, made in (("org_name_norm", lambda name: name), ("org_acronym_key", T.org_acronym))}
    pairs = pairs.select("*", F.when(org, "organization").otherwise("individual").alias("kind"), *(v.alias(k) for k, v in names.items()))
    own = lambda x, n: {f: x[f] for f in (*COMPARED, "address")} | {f: F.col(f"{n}_{f}") for f in ("org_name_norm", "org_acronym_key")}
    r, p = own(r, "r"), own(p, "p")
    org = F.col("kind") == "organization"
    differ = lambda a, b: (a != b) & (a != "") & (b != "")
    asks = {
        "_jw_last": (jaro_winkler_udf, p["last_norm"], r["last_norm"], ~org & differ(p["last_norm"], r["last_norm"])),
        "_jw_first": (jaro_winkler_udf, p["first_raw"], r["first_raw"], ~org & differ(p["first_norm"], r["first_norm"])),
        "_jw_org": (jaro_winkler_udf, p["org_name_norm"], r["org_name_norm"], org & differ(p["org_name_norm"], r["org_name_norm"])),
        "_set_org": (token_set_udf, p["org_name_norm"], r["org_name_norm"], org & differ(p["org_name_norm"], r["org_name_norm"])),
        "_set_line": (token_set_udf, p["address"]["line"], r["address"]["line"], differ(p["address"]["line"], r["address"]["line"])),
    } | {f"_set_dba{k}": (token_set_udf, p[x], r[y], org & differ(p[x], r[y])) for k, (x, y) in enumerate(TRADE_PAIRS)}
    pairs = with_metrics(pairs, asks)
    shared = {
        "npi": identifier(p["npi"], r["npi"]),
        "address": address(p["address"], r["address"], F.col("_set_line")),
        "state": state(p["address"]["state"], r["address"]["state"]),
        "zip": zip_code(p["address"]["zip5"], r["address"]["zip5"]),
    }
    own = {
        "individual": shared | {"last_name": last_name(p, r, F.col("_jw_last")), "first_name": first_name(p, r, F.col("_jw_first")), "dob": birth_date(p["dob"], r["dob"]), "license": license_(p, r)},
        "organization": shared | {"ein": identifier(p["ein"], r["ein"]), "legal_name": legal_name(p, r, F.col("_set_org"), F.col("_jw_org")), "dba_alias": trade_name(p, r, [F.col(f"_set_dba{k}") for k in range(len(TRADE_PAIRS))])},
    }
    vector = {k: F.array(*(own[k][f].cast("int") for f in FIELDS[k])) for k in FIELDS}
    cross = r["is_organization"] != p["is_organization"]
    return pairs.select(*given, "kind", cross.alias("cross_type"), F.when(org, vector["organization"]).otherwise(vector["individual"]).alias("vector"))


def described(vector: Column, kind: str) -> Column:
    """A vector as a map of field to level name."""
    fields = FIELDS[kind]
    names = [F.element_at(F.array(*map(F.lit, levels)), vector[i] + 1) for i, levels in enumerate(fields.values())]
    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*names))


def coded(levels: Column, kind: str) -> Column:
    """A map of field to level name as a vector: what ``described`` undoes; null where a name is unknown."""
    return F.array(*(F.nullif(F.array_position(F.array(*map(F.lit, names)), levels[field]), F.lit(0)).cast("int") - 1 for field, names in FIELDS[kind].items()))


def level_counts(pairs: DataFrame, kind: str) -> DataFrame:
    """(field, level, n) of all levels of a kind's fields, those that never occur too."""
    own = pairs.filter(F.col("kind") == kind).select(F.explode(described(F.col("vector"), kind)).alias("field", "level"))
    every = pairs.sparkSession.createDataFrame([(f, x) for f, names in FIELDS[kind].items() for x in names], "field string, level string")
    return every.join(own.groupBy("field", "level").agg(F.count("*").alias("n")), ["field", "level"], "left").select("field", "level", F.coalesce("n", F.lit(0)).alias("n"))


# Weights and cuts of the fuzzy baseline.
FUZZY_WEIGHTS = {
    "individual": {"npi": 0.30, "name": 0.30, "dob": 0.15, "address": 0.10, "zip": 0.05, "state": 0.05, "license": 0.05},
    "organization": {"npi": 0.25, "ein": 0.15, "name": 0.40, "address": 0.10, "zip": 0.05, "state": 0.05},
}
FUZZY_ACCEPT, FUZZY_REJECT = 0.88, 0.70


def similarity(found: DataFrame, records: DataFrame, master: DataFrame) -> DataFrame:
    """(record_id, provider_id, kind, confidence): the weighted mean of the fuzzy baseline, which counts missing as disagreeing.

    The kind is the record's own; organizations compare names across both slots.
    """
    whole = lambda df, name: df.select(F.col("record_id").alias(f"{name}_id"), F.struct(*df.columns).alias(name))
    pairs = found.select("record_id", "provider_id").join(whole(records, "r"), F.col("record_id") == F.col("r_id")).join(whole(master, "p"), F.col("provider_id") == F.col("p_id"))
    r, p = F.col("r"), F.col("p")
    org = r["is_organization"]
    metrics = {
        "_jw": (jaro_winkler_udf, r["name_norm"], p["name_norm"], ~org),
        "_sorted": (token_set_udf, r["name_sorted_norm"], p["name_sorted_norm"], ~org),
        "_legal": (token_set_udf, r["org_name_norm"], p["org_name_norm"], org),
        "_trade": (token_set_udf, r["dba_name_norm"], p["org_name_norm"], org),
        "_other": (token_set_udf, r["org_name_norm"], p["dba_name_norm"], org),
        "_line": (token_set_udf, r["address"]["line"], p["address"]["line"], F.lit(True)),
    }
    pairs = with_metrics(pairs, metrics)
    same = lambda a, b: F.coalesce((a != "") & (a == b), F.lit(False)).cast("double")
    born = F.coalesce(r["dob"]["year"].isNotNull() & r["dob"].eqNullSafe(p["dob"]), F.lit(False)).cast("double")
    shared = {"npi": same(r["npi"], p["npi"]), "address": F.col("_line"), "zip": same(r["address"]["zip5"], p["address"]["zip5"]), "state": same(r["address"]["state"], p["address"]["state"])}
    parts = {
        "individual": shared | {"name": F.greatest("_jw", "_sorted"), "dob": born, "license": same(r["license_number"], p["license_number"])},
        "organization": shared | {"name": F.greatest("_legal", "_trade", "_other"), "ein": same(r["ein"], p["ein"])},
    }

    def total(kind: str) -> Column:
        out = F.lit(0.0)
        for name, w in FUZZY_WEIGHTS[kind].items():
            out = out + w * parts[kind][name]
        return out

    return pairs.select("record_id", "provider_id", F.when(org, "organization").otherwise("individual").alias("kind"), F.when(org, total("organization")).otherwise(total("individual")).alias("confidence"))
