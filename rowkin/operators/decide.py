"""Decisions: scores of candidates, routing of records, and the two baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.operators import compare
from rowkin.operators.blocking import top_k
from rowkin.operators.learn import Model, calibrated, posterior
from rowkin.schema import FIELDS, level

TOP = 5
MARGIN = 0.05


@dataclass
class Bundle:
    """What decides a kind of record: weights, calibration and thresholds."""

    model: Model
    knots: list[tuple[float, float]]
    accept: float
    reject: float


def conflicts(kind: Column, vector: Column) -> Column:
    """Fields that contradict outright, of birth date, state and last name."""
    out = []
    for k in FIELDS:
        names = list(FIELDS[k])
        for f in ("dob", "state", "last_name"):
            if f in names:
                out.append(F.when((kind == k) & (vector[names.index(f)] == level(k, f, "DISAGREE")), F.lit(f)))
    return F.array_compact(F.array(*out))


def scored(pairs: DataFrame, bundles: dict[str, Bundle]) -> DataFrame:
    """Adds match_weight, posterior, confidence, npi_exact, conflicts and the thresholds of the pair's kind."""
    kind, vector = F.col("kind"), F.col("vector")

    def by_kind(value) -> Column:
        out = F.lit(None)
        for k, b in bundles.items():
            out = F.when(kind == k, value(b)).otherwise(out)
        return out

    df = pairs.filter(kind.isin(list(bundles))).withColumn("match_weight", by_kind(lambda b: b.model.weight(vector)))
    df = df.withColumn("posterior", by_kind(lambda b: posterior(F.col("match_weight"), b.model.share))).withColumn("confidence", by_kind(lambda b: calibrated(F.col("match_weight"), b.knots)))
    df = df.withColumn("t_accept", by_kind(lambda b: F.lit(float(b.accept)))).withColumn("t_reject", by_kind(lambda b: F.lit(float(b.reject))))
    return df.withColumn("npi_exact", vector[0] == level("individual", "npi", "VALID_EXACT")).withColumn("conflicts", conflicts(kind, vector))


def ranked(pairs: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best candidates of each record, by confidence, weight, then id."""
    return top_k(pairs.drop("rank"), ["record_id"], [F.desc("confidence"), F.desc("match_weight"), F.asc("provider_id")], k)


def routed(records: DataFrame, best: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One decision a record from its ranked candidates: (record_id, decision, route, reason, provider_id, confidence, margin)."""
    own = best.groupBy("record_id").agg(
        F.min_by(F.struct("provider_id", "confidence", "match_weight", "cross_type", "t_accept", "t_reject"), "rank").alias("top"),
        F.min_by("confidence", F.when(F.col("rank") == 2, 2)).alias("second"),
        F.min_by(F.struct("provider_id", "confidence", "conflicts"), F.when(F.col("npi_exact"), F.col("rank"))).alias("exact"),
        F.count_if("npi_exact").alias("holders"),
    )
    df = records.select("record_id").join(own, "record_id", "left")
    top, exact, clash = F.col("top"), F.col("exact"), F.size("exact.conflicts")
    gap = top["confidence"] - F.col("second")
    at = lambda decision, route, reason, who, confidence: F.struct(F.lit(decision).alias("decision"), F.lit(route).alias("route"), reason.alias("reason"), who.alias("provider_id"), confidence.alias("confidence"))
    nobody = F.lit(None).cast(best.schema["provider_id"].dataType)
    first, score = top["provider_id"], top["confidence"]
    chain = (
        F.when(top.isNull(), at("NO_MATCH", "NO_CANDIDATES", F.lit("NO_CANDIDATES"), nobody, F.lit(None).cast("double")))
        .when((F.col("holders") > 0) & ((clash >= 2) | (F.col("holders") > 1)), at("AMBIGUOUS", "DETERMINISTIC", F.lit("NPI_EXACT_CONFLICT"), exact["provider_id"], exact["confidence"]))
        .when((F.col("holders") > 0) & (clash == 0), at("MATCH", "DETERMINISTIC", F.lit("NPI_EXACT"), exact["provider_id"], F.greatest(exact["confidence"], top["t_accept"])))
        .when((score >= top["t_accept"]) & (gap < margin), at("AMBIGUOUS", "PROBABILISTIC", F.lit("THIN_MARGIN"), first, score))
        .when(score >= top["t_accept"], at("MATCH", "PROBABILISTIC", F.when(top["cross_type"], "CROSS_TYPE").otherwise("ABOVE_ACCEPT"), first, score))
        .when(score < top["t_reject"], at("NO_MATCH", "PROBABILISTIC", F.lit("BELOW_REJECT"), nobody, score))
        .otherwise(at("AMBIGUOUS", "PROBABILISTIC", F.lit("GREY_BAND"), first, score))
    )
    return df.withColumn("d", chain).select("record_id", "d.*", gap.alias("margin"))


def fault(kind: Column, vector: Column) -> Column:
    """Why a pair cannot be scored, or null: an unknown kind, no vector, one of another length, or a code that its field has no level for."""
    out = F.when(kind.isNull() | ~kind.isin(*FIELDS), F.concat(F.lit("unknown kind: "), F.coalesce(kind, F.lit("none")))).when(vector.isNull(), "no vector")
    for k, fields in FIELDS.items():
        tops = F.array(*(F.lit(len(levels)) for levels in fields.values()))
        bad = F.exists(F.arrays_zip(vector.alias("v"), tops.alias("n")), lambda x: x["v"].isNull() | (x["v"] < 0) | (x["v"] >= x["n"]))
        out = out.when((kind == k) & (F.size(vector) != len(fields)), F.concat(F.lit("vector of length "), F.size(vector).cast("string"))).when((kind == k) & bad, "level out of range")
    return out


def isolated(records: DataFrame, pairs: DataFrame, bundles: dict[str, Bundle], margin: float = MARGIN) -> DataFrame:
    """One outcome a record: its decision, or ``error`` and no decision if one of its pairs cannot be scored.

    A bad record fails alone: its pairs are set aside before any score is computed, and all others are decided as if it
    were not there. ``listings.outcomes`` counts records without a decision as failed.
    """
    checked = pairs.withColumn("_error", fault(F.col("kind"), F.col("vector")))
    errors = checked.where("_error is not null").groupBy("record_id").agg(F.min("_error").alias("error"))
    good = checked.where("_error is null").drop("_error").join(errors, "record_id", "left_anti")
    fine = records.select("record_id").join(errors, "record_id", "left_anti")
    decided = routed(fine, ranked(scored(good, bundles)), margin).withColumn("error", F.lit(None).cast("string"))
    failed = records.select("record_id").join(errors, "record_id")
    return decided.unionByName(failed, allowMissingColumns=True)


def deterministic(records: DataFrame, master: DataFrame) -> DataFrame:
    """Baseline: exactly one master row with the record's valid identifier is a match, several are ambiguous."""
    hits = records.filter("npi <> ''").select("record_id", "npi").join(master.filter("npi <> ''").select("npi", F.col("record_id").alias("provider_id")), "npi")
    found = hits.groupBy("record_id").agg(F.count("*").alias("n"), F.min("provider_id").alias("provider_id"))
    out = records.select("record_id").join(found, "record_id", "left")
    return out.select("record_id", F.when(F.col("n") == 1, "MATCH").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NO_MATCH").alias("decision"), F.when(F.col("n") >= 1, F.col("provider_id")).alias("provider_id"))


def banded(records: DataFrame, pairs: DataFrame, accept: float = 0.88, reject: float = 0.70) -> DataFrame:
    """Baseline: the best pair's ``score`` against two cuts."""
    first = Window.partitionBy("record_id").orderBy(F.desc("score"), "provider_id")
    best = pairs.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    out = records.select("record_id").join(best.select("record_id", "provider_id", "score"), "record_id", "left")
    return out.select("record_id", F.when(F.col("score") >= accept, "MATCH").when(F.col("score") >= reject, "AMBIGUOUS").otherwise("NO_MATCH").alias("decision"), F.when(F.col("score") >= reject, F.col("provider_id")).alias("provider_id"), "score")


def decided_by(strategy: str, records: DataFrame, master: DataFrame, found: DataFrame, pairs: DataFrame | None = None, bundles: dict[str, Bundle] | None = None) -> DataFrame:
    """(record_id, decision, provider_id) by the named strategy: deterministic, fuzzy or probabilistic (which needs vectors and bundles)."""
    if strategy == "deterministic":
        return deterministic(records, master)
    if strategy == "fuzzy":
        return banded(records, compare.similarity(found, records, master).withColumnRenamed("confidence", "score"), compare.FUZZY_ACCEPT, compare.FUZZY_REJECT).drop("score")
    if strategy == "probabilistic":
        if pairs is None or bundles is None:
            raise ValueError("the probabilistic strategy needs vectors and bundles")
        return routed(records, ranked(scored(pairs, bundles))).select("record_id", "decision", "provider_id")
    raise ValueError(f"no strategy {strategy!r}")
