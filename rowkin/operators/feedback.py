"""Reviewers' actions and what is learned from them: outcomes, captured vectors, training labels, versions of configs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.operators import listings
from rowkin.operators.compare import coded
from rowkin.operators.decide import Bundle
from rowkin.schema import FIELDS


def reviewed(results: DataFrame, candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """One outcome an action: ``error`` or the new review_status, and for decisions ``feedback``.

    results: result_id, review_status, decision, provider_id (the engine's choice), kind; candidates: result_id,
    provider_id, rank, levels (map of field to level name); actions: action_id, result_id, action (approve, reject,
    escalate), provider_id (may be null), comment, is_admin. Approving takes the named candidate or the engine's choice;
    an ambiguous result needs a name. Rejecting and escalating need a comment; what was escalated an admin rejects. The
    label of a rejection goes to the candidate named, else chosen, else first (ties by id); none is captured if that is no candidate.
    A result's candidates are few (what the ranking kept).
    """
    by_rank = lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).when(a["provider_id"] < b["provider_id"], -1).when(a["provider_id"] > b["provider_id"], 1).otherwise(0)
    listed = candidates.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("rank", "provider_id", "levels")), by_rank).alias("_listed"))
    known = results.select("result_id", "review_status", "decision", F.col("provider_id").alias("_chosen"), "kind", F.lit(True).alias("_known"))
    df = actions.join(known, "result_id", "left").join(listed, "result_id", "left")
    c, status, act = F.col, F.col("review_status"), F.col("action")
    target = F.coalesce("provider_id", "_chosen", F.when(act == "reject", F.try_element_at("_listed", F.lit(1))["provider_id"]))
    hit = F.try_element_at(F.filter("_listed", lambda x: x["provider_id"] == c("_target")), F.lit(1))
    df = df.withColumn("_target", target).withColumn("_hit", hit)
    silent = act.isin("reject", "escalate") & (F.trim(F.coalesce("comment", F.lit(""))) == "")
    error = (
        F.when(c("_known").isNull(), "not_found")
        .when(~F.coalesce(act.isin("approve", "reject", "escalate"), F.lit(False)), "unknown_action")
        .when(silent, "comment_required")
        .when((act == "approve") & (status == "APPROVED"), "already_approved")
        .when(act.isin("approve", "reject") & status.isin("APPROVED", "REJECTED"), "already_reviewed")
        .when((act == "reject") & (status == "ESCALATED") & ~F.coalesce("is_admin", F.lit(False)), "escalated_to_admin")
        .when((act == "escalate") & (status != "PENDING"), "not_pending")
        .when((act == "approve") & c("provider_id").isNull() & (c("decision") == "AMBIGUOUS"), "provider_choice_required")
        .when((act == "approve") & c("_target").isNull(), "provider_required")
        .when((act == "approve") & c("_hit").isNull(), "provider_not_a_candidate")
    )
    df = df.withColumn("error", error)
    now = F.when(c("error").isNotNull(), status).when(act == "approve", "APPROVED").when(act == "reject", "REJECTED").otherwise("ESCALATED")
    label = F.when(act == "approve", "TRUE_MATCH").otherwise("FALSE_MATCH")
    seen = F.when(c("error").isNull() & act.isin("approve", "reject") & c("_hit").isNotNull(), F.struct(label.alias("verdict"), c("_hit.provider_id"), c("_hit.rank"), c("_hit.levels"), c("kind").alias("model")))
    return df.select("action_id", "result_id", "action", "error", now.alias("review_status"), F.when(c("error").isNull() & (act == "approve"), c("_target")).alias("approved_provider_id"), seen.alias("feedback"))


def vector_of(levels: Column, preferred: Column) -> Column:
    """Stored level names as struct(kind, vector): of the preferred kind if they fit it, else of the first kind that they fit, else null."""

    def fitting(kind: str) -> Column:
        v = coded(levels, kind)
        return F.when(levels.isNotNull() & ~F.exists(v, lambda x: x.isNull()), F.struct(F.lit(kind).alias("kind"), v.alias("vector")))

    first = [F.when(preferred == k, fitting(k)) for k in FIELDS]
    return F.coalesce(*first, *map(fitting, FIELDS))


def training_labels(feedback: DataFrame, results: DataFrame, runs: DataFrame, tally_run=None) -> DataFrame:
    """``listings.collected_labels`` with key, kind and vector, as ``linkage.retuned`` takes them; kind is null where the stored levels fit no kind.

    feedback has levels and model besides; those of the newest verdict count.
    """
    newest = F.struct("created_at", "feedback_id")
    seen = feedback.groupBy("result_id").agg(F.max_by(F.struct("levels", "model"), newest).alias("_s"))
    found = listings.collected_labels(feedback, results, runs, tally_run).join(seen, "result_id")
    return found.withColumn("_v", vector_of(F.col("_s.levels"), F.col("_s.model"))).select(F.col("result_id").alias("key"), "_v.kind", "_v.vector", "label", "weight", "source", "in_tally")


def usable(labels: DataFrame) -> DataFrame:
    return labels.filter("kind is not null")


def training_prefix(feedback: DataFrame, most: int = 10_000) -> DataFrame:
    """The oldest feedback, a prefix that later rows do not change (a limit is what is asked for)."""
    return feedback.orderBy("created_at", "feedback_id").limit(most)


def next_versions(parents: DataFrame, taken: DataFrame) -> DataFrame:
    """(version, next): ``<root>.r<n>`` with the first n free from the parent's own on. Both have ``version``."""
    pattern = r"^(.+)\.r(\d+)$"
    parts = lambda df: df.select("version", F.regexp_extract("version", pattern, 1).alias("_r"), F.regexp_extract("version", pattern, 2).alias("_n"))
    own = parts(parents.select("version").distinct()).select("version", F.when(F.col("_r") == "", F.col("version")).otherwise(F.col("_r")).alias("root"), F.when(F.col("_r") == "", 1).otherwise(F.try_add(F.col("_n").cast("long"), F.lit(1))).cast("long").alias("least"))
    used = parts(taken).filter("_r <> ''").select(F.col("_r").alias("root"), F.col("_n").cast("long").alias("n"), F.col("_n").cast("long").cast("string").alias("_same"), "_n").filter("_same = _n").select("root", "n").distinct()
    # the first free number is the least itself or one after a used one
    tries = own.select("version", "root", F.col("least").alias("n")).unionByName(own.join(used, "root").filter("n >= least").select("version", "root", (F.col("n") + 1).alias("n")))
    free = tries.join(used, ["root", "n"], "left_anti").groupBy("version", "root").agg(F.min("n").alias("n"))
    return free.select("version", F.concat("root", F.lit(".r"), F.col("n").cast("string")).alias("next"))


def shifted(bundles: dict[str, Bundle], delta: float) -> dict[str, Bundle]:
    """Bundles whose accept cut is lower by ``delta``, but above the reject cut by 0.01 at least, so that a grey band stays."""
    return {k: replace(b, accept=round(max(b.reject + 0.01, b.accept - delta), 6)) for k, b in bundles.items()}
