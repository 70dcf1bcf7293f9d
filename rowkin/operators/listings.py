"""What the screens and a refit read from the engine's tables: listings, labels with weights, populations, counts and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.functions import text as T
from rowkin.operators.learn import denoised


def listing(df: DataFrame, newest: str, key: str, limit: int | None = None, **equal) -> DataFrame:
    """Rows that hold the given values (None asks for nothing), newest first, ties by key."""
    for column, value in equal.items():
        df = df if value is None else df.filter(F.col(column) == value)
    df = df.orderBy(F.desc_nulls_last(newest), F.asc(key))
    return df if limit is None else df.limit(limit)


def ranked_in(candidates: DataFrame, results: DataFrame, records: DataFrame, provider_id, limit: int = 50) -> DataFrame:
    """The results that ranked a master row, history included, newest first. The candidates are filtered before they are joined."""
    own = candidates.filter(F.col("provider_id") == provider_id)
    return own.join(results, "result_id").join(records, "record_id").orderBy(F.desc("created_at"), "result_id", "rank").limit(limit)


def collected_labels(feedback: DataFrame, results: DataFrame, runs: DataFrame, tally_run=None) -> DataFrame:
    """(result_id, label, source, weight, in_tally): the newest verdict on each result.

    A verdict on an audited result stands for 1 / audit_rate results; other verdicts stand for themselves, and those on
    results that were rejected without an audit are voluntary. feedback: feedback_id, result_id, verdict, created_at;
    results: result_id, run_id, decision, audit_sampled; runs: run_id, audit_rate.
    """
    last = feedback.groupBy("result_id").agg(F.max_by("verdict", F.struct("created_at", "feedback_id")).alias("verdict"))
    rows = last.join(results.select("result_id", "run_id", "decision", "audit_sampled"), "result_id").join(runs.select("run_id", "audit_rate"), "run_id")
    audited = F.coalesce(F.col("audit_sampled") & (F.col("audit_rate") > 0), F.lit(False))
    source = F.when(audited, "audit").when(F.col("decision") == "NO_MATCH", "voluntary").otherwise("review")
    return rows.select("result_id", (F.col("verdict") == "TRUE_MATCH").cast("int").alias("label"), source.alias("source"), F.when(audited, 1.0 / F.col("audit_rate")).otherwise(1.0).alias("weight"), F.coalesce(F.col("run_id") == F.lit(tally_run), F.lit(False)).alias("in_tally"))


def label_counts(labels: DataFrame, **classes: list[str]) -> DataFrame:
    """One row: all labels, positives, negatives, and a count for each listed value of each named column."""
    each = [F.count_if(F.col(c) == v).alias(v) for c, values in classes.items() for v in values]
    return labels.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), *each)


def population(candidates: DataFrame, results: DataFrame, run_id) -> DataFrame:
    """(result_id, vectors): the stored candidates' vectors of each result of a run, by rank. A result stores at most as many as the ranking kept."""
    own = results.filter(F.col("run_id") == run_id).select("result_id")
    listed = candidates.join(own, "result_id", "left_semi").groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("c"))
    return listed.select("result_id", F.col("c.vector").alias("vectors"))


def with_patterns(runs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Runs whose pattern tallies are stored."""
    return runs.join(patterns.select("run_id"), "run_id", "left_semi")


def outcomes(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Counts of a run's outcomes; a record without a decision has failed."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return results.groupBy(by).agg(F.count("*").alias("records_total"), of("MATCH").alias("matched"), of("AMBIGUOUS").alias("ambiguous"), of("NO_MATCH").alias("no_match"), F.count_if(F.col("decision").isNull()).alias("failed"))


def _share(a: Column, b: Column) -> Column:
    """A rate, clipped, as counts of labels that may err can pass 0 or 1; null if there is nothing to count."""
    return F.when(b > 0, F.round(F.least(F.greatest(a / b, F.lit(0.0)), F.lit(1.0)), 6))


#: The rates that judge a config on labels.
RATES = ("n", "precision", "recall", "missed", "review_share", "ece", "brier")


def _rates(scored: DataFrame, by: list[str], accept: Column, reject: Column, p: str, y: str, weight: str, noise: float, bins: int) -> DataFrame:
    """``RATES`` of each group, in two aggregations, of which the second sees a row a bin."""
    w, c, t = F.col(weight).cast("double"), F.col(p), denoised(F.col(y), noise)
    taken, left = c >= accept, (c < accept) & (c < reject)
    when = lambda test, v: F.sum(F.when(test, v).otherwise(0.0))
    slot = F.least(F.greatest((c * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    per = scored.groupBy(*by, slot.alias("bin")).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * t).alias("pos"), F.sum(w * c).alias("mass"), when(taken, w).alias("acc"), when(taken, w * t).alias("hit"), when(left, w * t).alias("lost"), when(~taken & ~left, w).alias("grey"), F.sum(w * (c - t) * (c - t)).alias("err"))
    s = F.sum
    return per.groupBy(*by).agg(F.coalesce(s("n"), F.lit(0)).alias("n"), _share(s("hit"), s("acc")).alias("precision"), _share(s("hit"), s("pos")).alias("recall"), _share(s("lost"), s("pos")).alias("missed"), _share(s("grey"), s("w")).alias("review_share"), F.round(s(F.abs(F.col("mass") - F.col("pos"))) / s("w"), 6).alias("ece"), F.round(s("err") / s("w"), 6).alias("brier"))


def judged(scored: DataFrame, accept: float, reject: float, p: str = "confidence", y: str = "label", weight: str = "weight", bins: int = 10, noise: float = 0.0) -> DataFrame:
    """One row: what two cuts do on weighted labels (n, precision, recall, missed, review_share, ece, brier).

    ``missed`` is the share of the true matches below the lower cut. Labels that err with probability ``noise`` are
    counted for what they stand for on average, so rates are estimates and clipped.
    """
    return _rates(scored, [], F.lit(accept), F.lit(reject), p, y, weight, noise, bins)


#: By how much a rate may be worse before it counts as worse, and matches lost below the lower cut.
TOLERANCE, MISSED_TOLERANCE = 0.01, 0.02


def recommendation(target: float, new: str = "new_", old: str = "old_") -> tuple[Column, Column]:
    """(activate, outcome) from the rates of a new config and the one in use on the same labels.

    nothing_to_compare: no labels, or one of them accepts nothing; precision_falls: below both the old one and the
    target by more than the tolerance; misses_more, reviews_more: than the old one; no_difference: no rate better by
    more than the tolerance; else improves, the only one that activates. A rate that either lacks tells nothing.
    """
    a, b = (lambda c: F.col(new + c)), (lambda c: F.col(old + c))
    gain = {c: F.coalesce((a(c) - b(c)) if up else (b(c) - a(c)), F.lit(0.0)) for c, up in (("precision", True), ("recall", True), ("missed", False), ("review_share", False))}
    none = (F.coalesce(a("n"), F.lit(0)) == 0) | a("precision").isNull() | b("precision").isNull()
    outcome = (
        F.when(none, "nothing_to_compare")
        .when(a("precision") < F.least(b("precision"), F.lit(target)) - TOLERANCE, "precision_falls")
        .when(gain["missed"] < -MISSED_TOLERANCE, "misses_more")
        .when(gain["review_share"] < -TOLERANCE, "reviews_more")
        .when(F.greatest(*gain.values()) <= TOLERANCE, "no_difference")
        .otherwise("improves")
    )
    return outcome == "improves", outcome


def gate(labels: DataFrame, target: float = 0.99, by: tuple[str, ...] = (), weight: str = "weight", noise: float = 0.0, bins: int = 10) -> DataFrame:
    """A row for each value of ``by`` (one row in all without): new_ and old_ rates, activate, outcome.

    labels: label, weight, and for both configs the confidence and cuts that a row has under it: new, new_accept,
    new_reject, old, old_accept, old_reject. Both are judged in one pass over the same rows.
    """
    own = F.explode(F.array(*(F.struct(F.lit(c).alias("config"), F.col(c).cast("double").alias("_p"), F.col(f"{c}_accept").cast("double").alias("_accept"), F.col(f"{c}_reject").cast("double").alias("_reject")) for c in ("new", "old"))))
    each = labels.select(*by, F.col("label").alias("_y"), F.col(weight).alias("_w"), own.alias("_c")).select(*by, "_y", "_w", "_c.*")
    rates = _rates(each, [*by, "config"], F.col("_accept"), F.col("_reject"), "_p", "_y", "_w", noise, bins)
    wide = rates.groupBy(*by).agg(*(F.max(F.when(F.col("config") == c, F.col(r))).alias(f"{c}_{r}") for c in ("new", "old") for r in RATES))
    activate, outcome = recommendation(target)
    return wide.withColumn("activate", activate).withColumn("outcome", outcome)


def stratified(rows: DataFrame, stratum: str, sampled: Column, expected_matches: Column) -> DataFrame:
    """One row (tp, fp, review, precision, recall, f1) estimated from strata of which some were only sampled.

    rows: all records with their stratum; ``sampled`` tells which were judged (all of an exact stratum), and these have
    tp, fp and review (0 or 1). A stratum's sums are scaled by its size over its sample; one without a sample counts as
    none. ``expected_matches`` is an aggregate.
    """
    judged_only = lambda c: F.sum(F.when(sampled, F.col(c)).otherwise(0))
    per = rows.groupBy(stratum).agg(F.count("*").alias("size"), F.count_if(sampled).alias("n"), expected_matches.alias("expected"), *(judged_only(c).alias(c) for c in ("tp", "fp", "review")))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("n") > 0, F.col(c) * F.col("size") / F.col("n"))), F.lit(0.0)).alias(c)
    one = per.agg(total("tp"), total("fp"), total("review"), F.sum("expected").alias("expected"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = one.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("expected")))
    return one.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("expected")


def block_statistics(keys: DataFrame) -> DataFrame:
    """(block, n_keys, n_rows, largest) of a table (record_id, block, key): how many keys a block has, and how many rows the commonest."""
    per = keys.groupBy("block", "key").agg(F.count("*").alias("n"))
    return per.groupBy("block").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"))


def audit_drawn(results: DataFrame, rate: float, run_id: str) -> DataFrame:
    """Rejected records with at least one candidate that the hash of run and record draws into the audit."""
    drawn = T.hash_share(F.lit(f"{run_id}:"), F.col("record_id").cast("string")) < rate
    return results.filter((F.col("decision") == "NO_MATCH") & (F.col("n_candidates") > 0) & drawn)


def with_ordinals(new: DataFrame, order: str, highest: int | None, width: int = 65536) -> DataFrame:
    """Adds dense ordinals after ``highest`` (None: from 0) in the order of a unique integer column.

    Two levels, so that no task sorts more than ``width`` rows: places within ranges of the column, and what lies before a range.
    """
    own = new.withColumn("_wide", F.floor(F.col(order) / width))
    place = F.row_number().over(Window.partitionBy("_wide").orderBy(order)) - 1
    ahead = Window.partitionBy(F.lit(0)).orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = own.groupBy("_wide").agg(F.count("*").alias("_n")).select("_wide", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    start = 0 if highest is None else highest + 1
    return own.withColumn("_place", place).join(base, "_wide").withColumn("ordinal", (F.col("_base") + F.col("_place") + start).cast("long")).drop("_wide", "_place", "_base")


def config_summaries(configs: DataFrame, runs: DataFrame, active_id) -> DataFrame:
    """Each config (config_id, version, parent_id, ...) with its parent's version, how many runs used it, the latest, and whether it is active."""
    used = runs.groupBy("config_id").agg(F.count("*").alias("runs"), F.max("created_at").alias("latest_run_at"))
    parents = configs.select(F.col("config_id").alias("parent_id"), F.col("version").alias("parent_version"))
    df = configs.join(parents, "parent_id", "left").join(used, "config_id", "left")
    return df.withColumn("runs", F.coalesce("runs", F.lit(0))).withColumn("active", F.col("config_id") == F.lit(active_id))


def config_delta(first: dict, second: dict) -> dict[str, tuple]:
    """The settings in which two runs differ, nested ones by their joined names, sorted."""

    def flat(settings: dict, prefix: str = "") -> dict:
        out = {}
        for k, v in settings.items():
            out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
        return out

    a, b = flat(first), flat(second)
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def strongest(weights: DataFrame, top: int = 3) -> DataFrame:
    """The weights (field, level, weight) of the largest size, ``top`` for each field there is, counted over all fields."""
    fields = weights.agg(F.count_distinct("field").alias("k"))
    ranks = F.row_number().over(Window.orderBy(F.desc(F.abs("weight")), "field", "level"))  # a row a level of a model
    return weights.withColumn("rank", ranks).join(F.broadcast(fields)).filter(F.col("rank") <= top * F.col("k")).drop("k")


def by_strategy(cells: DataFrame, strategies: list[str], value: str = "f1") -> DataFrame:
    """A row a level, a column a strategy; the strategies are named, so that no pass over the data looks for them."""
    return cells.groupBy("level").pivot("strategy", strategies).agg(F.first(value, ignorenulls=True))


def expected_set(expected: Column, plausible: Column) -> Column:
    """The expected id and the plausible ones, each once, in this order; nulls are left out."""
    return F.array_compact(F.array_union(F.array(expected), F.coalesce(plausible, F.array().cast("array<string>"))))
