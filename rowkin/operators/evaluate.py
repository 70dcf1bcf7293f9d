"""Results against ground truth: tallies, confusion, reliability, blocking recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.operators.blocking import by_rows
from rowkin.schema import OUTCOMES


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def tally(results: DataFrame, sets: tuple[tuple[str, ...], ...] = ((), ("kind",), ("scenario",))) -> DataFrame:
    """Counts and rates overall and by each grouping, in one pass. Columns: decision, provider_id, expected, expected_id.

    A match with the wrong provider is a false positive and a false negative; empty denominators give null.
    """
    df = results.select("*", (F.col("decision") == "MATCH").alias("_hit"), (F.col("expected") == "MATCH").alias("_is"), F.col("provider_id").eqNullSafe(F.col("expected_id")).alias("_right"))
    columns = sorted({c for s in sets for c in s})
    cube = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns) if columns else df.groupBy()
    out = cube.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_hit") & F.col("_is") & F.col("_right")).alias("tp"),
        F.count_if(F.col("_hit") & ~(F.col("_is") & F.col("_right"))).alias("fp"),
        F.count_if(F.col("_is") & ~(F.col("_hit") & F.col("_right"))).alias("fn"),
        F.count_if(~F.col("_is") & ~F.col("_hit")).alias("tn"),
        F.count_if(F.col("_hit") & F.col("_is") & ~F.col("_right")).alias("wrong_provider"),
        F.count_if(F.col("decision") == "AMBIGUOUS").alias("ambiguous"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def confusion(results: DataFrame) -> DataFrame:
    """Expected by decided outcome, zero cells included."""
    return results.groupBy("expected").pivot("decision", list(OUTCOMES)).agg(F.count(F.lit(1))).na.fill(0)


def reliability(scored: DataFrame, p: str = "confidence", y: str = "label", bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y, gap) of all bins, empty ones too; a value on an edge is in the upper bin."""
    own = scored.withColumn("bin", F.least(F.greatest((F.col(p) * bins).cast("int"), F.lit(0)), F.lit(bins - 1)))
    got = own.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y", F.abs(F.col("mean_p") - F.col("mean_y")).alias("gap"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece, mce) of a reliability table."""
    return bins.agg((F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def brier(p: str = "confidence", y: str = "label", weight: str | None = None) -> Column:
    """Mean squared error of probabilities, an aggregate."""
    w = F.col(weight) if weight else F.lit(1.0)
    return F.sum(w * (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))) / F.sum(w)


def block_contribution(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(block, candidates, found, sole): of each block the pairs it proposes, the true ones, and the true ones that no other block proposes. truth: record_id, expected_ids."""
    wanted = truth.select("record_id", F.explode("expected_ids").alias("provider_id")).distinct().withColumn("_true", F.lit(1))
    return contribution(found.join(by_rows(wanted), ["record_id", "provider_id"], "left"), F.col("_true").isNotNull())


def contribution(found: DataFrame, true: Column) -> DataFrame:
    """``block_contribution`` of candidates that carry what tells the true ones: no pair is shuffled."""
    own = found.select(F.explode("blocks").alias("block"), F.coalesce(true, F.lit(False)).alias("_true"), (F.size("blocks") == 1).alias("_one"))
    return own.groupBy("block").agg(F.count("*").alias("candidates"), F.count_if("_true").alias("found"), F.count_if(F.col("_one") & F.col("_true")).alias("sole"))


def misses(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(scenario, missed) of the records whose expected rows are all absent from the candidates."""
    wanted = truth.select("record_id", "scenario", F.explode("expected_ids").alias("provider_id"))
    hit = wanted.join(found.select("record_id", "provider_id"), ["record_id", "provider_id"], "left_semi").select("record_id")
    return truth.join(hit, "record_id", "left_anti").groupBy("scenario").agg(F.count("*").alias("missed"))


def blocking_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(scenario, evaluated, found, recall) with a total row (scenario null). truth: record_id, expected_ids, scenario."""
    hit = found.select("record_id", "provider_id").distinct()
    wanted = truth.select("record_id", "scenario", F.explode("expected_ids").alias("provider_id"))
    met = wanted.join(hit, ["record_id", "provider_id"], "left_semi").select("record_id").distinct().withColumn("hit", F.lit(1))
    own = truth.select("record_id", "scenario").join(met, "record_id", "left")
    return own.rollup("scenario").agg(F.count("*").alias("evaluated"), F.count("hit").alias("found")).withColumn("recall", ratio(F.col("found"), F.col("evaluated")))


def candidate_counts(records: DataFrame, found: DataFrame) -> DataFrame:
    """(mean, p95, most) candidates a record; p95 is the value at place floor(0.95 n) of the sorted counts.

    The running count is over distinct counts, of which there are at most as many as the cap allows.
    """
    per = records.select("record_id").join(found.groupBy("record_id").agg(F.count("*").alias("c")), "record_id", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    levels = per.groupBy("c").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    ran = levels.withColumn("upto", F.sum("n").over(everything.orderBy("c"))).withColumn("total", F.sum("n").over(everything))
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.95))
    return ran.agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("upto") > at, F.col("c"))).alias("p95"), F.max("c").alias("most"))
