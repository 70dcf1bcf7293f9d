"""The whole reconciliation: normalized records to candidates, vectors, learned weights, calibrated decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.functions.text import hash_share
from rowkin.operators import blocking, compare, decide, learn, listings
from rowkin.operators.normalize import stored_normal
from rowkin.schema import FIELDS
from rowkin.storage import staged


def prepared(providers: DataFrame, sanctions: DataFrame, cap: int = blocking.CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(normalized records, normalized master, candidate vectors), all read from staged tables: later steps read them many times.

    Records whose lists are full by exact blocks are compared where these are listed; only the others' pairs are joined with both sides.
    """
    master, records = stored_normal(providers, "provider_id", "master"), stored_normal(sanctions, "record_id", "records", claims=True)
    known = lambda df, name: compare.side(df, name).filter("id is not null")
    hits = staged(compare.compared(blocking.exact(records, master, cap, known(records, "r"), known(master, "p"))), "exact")
    rest = staged(compare.vectors(staged(blocking.completed(hits, records, master, cap), "completed"), records, master), "vectors")
    return records, master, hits.filter(F.col("listed") == cap).drop("listed").unionByName(rest)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with ``label``: 1 if the truth names that provider for the record, else 0. truth: record_id, expected_id."""
    return pairs.join(blocking.by_rows(truth.select("record_id", "expected_id")), "record_id", "left").withColumn("label", F.coalesce((F.col("provider_id") == F.col("expected_id")).cast("int"), F.lit(0))).drop("expected_id")


def fitted(pairs: DataFrame, truth: DataFrame, holdout: float = 0.3, precision: float = 0.99, recall: float = 0.99) -> dict[str, decide.Bundle]:
    """Weights from unlabelled patterns; calibration on records outside the hold-out; thresholds on the held-out ones."""
    models = learn.fit_tally(learn.pattern_tally(pairs))
    out = {}
    weight = F.lit(None).cast("double")
    for kind, model in models.items():
        weight = F.when(F.col("kind") == kind, model.weight(F.col("vector"))).otherwise(weight)
    # the best pair of each record first, of all kinds in one pass: labels are joined with a row a record
    weighed = pairs.select("record_id", "provider_id", "kind", weight.alias("weight"))
    first = blocking.top_k(weighed, ["kind", "record_id"], [F.desc("weight"), F.asc("provider_id")], 1, "_best")
    known = staged(labelled(first, truth).withColumn("held", hash_share(F.lit("holdout:"), F.col("record_id").cast("string")) < holdout), "best")
    for kind, model in models.items():
        best = known.filter(F.col("kind") == kind)
        knots = learn.isotonic_knots(best.filter("not held"))
        if not knots:
            raise learn.Degenerate(f"{kind} has no records outside the hold-out to calibrate on")
        cuts = learn.choose_thresholds(best.filter("held").withColumn("confidence", learn.calibrated(F.col("weight"), knots)), precision, recall)
        out[kind] = decide.Bundle(model, knots, cuts.accept, cuts.reject)
    return out


def decided(records: DataFrame, pairs: DataFrame, bundles: dict[str, decide.Bundle]) -> DataFrame:
    return decide.routed(records, decide.ranked(decide.scored(pairs, bundles)))


#: Labels that a retune needs in all and of a kind, and the share of them that judges it.
MIN_LABELS, MIN_PER_KIND, HOLDOUT = 100, 30, 0.3


class NotEnough(ValueError):
    """Too few labels to learn from; ``counts`` says how many there are."""

    def __init__(self, message: str, counts: dict[str, int]):
        super().__init__(message)
        self.counts = counts


@dataclass
class Retune:
    """A retuned config: bundles, a report a kind (refit or why not), and the gate's row on the held-out labels."""

    bundles: dict[str, decide.Bundle]
    reports: dict[str, dict]
    gate: dict


def checked(labels: DataFrame, least: int = MIN_LABELS) -> dict[str, int]:
    """Counts of labels; NotEnough below ``least``, or below a tenth of it (3 at least) of either class."""
    counts = listings.label_counts(labels, source=["review", "audit", "voluntary"], kind=list(FIELDS)).first().asDict()
    floor = max(3, -(-least // 10))
    if counts["total"] < least or min(counts["positives"], counts["negatives"]) < floor:
        raise NotEnough(f"{counts['total']} labels ({counts['positives']} of matches, {counts['negatives']} of others), {least} are needed and {floor} of each", counts)
    return counts


def retuned(parent: dict[str, decide.Bundle], tally: DataFrame, labels: DataFrame, population: DataFrame | None = None, *, precision: float = 0.99, recall: float = 0.99, noise: float = 0.0, least: int = MIN_LABELS, least_of_kind: int = MIN_PER_KIND, holdout: float = HOLDOUT, seed: int = 0, **options) -> Retune:
    """Weights, calibration and cuts refitted from reviewers' labels, and whether they should replace ``parent``.

    labels: key, kind, vector, label, weight, source, in_tally (``listings.collected_labels`` with the vectors); tally:
    kind, vector, n of all pairs, from which labelled pairs that it holds are taken; population: record_id, kind, vector
    of a run's candidates, from whose calibrated scores the cuts are then chosen. A hash of the key splits the labels.
    Verdicts outside the hold-out join the fit, each wrong with probability ``noise``; voluntary ones stand for an
    unknown number of pairs and neither calibrate nor judge. A kind with too few labels of its own, or whose fit
    degenerates, keeps its parent's bundle, and its report says so.
    """
    checked(labels, least)
    known = staged(labels.withColumn("held", hash_share(F.lit(f"{seed}:holdout:"), F.col("key").cast("string")) < holdout).withColumn("true", learn.denoised(F.col("label"), noise)), "labels")
    sizes = {(r["kind"], r["held"], r["label"]): r["n"] for r in known.groupBy("kind", "held", "label").agg(F.count("*").alias("n")).collect()}
    fitting = known.filter("not held")
    seen = fitting.groupBy("kind", "vector", "label").agg(F.count("*").alias("n")).collect()  # bounded by the levels of the fields
    rest = learn.less(tally, learn.pattern_tally(fitting.filter("in_tally")))
    bundles, reports = dict(parent), {}
    for kind, old in parent.items():
        mine, positives, negatives = sum(n for (k, _, _), n in sizes.items() if k == kind), sizes.get((kind, False, 1), 0), sizes.get((kind, False, 0), 0)
        report = reports[kind] = {"labels": mine, "fit": positives + negatives, "holdout": mine - positives - negatives, "refit": False}
        rows = rest.filter(F.col("kind") == kind).orderBy("vector").collect()  # bounded likewise
        if mine < least_of_kind or not positives or not negatives or not rows:
            report["reason"] = f"{mine} labels of this kind, both classes and {least_of_kind} are needed"
            continue
        verdicts = sorted((list(r["vector"]), r["label"], r["n"]) for r in seen if r["kind"] == kind)
        try:
            model = learn.best_fit(kind, [(r["vector"], r["n"]) for r in rows], verdicts=verdicts, noise=noise, begin=old.model, seed=seed, **options)
        except learn.Degenerate as e:
            report["reason"] = f"the fit degenerates: {e}"
            continue
        usable = known.filter((F.col("kind") == kind) & (F.col("source") != "voluntary")).withColumn("bits", model.weight(F.col("vector")))
        knots = learn.isotonic_knots(usable.filter("not held"), "bits", "true", count="weight")
        side = "held" if usable.filter("held").limit(1).count() else "not held"
        cuts = learn.choose_thresholds(usable.filter(side).withColumn("confidence", learn.calibrated(F.col("bits"), knots)), precision, recall, label="true", weight="weight")
        bundles[kind] = decide.Bundle(model, knots, cuts.accept, cuts.reject)
        report |= {"refit": True, "share": model.share, "parent_share": old.model.share, "rounds": len(model.trace), "cuts_from": "labels", **cuts._asdict()}
    if population is not None and any(r["refit"] for r in reports.values()):
        best = staged(blocking.top_k(decide.scored(population, bundles), ["record_id"], [F.desc("confidence"), F.asc("kind")], 1, "_best").select("kind", "confidence"), "population")
        for kind, report in reports.items():
            own = best.filter(F.col("kind") == kind)
            if report["refit"] and own.limit(1).count():
                cuts = learn.expected_thresholds(own, precision, recall)
                bundles[kind] = decide.Bundle(bundles[kind].model, bundles[kind].knots, cuts.accept, cuts.reject)
                report |= {"cuts_from": "population", "label_accept": report["accept"], "label_reject": report["reject"], **cuts._asdict()}
    judges = known.filter((F.col("source") != "voluntary") & F.col("held"))
    for name, config in (("new", bundles), ("old", parent)):
        judges = decide.scored(judges, config).withColumnsRenamed({"confidence": name, "t_accept": f"{name}_accept", "t_reject": f"{name}_reject"}).drop("match_weight", "posterior", "npi_exact", "conflicts")
    return Retune(bundles, reports, listings.gate(judges, precision, noise=noise).first().asDict())
