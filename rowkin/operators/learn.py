"""Learning on tallies: expectation-maximization over pattern counts, isotonic calibration, thresholds.

Spark counts patterns, (weight, label) steps and score levels; what reaches the driver is one row a distinct pattern or
half-unit of weight, which the number of levels bounds, not the number of pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.schema import FIELDS

FLOOR = 1e-6


def pattern_tally(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(kind, vector, ..., n): how many pairs have each pattern."""
    return pairs.groupBy("kind", "vector", *by).agg(F.count("*").alias("n"))


def less(tally: DataFrame, taken: DataFrame) -> DataFrame:
    """A tally without the pairs of another one, never below zero."""
    other = taken.select("kind", "vector", F.col("n").alias("_m"))
    return tally.join(other, ["kind", "vector"], "left").withColumn("n", F.greatest(F.lit(0), F.col("n") - F.coalesce("_m", F.lit(0)))).drop("_m").filter("n > 0")


@dataclass
class Model:
    """Fellegi-Sunter tables of a kind: P(level | match), P(level | other), share of matches."""

    kind: str
    m: list[list[float]]
    u: list[list[float]]
    share: float
    trace: list[float] = field(default_factory=list)

    def weights(self) -> list[list[float]]:
        return [[math.log2(max(a, FLOOR) / max(b, FLOOR)) for a, b in zip(x, y, strict=True)] for x, y in zip(self.m, self.u, strict=True)]

    def weight(self, vector: Column) -> Column:
        """Sum of the fields' weights, in the order of fields."""
        parts = [F.element_at(F.array(*map(F.lit, w)), vector[i] + 1) for i, w in enumerate(self.weights())]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total


def posterior(weight: Column, share: float) -> Column:
    z = weight * math.log(2) + math.log(share / (1 - share))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


class Degenerate(ValueError):
    """The data do not tell matches from others."""


#: Shares of matches that fits start from, in turn.
STARTS = (0.05, 0.01, 0.2)
#: Fits a kind, and by how much the tables of all but the first are shaken.
RESTARTS, JITTER = 5, 0.35
#: A verdict on a pattern: its vector, 1 or 0, and how many pairs got it.
Verdict = tuple[list[int], int, float]


def _smoothed(counts: np.ndarray, marginal: np.ndarray, smoothing: float, share: float) -> np.ndarray:
    """Level shares of a component, drawn to the marginal by a prior in proportion to the component's share, so that a level without pairs weighs nothing."""
    prior = smoothing * len(counts) * share
    return (counts + prior * marginal) / (counts.sum() + prior) if counts.sum() + prior > 0 else marginal


def _marginal(counts: np.ndarray) -> np.ndarray:
    return (counts + 1) / (counts.sum() + len(counts))


def _floored(row: np.ndarray) -> np.ndarray:
    lifted = np.maximum(row, FLOOR)
    return lifted / lifted.sum()


def from_verdicts(kind: str, verdicts: list[Verdict], smoothing: float = 1.0) -> Model:
    """The tables that labelled pairs alone imply, for a fit to begin from."""
    total = sum(n for _, _, n in verdicts) or 1.0
    share = sum(n for _, y, n in verdicts if y) / total
    m, u = [], []
    for i, levels in enumerate(FIELDS[kind].values()):
        per = [np.bincount([v[i] for v, y, _ in verdicts if y == side], [n for _, y, n in verdicts if y == side], len(levels)) for side in (1, 0)]
        own = _marginal(per[0] + per[1])
        m.append(_smoothed(per[0], own, smoothing, share).tolist())
        u.append(_smoothed(per[1], own, smoothing, 1 - share).tolist())
    return Model(kind, m, u, min(max(share, 0.01), 0.5))


def agreement(tables: list[list[float]]) -> float:
    """Mean level that tables expect, each field by its own top level, so that a field of many levels has one voice."""
    return sum(float(np.arange(len(t)) @ np.asarray(t)) / max(len(t) - 1, 1) for t in tables) / len(tables)


def fit(kind: str, patterns: list[tuple[list[int], float]], start: float = 0.05, rounds: int = 200, tolerance: float = 1e-8, smoothing: float = 1.0, verdicts: list[Verdict] | None = None, noise: float = 0.0, begin: Model | None = None, jitter: float = 0.0, seed: int = 0) -> Model:
    """Expectation-maximization over distinct patterns (vector, count) without verdicts, and ``verdicts`` on others.

    A verdict is a second observation of its pair's class, wrong with probability ``noise``: log P(verdict | class)
    joins both components, so the pair's responsibility is conditioned on vector and verdict. Without noise that is the
    verdict itself. Begins with ``begin``, or with tables in which agreement speaks for a match, shaken by ``jitter``
    with ``seed``. The component that agrees more is the matches, unless verdicts name it. Fewer than 50 pairs, or a
    share of matches outside [0.0001, 0.9999], raise Degenerate.
    """
    if not 0 <= noise < 0.5:
        raise ValueError(f"noise {noise} is not in [0, 0.5)")
    verdicts = [v for v in verdicts or () if v[2] > 0]
    if sum(n for _, n in patterns) + sum(n for _, _, n in verdicts) < 50:
        raise Degenerate("fewer than 50 pairs")
    sizes = [len(levels) for levels in FIELDS[kind].values()]
    codes = np.array([v for v, _ in patterns] + [v for v, _, _ in verdicts])
    count = np.array([n for _, n in patterns] + [n for _, _, n in verdicts], dtype=float)
    right, wrong = math.log(1 - noise), math.log(noise) if noise else -math.inf
    said = np.array([[0.0, 0.0]] * len(patterns) + [[right, wrong] if y else [wrong, right] for _, y, _ in verdicts])
    hot = [np.eye(s)[codes[:, i]] for i, s in enumerate(sizes)]
    marginal = [_marginal(count @ h) for h in hot]
    if begin is not None:
        m, u, share = [np.asarray(x) for x in begin.m], [np.asarray(x) for x in begin.u], begin.share
    else:
        draw = np.random.default_rng(seed)
        shaken = lambda row: row * (1 + jitter * draw.uniform(-1, 1, len(row)))
        m = [_floored(shaken(np.arange(1, s + 1) ** 2 / s**2)) for s in sizes]
        u = [_floored(shaken(np.arange(s, 0, -1) ** 2 / s**2)) for s in sizes]
        share = start
    trace: list[float] = []
    total = count.sum()
    for _ in range(rounds):
        share = float(np.clip(share, 1e-12, 1 - 1e-12))
        lm = math.log(share) + said[:, 0] + sum(np.log(np.maximum(h @ a, FLOOR)) for h, a in zip(hot, m, strict=True))
        lu = math.log(1 - share) + said[:, 1] + sum(np.log(np.maximum(h @ a, FLOOR)) for h, a in zip(hot, u, strict=True))
        both = np.logaddexp(lm, lu)
        p = count * np.exp(lm - both)
        trace.append(float(count @ both))
        share = float(p.sum() / total)
        m = [_smoothed(p @ h, q, smoothing, share) for h, q in zip(hot, marginal, strict=True)]
        u = [_floored(_smoothed((count - p) @ h, q, smoothing, 1 - share)) for h, q in zip(hot, marginal, strict=True)]
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tolerance:
            break
    m, u = [x.tolist() for x in m], [x.tolist() for x in u]
    if not verdicts and agreement(u) > agreement(m):
        m, u, share = u, m, 1 - share
    if not 1e-4 <= share <= 1 - 1e-4:
        raise Degenerate(f"share of matches {share}")
    return Model(kind, m, u, share, trace)


def best_fit(kind: str, patterns: list[tuple[list[int], float]], starts: tuple[float, ...] = STARTS, restarts: int = RESTARTS, begin: Model | None = None, jitter: float = JITTER, seed: int = 0, **options) -> Model:
    """The fit of highest likelihood over ``restarts`` beginnings; Degenerate only if all of them are.

    The first begins with ``begin`` or plain tables; the others take the shares of ``starts`` in turn and shake the
    tables, for tables that begin alike can end alike whatever the share.
    """
    found, last = [], None
    for k in range(restarts):
        try:
            found.append(fit(kind, patterns, start=starts[k % len(starts)], begin=begin if k == 0 else None, jitter=jitter if k else 0.0, seed=seed * 1000 + k, **options))
        except Degenerate as e:
            last = e
    if not found:
        raise last
    return max(found, key=lambda model: model.trace[-1])


def fit_tally(tally: DataFrame, **options) -> dict[str, Model]:
    """A model for each kind that has pairs. Raises Degenerate if one cannot be fitted: its pairs would drop out unseen."""
    out = {}
    for kind in FIELDS:
        rows = tally.filter(F.col("kind") == kind).groupBy("vector").agg(F.sum("n").alias("n")).orderBy("vector").collect()  # bounded by the levels of the fields
        if not rows:
            continue
        try:
            out[kind] = best_fit(kind, [(r["vector"], r["n"]) for r in rows], **options)
        except Degenerate as e:
            raise Degenerate(f"{kind} model could not be fitted: {e}") from e
    return out


def isotonic_knots(scored: DataFrame, score: str = "weight", label: str = "label", step: float = 0.5, count: str | None = None) -> list[tuple[float, float]]:
    """Knots (weight, confidence) of the monotone fit; weights are rounded half-even to ``step`` first, which bounds the rows. ``count``: what a row counts for."""
    w = F.col(count).cast("double") if count else F.lit(1.0)
    rows = scored.groupBy((F.bround(F.col(score) / step) * step).alias("x")).agg(F.sum(w * F.col(label).cast("double")).alias("y"), F.sum(w).alias("n")).filter("n > 0").orderBy("x").collect()
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for r in rows:
        blocks.append([r["y"], r["n"], r["x"], r["x"]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, x = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], x]
    knots: dict[float, float] = {}
    for s, n, a, b in blocks:
        for x in (a, b):
            knots[x] = min(1.0, max(0.0, s / n))
    return sorted(knots.items())


def calibrated(weight: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, flat beyond them."""
    if not knots:
        return weight.cast("double") * 0
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(weight < x1, F.lit(float(y0)) + (weight - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(weight <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def cumulative_cuts(scored: DataFrame, score: str = "confidence", label: str = "label") -> DataFrame:
    """A row for each distinct score: pairs and matches at or above it, precision, and matches below it.

    Levels are aggregated first, so the running sums see a row a level (scores are calibrated: as many as knots allow).
    """
    levels = scored.groupBy(F.col(score).alias("cut")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("cut"))
    everything = Window.partitionBy(F.lit(0))
    out = levels.withColumn("n_above", F.sum("n").over(down)).withColumn("pos_above", F.sum("pos").over(down))
    return out.withColumn("precision", F.col("pos_above") / F.col("n_above")).withColumn("pos_below", F.sum("pos").over(everything) - F.col("pos_above"))


class Thresholds(NamedTuple):
    """Cuts, what they achieve on the rows they were chosen from, and whether the targets were met."""

    accept: float
    reject: float
    precision: float
    recall: float
    grey: float
    precision_met: bool
    recall_met: bool


def _chosen(levels: DataFrame, precision: float, recall: float, patient: bool) -> DataFrame:
    """One row of ``Thresholds``' columns from levels (cut, w, pos): weight and (expected) matches at each distinct score.

    accept: the lowest score at or above which the precision meets its target, else 1; not ``patient``, only as long as
    all scores above it meet it too. reject: the score next above the highest one up to which all may be rejected with
    the recall still met, score by score from below (that score itself if it is the highest of all; the lowest of all
    if none may be), but never above accept. grey: the share of weight in between. Without rows: 1, 0 and nothing met;
    without matches every score may go. The running sums see a row a distinct score.
    """
    everything = Window.partitionBy(F.lit(0))
    down, up = everything.orderBy(F.desc("cut")), everything.orderBy("cut")
    ran = levels.withColumn("above", F.sum("w").over(down)).withColumn("hit", F.sum("pos").over(down)).withColumn("below", F.sum("pos").over(up)).withColumn("all", F.sum("pos").over(everything)).withColumn("next", F.lead("cut").over(up))
    ran = ran.withColumn("p", F.when(F.col("above") > 0, F.col("hit") / F.col("above"))).withColumn("r", F.when(F.col("all") > 0, (F.col("all") - F.col("below")) / F.col("all")).otherwise(1.0))
    ran = ran.withColumn("_miss", F.max(F.when(F.col("p") < precision, F.col("cut"))).over(everything)).withColumn("_stop", F.min(F.when(F.col("r") < recall, F.col("cut"))).over(everything))
    good = F.col("p") >= precision
    if not patient:
        good = good & (F.col("_miss").isNull() | (F.col("cut") > F.col("_miss")))
    may = F.col("_stop").isNull() | (F.col("cut") < F.col("_stop"))
    found = ran.agg(
        F.count("*").alias("n"),
        F.min(F.when(good, F.col("cut"))).alias("accept"),
        F.min_by("p", F.when(good, F.col("cut"))).alias("p_met"),
        (F.max("p") if patient else F.max_by("p", "cut")).alias("p_best"),
        F.max(F.when(may, F.coalesce("next", "cut"))).alias("reject"),
        F.min_by("r", F.when(may, -F.col("cut"))).alias("r_met"),
        F.min("cut").alias("least"),
        F.sum("w").alias("total"),
        F.max("all").alias("matches"),
    )
    accept = F.coalesce("accept", F.lit(1.0))
    reached = F.when(F.col("n") == 0, 0.0).when(F.col("matches") > 0, F.coalesce("r_met", F.lit(1.0))).otherwise(0.0 if patient else 1.0)
    cut = found.select("n", accept.alias("accept"), F.least(accept, F.coalesce("reject", "least", F.lit(0.0))).alias("reject"), F.least(F.coalesce("p_met", "p_best", F.lit(0.0)), F.lit(1.0)).alias("precision"), F.least(reached, F.lit(1.0)).alias("recall"), F.col("p_met").isNotNull().alias("precision_met"), (F.col("r_met").isNotNull() | ((F.col("n") > 0) & (F.col("matches") <= 0))).alias("recall_met"), "total")
    between = cut.join(levels, (F.col("cut") >= F.col("reject")) & (F.col("cut") < F.col("accept")), "left").groupBy("n", "accept", "reject", "precision", "recall", "precision_met", "recall_met", "total").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("held"))
    return between.select("accept", "reject", "precision", "recall", F.when(F.col("n") == 0, 1.0).otherwise(F.col("held") / F.col("total")).alias("grey"), "precision_met", "recall_met")


def threshold_table(scored: DataFrame, precision: float = 0.99, recall: float = 0.99, score: str = "confidence", label: str = "label", weight: str | None = None) -> DataFrame:
    """One row of ``Thresholds``' columns, chosen from labelled rows by weight; labels may be corrected ones, off 0 and 1. Recall is 0 where there is no match to find."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return _chosen(scored.groupBy(F.col(score).cast("double").alias("cut")).agg(F.sum(w).alias("w"), F.sum(w * F.col(label).cast("double")).alias("pos")), precision, recall, True)


def expected_table(scored: DataFrame, precision: float = 0.99, recall: float = 0.99, score: str = "confidence") -> DataFrame:
    """One row of ``Thresholds``' columns, chosen without labels: calibrated scores are themselves the expected matches.

    The precision above a cut is the mean score there, the matches below it are the sum of the scores there. The mean
    only falls as the cut does, so the first miss ends the search.
    """
    c = F.col(score).cast("double")
    return _chosen(scored.groupBy(c.alias("cut")).agg(F.count("*").cast("double").alias("w")).withColumn("pos", F.col("cut") * F.col("w")), precision, recall, False)


def choose_thresholds(scored: DataFrame, precision: float = 0.99, recall: float = 0.99, score: str = "confidence", label: str = "label", weight: str | None = None) -> Thresholds:
    row = threshold_table(scored, precision, recall, score, label, weight).first()
    return Thresholds(*(row[f] for f in Thresholds._fields))


def expected_shares(scored: DataFrame, cuts: Thresholds, score: str = "confidence") -> DataFrame:
    """One row: shares of records that ``cuts`` accept, reject and leave, and the precision and missed matches that the calibrated scores themselves lead to expect."""
    c = F.col(score)
    take = lambda where, value: F.coalesce(F.sum(F.when(where, value)), F.lit(0.0))
    n = F.count("*")
    accepted, rejected = c >= cuts.accept, c < cuts.reject
    out = scored.agg(n.alias("n"), take(accepted, F.lit(1.0)).alias("a"), take(rejected, F.lit(1.0)).alias("b"), take(accepted, c).alias("hits"), take(rejected, c).alias("lost"), F.coalesce(F.sum(c), F.lit(0.0)).alias("all"))
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y))
    return out.select("n", share("a", "n").alias("accepted"), share("b", "n").alias("rejected"), (1 - share("a", "n") - share("b", "n")).alias("grey"), share("hits", "a").alias("expected_precision"), share("lost", "all").alias("expected_missed"))


def expected_thresholds(scored: DataFrame, precision: float = 0.99, recall: float = 0.99, score: str = "confidence") -> Thresholds:
    row = expected_table(scored, precision, recall, score).first()
    return Thresholds(*(row[f] for f in Thresholds._fields))


def denoised(label: Column, noise: float = 0.03) -> Column:
    """What a label counts for, on average the truth, where a reviewer errs with probability ``noise``: (label - noise) / (1 - 2 noise)."""
    if not 0 <= noise < 0.5:
        raise ValueError(f"noise {noise} is not in [0, 0.5)")
    return (label.cast("double") - noise) / (1 - 2 * noise)


def log_loss(p: str = "confidence", y: str = "label", weight: str | None = None) -> Column:
    """Mean log loss of probabilities, an aggregate; probabilities are kept off 0 and 1 by 1e-12."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    w = F.col(weight) if weight else F.lit(1.0)
    return -F.sum(w * (F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))) / F.sum(w)
