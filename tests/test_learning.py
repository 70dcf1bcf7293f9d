"""Fits, cuts, gates and estimates against plain versions on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkin.functions.phonetics import double_metaphone, sound_keys
from rowkin.operators import decide, estimates, learn, linkage, listings
from rowkin.schema import FIELDS

KIND = "individual"
SIZES = [len(x) for x in FIELDS[KIND].values()]


def plain_em(patterns, verdicts, noise, rounds):
    """Expectation-maximization pattern by pattern, with plain floats."""
    rows = [(v, None, n) for v, n in patterns] + list(verdicts)
    m = [[(k + 1) ** 2 / sum((j + 1) ** 2 for j in range(s)) for k in range(s)] for s in SIZES]
    u = [row[::-1] for row in m]
    share, total = 0.05, sum(n for *_, n in rows)
    for _ in range(rounds):
        g = []
        for v, y, _ in rows:
            a = share * math.prod(max(m[i][x], 1e-6) for i, x in enumerate(v)) * (1 if y is None else 1 - noise if y else noise)
            b = (1 - share) * math.prod(max(u[i][x], 1e-6) for i, x in enumerate(v)) * (1 if y is None else noise if y else 1 - noise)
            g.append(a / (a + b))
        share = sum(n * p for (*_, n), p in zip(rows, g)) / total
        for i, s in enumerate(SIZES):
            both = [sum(n for v, _, n in rows if v[i] == k) for k in range(s)]
            q = [(c + 1) / (total + s) for c in both]
            mc = [sum(n * p for (v, _, n), p in zip(rows, g) if v[i] == k) for k in range(s)]
            m[i] = [(c + s * share * x) / (sum(mc) + s * share) for c, x in zip(mc, q)]
            uc = [max((b - c + s * (1 - share) * x) / (total - sum(mc) + s * (1 - share)), 1e-6) for b, c, x in zip(both, mc, q)]
            u[i] = [x / sum(uc) for x in uc]
    return m, u, share


def random_tally(seed, n=60):
    rng = random.Random(seed)
    vector = lambda up: [min(s - 1, int(s * (rng.random() ** (0.3 if up else 2)))) for s in SIZES]
    patterns = [(vector(k % 5 == 0), rng.randrange(1, 40)) for k in range(n)]
    verdicts = [(vector(k % 2 == 0), int((k % 2 == 0) != (k % 7 == 0)), rng.randrange(1, 5)) for k in range(20)]
    return patterns, verdicts


@pytest.mark.parametrize("seed,noise", [(1, 0.0), (2, 0.05), (3, 0.2)])
def test_fit_equals_plain_em(seed, noise):
    patterns, verdicts = random_tally(seed)
    got = learn.fit(KIND, patterns, rounds=15, tolerance=0.0, verdicts=verdicts, noise=noise)
    m, u, share = plain_em(patterns, verdicts, noise, 15)
    assert got.share == pytest.approx(share, abs=1e-9)
    for a, b in zip([*got.m, *got.u], [*m, *u]):
        assert a == pytest.approx(b, abs=1e-9)
    free = learn.fit(KIND, patterns, rounds=15, tolerance=0.0)
    m, u, share = plain_em(patterns, [], 0, 15)
    assert free.share == pytest.approx(share, abs=1e-9)


def test_verdicts_that_may_err_bend_a_fit_less():
    """One wrong verdict on full agreement hardly moves the weight of agreement if it may err."""
    top, low = [s - 1 for s in SIZES], [1] * len(SIZES)
    patterns = [(top, 50), (low, 900)]
    sure = learn.fit(KIND, patterns, verdicts=[(top, 0, 3)], noise=0.0)
    doubted = learn.fit(KIND, patterns, verdicts=[(top, 0, 3)], noise=0.1)
    assert doubted.weights()[0][-1] > sure.weights()[0][-1] + 1
    with pytest.raises(ValueError):
        learn.fit(KIND, patterns, noise=0.5)


def test_fit_begins_from_a_slice_or_a_parent():
    patterns, verdicts = random_tally(4)
    begin = learn.from_verdicts(KIND, verdicts)
    assert all(sum(row) == pytest.approx(1) for row in [*begin.m, *begin.u]) and 0.01 <= begin.share <= 0.5
    one = learn.fit(KIND, patterns, rounds=1, begin=begin)
    lm = math.log(begin.share)
    both = sum(n * np.logaddexp(lm + sum(math.log(begin.m[i][x]) for i, x in enumerate(v)), math.log(1 - begin.share) + sum(math.log(begin.u[i][x]) for i, x in enumerate(v))) for v, n in patterns)
    assert one.trace[0] == pytest.approx(both)


def test_shaken_tables_leave_the_poorer_optimum():
    """A tally where fits from plain tables end alike whatever the share, and a shaken one ends higher."""
    for seed in range(60):
        patterns, _ = random_tally(seed, 12)
        plain = [learn.fit(KIND, patterns, start=s, rounds=400) for s in learn.STARTS]
        best = learn.best_fit(KIND, patterns, rounds=400, restarts=9)
        assert best.trace[-1] >= plain[0].trace[-1] - 1e-6
        if best.trace[-1] > max(p.trace[-1] for p in plain) + 0.5:
            return
    raise AssertionError("no tally had a second optimum")


def test_label_switch_gives_each_field_one_voice():
    m, u = [[0.0, 1.0], [0.0, 1.0], [0.1, 0.2, 0.2, 0.2, 0.2, 0.1]], [[1.0, 0.0], [1.0, 0.0], [0.0] * 5 + [1.0]]
    assert learn.agreement(m) > learn.agreement(u)
    assert sum(i * p for t in u for i, p in enumerate(t)) > sum(i * p for t in m for i, p in enumerate(t))


def plain_expected(scores, precision, recall):
    """(accept, reject, precision, recall, grey, precision_met, recall_met) by walking the sorted scores."""
    if not scores:
        return (1.0, 0.0, 0.0, 0.0, 1.0, False, False)
    levels = sorted(set(scores), reverse=True)
    accept, reached, met = 1.0, 0.0, False
    for c in levels:
        above = [x for x in scores if x >= c]
        mean = sum(above) / len(above)
        if mean < precision:
            reached = reached if met else mean
            break
        accept, reached, met = c, mean, True
    up, total = levels[::-1], sum(scores)
    reject, kept, kept_met = up[0], 1.0, total <= 0
    for i, c in enumerate(up):
        r = (total - sum(x for x in scores if x <= c)) / total if total > 0 else 1.0
        if r < recall:
            break
        reject, kept, kept_met = up[min(i + 1, len(up) - 1)], r, True
    reject = min(reject, accept)
    return (accept, reject, reached, kept, sum(reject <= x < accept for x in scores) / len(scores), met, kept_met)


@pytest.mark.parametrize("scores", [[], [0.0, 0.0], [1.0], [0.3, 0.3, 0.9, 0.99, 0.995, 0.01, 0.02, 0.5], [round(random.Random(5).random() ** k, 2) for k in (1, 2, 3) for _ in range(40)]])
@pytest.mark.parametrize("precision,recall", [(0.9, 0.95), (0.99, 0.5)])
def test_cuts_without_labels_equal_a_walk(spark, scores, precision, recall):
    got = learn.expected_thresholds(spark.createDataFrame([(s,) for s in scores], "confidence double"), precision, recall)
    assert tuple(got) == pytest.approx(plain_expected(scores, precision, recall))


def test_cuts_of_labels_without_matches_recall_nothing(spark):
    rows = spark.createDataFrame([(0.2, 0), (0.4, 0)], "confidence double, label int")
    assert learn.choose_thresholds(rows) == (1.0, 0.4, 0.0, 0.0, 0.5, False, True)
    assert learn.choose_thresholds(rows.limit(0)) == (1.0, 0.0, 0.0, 0.0, 1.0, False, False)


def test_denoised_is_the_inverse(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (1,)], "y int").select(learn.denoised(F.col("y"), 0.03)).collect()]
    assert got == pytest.approx([-0.03 / 0.94, 0.97 / 0.94])
    with pytest.raises(ValueError):
        learn.denoised(F.col("y"), 0.5)


def rows_of_gate(new, old=(0.9, 0.9, 0.05, 0.2)):
    return [tuple(10 if c == "n" else x for c, x in zip(("n", "precision", "recall", "missed", "review_share"), (10, *r))) for r in (new, old)]


@pytest.mark.parametrize("new,outcome", [((None, 0.9, 0.05, 0.2), "nothing_to_compare"), ((0.88, 0.9, 0.05, 0.2), "precision_falls"), ((0.9, 0.9, 0.08, 0.2), "misses_more"), ((0.9, 0.9, 0.05, 0.22), "reviews_more"), ((0.905, 0.905, 0.06, 0.205), "no_difference"), ((0.9, 0.95, 0.05, 0.2), "improves"), ((0.9, 0.9, None, 0.1), "improves")])
def test_recommendation(spark, new, outcome):
    names = ("n", "precision", "recall", "missed", "review_share")
    schema = ", ".join(f"{c}_{x} double" for c in ("new", "old") for x in names)
    row = [float(x) if x is not None else None for x in (10, *new, 10, 0.9, 0.9, 0.05, 0.2)]
    activate, found = listings.recommendation(0.99)
    assert tuple(spark.createDataFrame([tuple(row)], schema).select(activate, found).first()) == (outcome == "improves", outcome)


def test_gate_without_labels(spark):
    schema = "label int, weight double, new double, new_accept double, new_reject double, old double, old_accept double, old_reject double"
    (row,) = listings.gate(spark.createDataFrame([], schema)).collect()
    assert (row.outcome, row.activate, row.new_n) == ("nothing_to_compare", False, None)


def labelled_pairs(n=2000, seed=11):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        match = k % 4 == 0
        v = [min(s - 1, int(s * (rng.random() ** (0.25 if match else 2.5)))) for s in SIZES]
        label = int(match != (rng.random() < 0.03))
        rows.append((k, KIND, v, label, 1.0, "voluntary" if k % 50 == 7 else "review", k % 3 == 0))
    return rows


LABELS = "key long, kind string, vector array<int>, label int, weight double, source string, in_tally boolean"


def test_retune(spark):
    rows = labelled_pairs()
    labels = spark.createDataFrame([r for r in rows if r[0] % 3 == 0], LABELS)
    pairs = spark.createDataFrame([(r[1], r[2]) for r in rows], "kind string, vector array<int>")
    tally = learn.pattern_tally(pairs)
    weak = learn.Model(KIND, [[1 / s] * s for s in SIZES], [[1 / s] * s for s in SIZES], 0.1)
    weak.m[0], weak.u[0] = [0.1, 0.2, 0.3, 0.4], [0.4, 0.3, 0.2, 0.1]
    flat = [[1 / len(x)] * len(x) for x in FIELDS["organization"].values()]
    other = decide.Bundle(learn.Model("organization", flat, flat, 0.1), [(0.0, 0.5)], 0.9, 0.1)
    parent = {KIND: decide.Bundle(weak, [(-2.0, 0.1), (2.0, 0.9)], 0.85, 0.15)}
    population = pairs.withColumn("record_id", F.monotonically_increasing_id())
    out = linkage.retuned(parent, tally, labels, population, precision=0.9, recall=0.9, noise=0.03, restarts=2)
    report = out.reports[KIND]
    assert report["refit"] and report["cuts_from"] == "population" and report["labels"] == len([r for r in rows if r[0] % 3 == 0])
    assert abs(report["share"] - 0.25) < 0.05 and out.gate["outcome"] == "improves" and out.gate["new_precision"] > out.gate["old_precision"]
    assert 0 <= out.bundles[KIND].reject <= out.bundles[KIND].accept <= 1
    few = linkage.retuned({KIND: parent[KIND], "organization": other}, tally, labels, precision=0.9, recall=0.9, least_of_kind=30, restarts=1, rounds=3)
    assert few.bundles["organization"] is other and not few.reports["organization"]["refit"] and "0 labels" in few.reports["organization"]["reason"]
    with pytest.raises(linkage.NotEnough) as e:
        linkage.retuned(parent, tally, labels.limit(40))
    assert e.value.counts["total"] == 40


def test_degenerate_retune_is_reported(spark):
    """All pairs alike: the parent stays, and the report says why."""
    rows = [(k, KIND, [0] * 8, int(k % 20 == 0), 1.0, "review", False) for k in range(200)]
    labels = spark.createDataFrame(rows, LABELS)
    tally = spark.createDataFrame([(KIND, [0] * 8, 10**9)], "kind string, vector array<int>, n long")
    parent = {KIND: decide.Bundle(learn.from_verdicts(KIND, [([0] * 8, 1, 1), ([0] * 8, 0, 99)]), [(0.0, 0.5)], 0.9, 0.1)}
    parent[KIND].model.share = 1e-7
    out = linkage.retuned(parent, tally, labels, restarts=1, rounds=1)
    assert out.bundles[KIND] is parent[KIND] and "degenerates" in out.reports[KIND]["reason"] and out.gate["outcome"] == "nothing_to_compare"


def plain_apportioned(sizes, n, least):
    """Step by step, looking for the donor anew each time."""
    total = sum(sizes)
    n = min(n, total)
    if not n:
        return [0] * len(sizes)
    parts = [n * s // total for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: -(n * sizes[i] / total - parts[i]))
    for i in order[: n - sum(parts)]:
        parts[i] += 1
    for i, s in enumerate(sizes):
        floor = min(s, least, n // sum(1 for x in sizes if x))
        while parts[i] < floor and max(parts) > floor:
            parts[parts.index(max(parts))] -= 1
            parts[i] += 1
    return parts


def test_apportioned_sums_exactly():
    rng = random.Random(2)
    for _ in range(400):
        sizes = [rng.choice([0, 1, 3, 40, 1000]) + rng.randrange(9) for _ in range(rng.randrange(1, 8))]
        n = rng.randrange(0, 120)
        got = estimates.apportioned(sizes, n, 5)
        assert got == plain_apportioned(sizes, n, 5)
        assert sum(got) == min(n, sum(sizes)) and all(0 <= p for p in got)


def sampled(spark):
    rows = [(f"c{k % 3}", k, int(k % 2), int(k % 5 == 0), int(k % 7 == 0)) for k in range(900)]
    return spark.createDataFrame(rows, "cell string, key long, tp int, fp int, review int")


def test_drawn_is_the_smallest_hashes(spark):
    import hashlib

    got = {}
    for r in estimates.drawn(sampled(spark), "cell", "key", 40).collect():
        got.setdefault(r.cell, []).append((r.draw, r.key))
    for cell, own in got.items():
        keys = [k for k in range(900) if f"c{k % 3}" == cell]
        keys.sort(key=lambda k: hashlib.sha256(f"sample:{k}".encode()).digest()[:8])
        assert [k for _, k in sorted(own)] == keys[: len(own)]
    assert sum(map(len, got.values())) == 40


def test_bootstrap_equals_resampling(spark):
    import hashlib

    sample = estimates.drawn(sampled(spark), "cell", "key", 40)
    by = {}
    for r in sample.collect():
        by.setdefault(r.cell, {})[r.draw] = (r.tp, r.fp, r.review, r.size)
    want = []
    for b in range(30):
        tp = fp = 0.0
        for cell, own in by.items():
            n, size = len(own), own[0][3]
            at = [int(int.from_bytes(hashlib.sha256(f"bootstrap:{b}:{cell}:{j}".encode()).digest()[:8], "big") / 2**64 * n) for j in range(n)]
            tp += sum(own[i][0] for i in at) * size / n
            fp += sum(own[i][1] for i in at) * size / n
        want.append((b, tp + 7, fp + 1, (tp + 7) / (tp + fp + 8), (tp + 7) / 500))
    found = estimates.bootstrap(sample, "cell", F.lit(500), 30, exact=(7, 1, 0))
    got = [(r.replicate, r.tp, r.fp, r.precision, r.recall) for r in found.orderBy("replicate").collect()]
    assert got[0][0] == -1 and np.allclose(got[1:], want)
    rows = {r.metric: (r.point, r.low, r.high) for r in estimates.intervals(found).collect()}
    values = sorted(w[3] for w in want)
    assert rows["precision"] == pytest.approx((got[0][3], values[0], values[28]))


@pytest.mark.parametrize(
    "name,keys",
    [("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Michael", ("MKL", "MXL")), ("Caesar", ("SSR", "SSR")), ("Czerny", ("SRN", "XRN")), ("Accident", ("AKST", "AKST")), ("Bacci", ("PX", "PX")), ("Edgar", ("ATKR", "ATKR")), ("Ghislane", ("JLN", "JLN")), ("Hugh", ("H", "H")), ("Laugh", ("LF", "LF")), ("Agnes", ("AKNS", "ANS")), ("Tagliaro", ("TKLR", "TLR")), ("Jose", ("HS", "HS")), ("Cabrillo", ("KPRL", "KPR")), ("Thumb", ("0M", "TM")), ("Island", ("ALNT", "ALNT")), ("Sugar", ("XKR", "SKR")), ("Schenker", ("XNKR", "SKNK")), ("Filipowicz", ("FLPT", "FLPF")), ("Horowitz", ("HRTS", "HRFX")), ("Thomas", ("TMS", "TMS")), ("Whalen", ("ALN", "ALN")), ("Xavier", ("SF", "SFR")), ("Beaux", ("P", "P")), ("Zhao", ("J", "J")), ("Pizza", ("PS", "PTS")), ("Arnow", ("ARN", "ARNF")), ("Artois", ("ART", "ARTS")), ("", ("", "")), ("12345", ("", ""))],
)
def test_double_metaphone(name, keys):
    assert double_metaphone(name) == keys


def test_sound_keys_of_any_text():
    assert not set(sound_keys("Thompson")) & set(sound_keys("Thomson")) and sound_keys(None) == () and sound_keys("Ωλ") == ()
    for word in ("Featherstonehaugh", "O'Brien", "McHugh", "San Jacinto", "CCC", "GHGH", "SCH", "XX", "WWW", "Ñandú", "Çelik"):
        assert all(0 < len(k) <= 4 and k == k.upper() for k in sound_keys(word))
