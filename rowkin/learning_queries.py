"""Queries of fits with verdicts, cuts without labels, corrected labels and the gate of a retune, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.operators import estimates, learn, listings
from rowkin.queries import _SHARE, CONFIDENT_SQL, _confident, query, table
from rowkin.schema import FIELDS


@query(f"""{CONFIDENT_SQL}, l AS (SELECT confidence AS c, count(*)::DOUBLE AS w, count(*) * confidence AS pos FROM p GROUP BY 1)
, r AS (SELECT *, sum(pos) OVER (ORDER BY c DESC) / sum(w) OVER (ORDER BY c DESC) AS mean, 1 - sum(pos) OVER (ORDER BY c) / sum(pos) OVER () AS kept, lead(c) OVER (ORDER BY c) AS nxt FROM l)
, t(tp, tr) AS (VALUES (0.8::DOUBLE, 0.9::DOUBLE), (0.6, 0.97), (0.999, 0.5), (0.1, 0.01))
, s AS (SELECT tp, tr, max(c) FILTER (WHERE mean < tp) AS miss, min(c) FILTER (WHERE kept < tr) AS stop, min(c) AS least FROM r, t GROUP BY 1, 2)
, a AS (SELECT s.*, (SELECT min(c) FROM r WHERE miss IS NULL OR c > miss) AS acc, (SELECT max(coalesce(nxt, c)) FROM r WHERE stop IS NULL OR c < stop) AS rej, (SELECT max(c) FROM r WHERE stop IS NULL OR c < stop) AS last FROM s)
, z AS (SELECT *, coalesce(acc, 1.0) AS accept, least(coalesce(acc, 1.0), coalesce(rej, least)) AS reject FROM a)
SELECT tp AS target_precision, tr AS target_recall, accept, reject, round(coalesce((SELECT mean FROM r WHERE c = acc), (SELECT mean FROM r ORDER BY c DESC LIMIT 1)), 9) AS "precision", round(coalesce((SELECT kept FROM r WHERE c = last), 1.0), 9) AS recall,
  round(coalesce((SELECT sum(w) FROM l WHERE c >= reject AND c < accept), 0.0) / (SELECT sum(w) FROM l), 9) AS grey, acc IS NOT NULL AS precision_met, last IS NOT NULL AS recall_met FROM z""")
def cuts_without_labels(spark, sf_dir):
    """Cuts for four pairs of targets, chosen from calibrated scores alone."""
    scored = _confident(spark, sf_dir)
    out = None
    for precision, recall in ((0.8, 0.9), (0.6, 0.97), (0.999, 0.5), (0.1, 0.01)):
        one = learn.expected_table(scored, precision, recall).select(F.lit(precision).alias("target_precision"), F.lit(recall).alias("target_recall"), "accept", "reject", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "grey")), "precision_met", "recall_met")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{CONFIDENT_SQL}, q AS (SELECT confidence AS c, (label - 0.1) / (1 - 2 * 0.1::DOUBLE) AS y, CAST(doc_id % 3 + 1 AS DOUBLE) AS w FROM p)
, b AS (SELECT least(greatest(CAST(trunc(c * 10) AS INTEGER), 0), 9) AS bin, abs(sum(w * c) - sum(w * y)) AS gap FROM q GROUP BY 1)
SELECT count(*) AS n, round(least(greatest(sum(w * y) FILTER (WHERE c >= 0.7) / sum(w) FILTER (WHERE c >= 0.7), 0), 1), 6) AS "precision", round(least(greatest(sum(w * y) FILTER (WHERE c >= 0.7) / sum(w * y), 0), 1), 6) AS recall, round(least(greatest(sum(w * y) FILTER (WHERE c < 0.3) / sum(w * y), 0), 1), 6) AS missed,
  round(sum(w) FILTER (WHERE c >= 0.3 AND c < 0.7) / sum(w), 6) AS review_share, round((SELECT sum(gap) FROM b) / sum(w), 6) AS ece, round(sum(w * (c - y) * (c - y)) / sum(w), 6) AS brier FROM q""")
def judged_noisy_labels(spark, sf_dir):
    """Rates of two cuts on weighted labels of which one in ten is wrong."""
    return listings.judged(_confident(spark, sf_dir).withColumn("weight", F.col("doc_id") % 3 + 1), 0.7, 0.3, noise=0.1)


#: Nine configs against one (0.7, 0.3): cuts of the new one, and how its confidences differ.
_GATES = ((1, 0.7, 0.3, 0.0), (2, 0.45, 0.3, 0.0), (3, 0.7, 0.68, 0.0), (4, 0.7, 0.05, 0.0), (5, 2.0, 0.3, 0.0), (6, 0.62, 0.3, 0.05), (7, 0.7, 0.3, -0.02), (8, 0.8, 0.3, 0.0), (9, 0.3, 0.3, 0.0))
_GATE_TARGET = 0.87
_RATES_SQL = """count(*) AS n, round(sum(w * y) FILTER (WHERE c >= a) / sum(w) FILTER (WHERE c >= a), 6) AS "precision", round(coalesce(sum(w * y) FILTER (WHERE c >= a), 0) / sum(w * y), 6) AS recall, round(coalesce(sum(w * y) FILTER (WHERE c < a AND c < r), 0) / sum(w * y), 6) AS missed,
  round(coalesce(sum(w) FILTER (WHERE c < a AND c >= r), 0) / sum(w), 6) AS review"""


@query(f"""{CONFIDENT_SQL}, g(pair, acc, rej, shift) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {r}::DOUBLE, {d}::DOUBLE)" for i, a, r, d in _GATES)})
, q AS (SELECT pair, label::DOUBLE AS y, CAST(doc_id % 3 + 1 AS DOUBLE) AS w, least(confidence + shift, 1.0) AS cn, acc, rej, confidence AS co FROM p, g)
, n AS (SELECT pair, {_RATES_SQL} FROM (SELECT pair, y, w, cn AS c, acc AS a, rej AS r FROM q) GROUP BY 1), o AS (SELECT pair, {_RATES_SQL} FROM (SELECT pair, y, w, co AS c, 0.7 AS a, 0.3 AS r FROM q) GROUP BY 1)
SELECT n.pair, n."precision" AS new_precision, o."precision" AS old_precision, n.recall AS new_recall, n.missed AS new_missed, n.review AS new_review_share,
  CASE WHEN n."precision" IS NULL OR o."precision" IS NULL THEN 'nothing_to_compare' WHEN n."precision" < least(o."precision", {_GATE_TARGET}) - 0.01 THEN 'precision_falls' WHEN o.missed - n.missed < -0.02 THEN 'misses_more' WHEN o.review - n.review < -0.01 THEN 'reviews_more'
    WHEN greatest(n."precision" - o."precision", n.recall - o.recall, o.missed - n.missed, o.review - n.review) <= 0.01 THEN 'no_difference' ELSE 'improves' END AS outcome
FROM n JOIN o USING (pair)""")
def retune_gate(spark, sf_dir):
    """Nine configs, each judged with the one in use on the same labels, and whether it should replace it."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), F.lit(float(a)).alias("a"), F.lit(float(r)).alias("r"), F.lit(float(d)).alias("d")) for i, a, r, d in _GATES)))
    rows = _confident(spark, sf_dir).withColumn("g", pairs)
    labels = rows.select("g.pair", "label", (F.col("doc_id") % 3 + 1).alias("weight"), F.least(F.col("confidence") + F.col("g.d"), F.lit(1.0)).alias("new"), F.col("g.a").alias("new_accept"), F.col("g.r").alias("new_reject"), F.col("confidence").alias("old"), F.lit(0.7).alias("old_accept"), F.lit(0.3).alias("old_reject"))
    return listings.gate(labels, _GATE_TARGET, by=("pair",)).select("pair", "new_precision", "old_precision", "new_recall", "new_missed", "new_review_share", "outcome")


#: How the orders' lines make patterns of the kind organization, level by level.
_LEVELS = ("l_quantity % 4", "l_quantity * 7 % 4", "(l_quantity + l_linenumber) % 6", "l_linenumber % 4", "l_quantity % 6", "CASE WHEN l_quantity > 30 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END", "CASE WHEN l_discount > 0.05 THEN 3 ELSE l_linenumber % 3 END")
_SAID = "CASE WHEN l_orderkey % 10 = 1 THEN CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END WHEN l_orderkey % 10 = 2 THEN CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END END"
_ROUNDS, _NOISE = 12, 0.05
_SIZES = [len(x) for x in FIELDS["organization"].values()]


@query(f"""
WITH RECURSIVE pat AS (SELECT row_number() OVER (ORDER BY v, said) AS id, * FROM (SELECT [{", ".join(f"CAST({x} AS INTEGER)" for x in _LEVELS)}] AS v, {_SAID} AS said, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL))
, cell AS (SELECT id, n, said, unnest(range(0, 7)) AS f, unnest(v) AS l FROM pat)
, lev(f, l, k) AS (VALUES {", ".join(f"({f}, {x}, {s})" for f, s in enumerate(_SIZES) for x in range(s))})
, tot AS (SELECT sum(n) AS total FROM pat)
, mar AS (SELECT lev.f, lev.l, k, (coalesce(sum(n), 0) + 1) / (any_value(total) + k) AS q FROM lev CROSS JOIN tot LEFT JOIN cell ON cell.f = lev.f AND cell.l = lev.l GROUP BY lev.f, lev.l, k)
, em AS (
  SELECT 0 AS it, f, l, (l + 1) ** 2 / sum((l + 1) ** 2) OVER (PARTITION BY f) AS m, (k - l) ** 2 / sum((k - l) ** 2) OVER (PARTITION BY f) AS u, 0.05::DOUBLE AS share FROM lev
  UNION ALL
  SELECT it, f, l, m, greatest(u, 1e-6) / sum(greatest(u, 1e-6)) OVER (PARTITION BY f), share FROM (
    SELECT it, mar.f, mar.l, (coalesce(mc, 0) + k * share * q) / (share * total + k * share) AS m, (coalesce(uc, 0) + k * (1 - share) * q) / ((1 - share) * total + k * (1 - share)) AS u, share
    FROM (
      WITH g AS (SELECT it + 1 AS it, id, n, 1 / (1 + exp(-(sum(ln(greatest(m, 1e-6)) - ln(greatest(u, 1e-6))) + ln(any_value(share)) - ln(1 - any_value(share)) + CASE any_value(said) WHEN 1 THEN ln(1 - {_NOISE}) - ln({_NOISE}) WHEN 0 THEN ln({_NOISE}) - ln(1 - {_NOISE}) ELSE 0 END))) AS g
        FROM em JOIN cell USING (f, l) WHERE it < {_ROUNDS} GROUP BY it, id, n)
      , s AS (SELECT sum(n * g) / sum(n) AS share FROM g)
      SELECT g.it, c.f, c.l, sum(g.n * g.g) AS mc, sum(g.n * (1 - g.g)) AS uc, any_value(s.share) AS share FROM g JOIN cell c USING (id) CROSS JOIN s GROUP BY g.it, c.f, c.l
    ) x RIGHT JOIN (SELECT mar.*, total FROM mar CROSS JOIN tot) mar ON mar.f = x.f AND mar.l = x.l
  ) WHERE it IS NOT NULL
)
SELECT CAST(f AS INTEGER) AS field, CAST(l AS INTEGER) AS level, round(log2(greatest(m, 1e-6) / greatest(u, 1e-6)), 6) AS bits, round(share, 6) AS share FROM em WHERE it = {_ROUNDS}
""")
def em_with_verdicts(spark, sf_dir):
    """Twelve rounds of the fit on patterns of which some carry verdicts that may err."""
    vector = F.array(*(F.expr(x).cast("int") for x in _LEVELS))
    tally = table(spark, sf_dir, "lineitem").groupBy(vector.alias("vector"), F.expr(_SAID).alias("said")).agg(F.count("*").alias("n"))
    rows = tally.orderBy("vector", "said").collect()  # bounded by the levels of the fields
    model = learn.fit("organization", [(r["vector"], r["n"]) for r in rows if r["said"] is None], verdicts=[(r["vector"], r["said"], r["n"]) for r in rows if r["said"] is not None], noise=_NOISE, rounds=_ROUNDS, tolerance=0.0)
    return spark.createDataFrame([(f, x, round(b, 6), round(model.share, 6)) for f, bits in enumerate(model.weights()) for x, b in enumerate(bits)], "field int, level int, bits double, share double")


#: Orders as records in four cells, two of them tiny, and what a judge would find.
_CELL = "CASE WHEN o_orderkey % 997 = 0 THEN 'a' WHEN o_orderkey % 499 = 0 THEN 'b' WHEN o_orderkey % 7 = 0 THEN 'c' ELSE 'd' END"
_SAMPLE, _REPLICATES = 120, 60
ALLOCATED_SQL = f"""
WITH RECURSIVE r AS (SELECT {_CELL} AS cell, o_orderkey AS k, CAST(o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS INTEGER) AS tp, CAST(o_orderstatus = 'F' AND o_orderkey % 2 = 1 AS INTEGER) AS fp, CAST(o_orderstatus = 'P' AS INTEGER) AS review FROM orders)
, c AS (SELECT cell, count(*) AS size, row_number() OVER (ORDER BY cell) AS i, sum(count(*)) OVER () AS total, count(*) OVER () AS cells FROM r GROUP BY 1)
, p AS (SELECT *, least({_SAMPLE}, total)::BIGINT AS n, (least({_SAMPLE}, total) * size // total)::BIGINT AS base, (least({_SAMPLE}, total) * size % total)::BIGINT AS remainder FROM c)
, q AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, i) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS part, least(size, {estimates.LEAST}, n // cells)::BIGINT AS least_part FROM p)
, moved AS (
  SELECT 1::BIGINT AS place, list(part::BIGINT ORDER BY i) AS parts, list(least_part ORDER BY i) AS floors, list(cell ORDER BY i) AS names, list(size ORDER BY i) AS sizes FROM q
  UNION ALL
  SELECT CASE WHEN parts[place] < floors[place] AND list_max(parts) > floors[place] THEN place ELSE place + 1 END,
    CASE WHEN parts[place] < floors[place] AND list_max(parts) > floors[place] THEN list_transform(parts, lambda x, k: x + CASE WHEN k = place THEN 1 WHEN k = list_position(parts, list_max(parts)) THEN -1 ELSE 0 END) ELSE parts END, floors, names, sizes
  FROM moved WHERE place <= len(parts)
)
, alloc AS (SELECT unnest(names) AS cell, unnest(sizes) AS size, CAST(unnest(parts) AS INTEGER) AS part FROM moved WHERE place > len(parts))
"""


def _records(spark, sf_dir):
    match, done = F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.expr(_CELL).alias("cell"), F.col("o_orderkey").alias("k"), ((done == "F") & match).cast("int").alias("tp"), ((done == "F") & ~match).cast("int").alias("fp"), (done == "P").cast("int").alias("review"))


@query(f"{ALLOCATED_SQL} SELECT * FROM alloc")
def sample_allocation(spark, sf_dir):
    """A sample dealt to four cells by largest remainders, the tiny ones raised by donors."""
    return estimates.allocation(_records(spark, sf_dir), "cell", _SAMPLE)


@query(f"""{ALLOCATED_SQL}
, s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_SHARE.format("concat('sample:', k::VARCHAR)")}, k) - 1 AS draw FROM r JOIN alloc USING (cell) QUALIFY draw < part)
, cells AS (SELECT cell, max(size) AS size, count(*) AS n FROM s GROUP BY 1)
, asked AS (SELECT cell, size, n, b, CAST(floor({_SHARE.format("concat('bootstrap:', b::VARCHAR, ':', cell, ':', j::VARCHAR)")} * n) AS BIGINT) AS draw FROM (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, unnest(range(0, {_REPLICATES})) AS b FROM cells))
    UNION ALL SELECT cell, size, n, -1, unnest(range(0, n)) FROM cells)
, per AS (SELECT b, cell, sum(tp)::DOUBLE * max(a.size) / max(n) AS tp, sum(fp)::DOUBLE * max(a.size) / max(n) AS fp FROM asked a JOIN s USING (cell, draw) GROUP BY 1, 2)
, est AS (SELECT b, sum(tp) AS tp, sum(fp) AS fp, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS expected FROM per GROUP BY 1)
, pr AS (SELECT b, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN expected > 0 THEN tp / expected ELSE 0 END AS r FROM est)
, m AS (SELECT b, 'precision' AS metric, p AS v FROM pr UNION ALL SELECT b, 'recall', r FROM pr UNION ALL SELECT b, 'f1', CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END FROM pr)
SELECT metric, round(max(v) FILTER (WHERE b = -1), 9) AS point, round(list_sort(list(v) FILTER (WHERE b >= 0))[1 + CAST(floor(0.025 * ({_REPLICATES} - 1)) AS BIGINT)], 9) AS low, round(list_sort(list(v) FILTER (WHERE b >= 0))[1 + CAST(floor(0.975 * ({_REPLICATES} - 1)) AS BIGINT)], 9) AS high FROM m GROUP BY 1""")
def bootstrap_interval(spark, sf_dir):
    """Precision, recall and F1 of a stratified sample of 120, and intervals from sixty resampled ones."""
    rows = _records(spark, sf_dir)
    sample = estimates.drawn(rows, "cell", "k", _SAMPLE)
    found = estimates.bootstrap(sample, "cell", F.lit(rows.where("k % 2 = 0").count()), _REPLICATES)
    return estimates.intervals(found).select("metric", *(F.round(c, 9).alias(c) for c in ("point", "low", "high")))
