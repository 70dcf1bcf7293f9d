"""Toxicity by a weighted pattern grammar over clauses.

Five small transducers read a clause's words as classes: insult (I), threat (T), target (G), negation (N), reported
speech (R), other (O). Each scales the weight of the insults and threats that follow; their composition is one machine.
A clause weighs what its insults and threats weigh under the machine's state, and a text is scored by its clauses, not
by isolated words. Insult stems and their weights are learned from labelled rows, as is the final logistic step.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm.common import crc_fold, stored
from rowkin.llm.tokens import forget_pieces

#: Bound of the model: labelled rows of each class to learn from; what patterns there are follows from these rows.
SAMPLE = 8192
#: A pattern must occur in so many toxic rows of the sample.
LEAST_ROWS = 3
#: Share of the toxic rows that makes a pattern frequent.
FREQUENT = 0.02
STEMS = (4, 5, 6)

# Word classes.
THREATS = frozenset("kill murder destroy hurt beat strangle hang shoot stab crush töten umbringen schlagen vernichten tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your yours yourself u ur he she they them him her this that these those these people du dich dir dein ihr euch er sie tu te toi ton vous votre il ils elle elles tú te ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor isn aren wasn don doesn didn nicht kein keine keinen nie niemals ne pas jamais aucun nunca ningún ninguna tampoco".split())
REPORTS = frozenset("said says say wrote writes called calls quoted quote reported reports according claimed sagte sagt schrieb nannte laut dit disait écrit selon dijo dice escribió según".split())
INSULTS = frozenset("idiot moron stupid scum loser worthless pathetic disgusting trash clown".split())

OTHER = ("O", 0.0)
TOKEN = re.compile(r"\w+|[.!?;:\n]+")
LABELS = "ITGNRO"


class Transducer:
    """States from 0; moves[state][label] = (next state, factor on an insult or threat read there)."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]]):
        self.moves = [{x: row.get(x, row.get("*", (0, 1.0))) for x in LABELS} for row in moves]

    def __mul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same clause, factors multiply."""
        pairs = list(product(range(len(self.moves)), range(len(other.moves))))
        at = {p: i for i, p in enumerate(pairs)}
        out = Transducer([{}])
        out.moves = [{x: (at[self.moves[a][x][0], other.moves[b][x][0]], self.moves[a][x][1] * other.moves[b][x][1]) for x in LABELS} for a, b in pairs]
        return out


#: An insult after another one in the clause counts half more.
INSULT = Transducer([{"I": (1, 1.0), "*": (0, 1.0)}, {"I": (1, 1.5), "*": (1, 1.0)}])
#: A threat counts fully only with a target or an insult before it.
THREAT = Transducer([{"T": (0, 0.25), "G": (1, 1.0), "I": (1, 1.0), "*": (0, 1.0)}, {"*": (1, 1.0)}])
#: A target named before the insult raises it.
TARGET = Transducer([{"G": (1, 1.0), "*": (0, 1.0)}, {"I": (1, 1.2), "*": (1, 1.0)}])
#: A negation lowers what stands up to two words after it.
NEGATION = Transducer([{"N": (2, 1.0), "*": (0, 1.0)}, {"N": (2, 1.0), "I": (0, 0.4), "T": (0, 0.4), "*": (0, 1.0)}, {"N": (2, 1.0), "I": (0, 0.4), "T": (0, 0.4), "*": (1, 1.0)}])
#: A verb of reported speech lowers the rest of the clause.
REPORT = Transducer([{"R": (1, 1.0), "*": (0, 1.0)}, {"I": (1, 0.6), "T": (1, 0.6), "*": (1, 1.0)}])
GRAMMAR = INSULT * THREAT * TARGET * NEGATION * REPORT


def features(word: str) -> list[str]:
    """The patterns that a word matches: itself, and its stems with any ending."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n + 1)]


class Scorer:
    """Labels words by class and runs the grammar over the clauses of a text. ``weights``: learned patterns."""

    def __init__(self, weights: dict[str, float], memory: int = 100_000):
        self.weights, self.memory = weights, memory
        self.known: dict[str, tuple[str, float]] = {}

    def label(self, word: str) -> tuple[str, float]:
        weight = max((self.weights.get(x, 0.0) for x in features(word)), default=0.0)
        if weight > 0:
            return "I", weight
        for label, words in (("T", THREATS), ("N", NEGATIONS), ("R", REPORTS), ("G", TARGETS)):
            if word in words:
                return label, 2.0 if label == "T" else 0.0
        return ("I", 2.0) if not self.weights and word in INSULTS else OTHER

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Weights of the clauses with insults or threats, and how many tokens the text has."""
        words = TOKEN.findall(text.lower())
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > self.memory:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.label(w)
        labels = [known[w] for w in words]
        hits = [i for i, x in enumerate(labels) if x[1]]
        out: list[float] = []
        past = -1
        for i in hits:
            if i <= past:
                continue
            a = i
            while a > 0 and (words[a - 1][0].isalnum() or words[a - 1][0] == "_"):
                a -= 1
            state, total = 0, 0.0
            while a < len(words) and (words[a][0].isalnum() or words[a][0] == "_"):
                state, factor = GRAMMAR.moves[state][labels[a][0]]
                total += labels[a][1] * factor
                a += 1
            past = a
            out.append(total)
        return out, len(words)

    def vector(self, text: str | None) -> tuple[float, float, float]:
        """What the logistic step sees: the heaviest clause, all clauses (logarithm of the sum), their density."""
        found, n = self.clauses(text or "")
        if not found:
            return 0.0, 0.0, 0.0
        return min(max(found), 20.0), math.log1p(sum(found)), min(1.0, 10 * len(found) / max(n, 10))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (intercept last) by Newton steps, with a ridge on all but the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (weight * (y - p)) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _candidates(sample: DataFrame, p: int, n: int) -> list[str]:
    """Patterns that toxic rows of the sample hold more often than chance lets expect."""

    def tally(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                for x in {f for w in set(TOKEN.findall((text or "").lower())) for f in features(w)}:
                    counts.setdefault(x, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["pattern", "pos", "neg"])

    counts = sample.select("text", "toxic").mapInArrow(tally, "pattern string, pos long, neg long").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (n + 1.0))
    chance = (F.col("pos") + F.col("neg")) * (p / max(1, p + n))
    likely = counts.withColumn("w", share).filter((F.col("pos") >= LEAST_ROWS) & (F.col("w") > 1.0) & (F.col("pos") - chance > 3 * F.sqrt(chance)))
    return [r["pattern"] for r in likely.orderBy(F.desc(F.col("pos") * F.col("w")), "pattern").select("pattern").collect()]  # words of at most SAMPLE rows


def cover(holds: list[list[int]], toxic: np.ndarray, patterns: list[str], least: int = 2) -> dict[str, float]:
    """Patterns that together cover the toxic rows, each by rows that those before it leave, and their weights.

    The next pattern is the one with most new toxic rows less three times its new other rows; longer patterns win ties.
    Words that only travel with true insults, as in copies of one text, add nothing and stay out.
    """
    rows: list[set[int]] = [set() for _ in patterns]
    for i, own in enumerate(holds):
        for x in own:
            rows[x].add(i)
    bad = set(np.flatnonzero(toxic == 1).tolist())
    p, n = len(bad), len(toxic) - len(bad)
    left, clean = set(bad), set(range(len(toxic))) - bad
    gain = lambda x: len(rows[x] & left) - 3 * len(rows[x] & clean)
    heap = [(-gain(x), -len(patterns[x]), x) for x in range(len(patterns))]
    heapq.heapify(heap)
    out: dict[str, float] = {}
    while heap:
        old, size, x = heapq.heappop(heap)
        now = gain(x)
        if now < -old:
            if now >= least:
                heapq.heappush(heap, (-now, size, x))
            continue
        if now < least:
            break
        out[patterns[x]] = min(6.0, math.log((len(rows[x] & bad) + 0.5) / (p + 1)) - math.log((len(rows[x]) - len(rows[x] & bad) + 0.5) / (n + 1)))
        left -= rows[x]
        clean -= rows[x]
    for x, own in enumerate(rows):  # frequent in toxic rows and nowhere else: an insult, even if others cover its rows
        hit = len(own & bad)
        if hit >= max(4, FREQUENT * p) and len(own) == hit:
            out[patterns[x]] = min(6.0, math.log((hit + 0.5) / (p + 1)) - math.log(0.5 / (n + 1)))
    return out


def _patterns(sample: DataFrame, p: int, n: int) -> list[dict[str, float]]:
    """Learned pattern weights: from each half of the sample, and from all of it."""
    patterns = _candidates(sample, p, n)
    at = {x: i for i, x in enumerate(patterns)}

    def held(batches):
        for batch in batches:
            own = [sorted({at[f] for w in set(TOKEN.findall((t or "").lower())) for f in features(w) if f in at}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["holds", "toxic", "half"])

    seen = sample.select("text", "toxic", "half").mapInArrow(held, "holds array<int>, toxic int, half int").collect()  # at most 2 * SAMPLE rows of pattern numbers
    out = []
    for halves in ((0,), (1,), (0, 1)):
        own = [r for r in seen if r["half"] in halves]
        out.append(cover([r["holds"] for r in own], np.array([r["toxic"] for r in own]), patterns))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Pattern weights and the logistic step, learned from labelled rows outside fold 0 (crc32 of the id modulo 5).

    At most SAMPLE rows of each class, those of least hash, are read; the share of toxic rows comes from all labels. The
    logistic step is fitted on rows scored with the patterns of the other half of the sample.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc_fold(F.col("doc_id")) != 0)
    totals = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        rate = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return {"weights": {}, "step": [0.3, 0.3, 0.0, math.log(rate / (1 - rate)) if totals else -2.0]}
    order = F.xxhash64("doc_id", F.lit("toxic"))
    chosen = [own.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(SAMPLE) for y in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample, _ = stored(texts.join(F.broadcast(picked), "doc_id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "toxic-sample")  # at most 2 * SAMPLE ids
    counts = {(r["toxic"], r["half"]): r["count"] for r in sample.groupBy("toxic", "half").count().collect()}
    of = lambda y: counts.get((y, 0), 0) + counts.get((y, 1), 0)
    first, second, weights = _patterns(sample, of(1), of(0))
    shared = spark.sparkContext.broadcast((first, second))  # words of at most 2 * SAMPLE rows

    def crossed(batches):
        scorers = [Scorer(x) for x in shared.value]
        for batch in batches:
            rows = [(y, *scorers[1 - h].vector(t)) for t, y, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["y", "a", "b", "c"]).astype("float64"), preserve_index=False)

    seen = sample.select("text", "toxic", "half").mapInArrow(crossed, "y double, a double, b double, c double").toPandas()  # at most 2 * SAMPLE rows of four numbers
    y = seen["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return {"weights": weights, "step": [0.3, 0.3, 0.0, -2.0]}
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    return {"weights": weights, "step": logistic(seen[["a", "b", "c"]].to_numpy(), y, weight * len(y) / weight.sum()).tolist()}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text alone.

    Null and empty texts have no clause and get the score of a text without hits, as does all of a model without
    labels. A null id has held_out null. Equal rows get equal results; columns other than ``carry`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value["weights"])
        *slope, base = shared.value["step"]
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                z = base + sum(a * b for a, b in zip(slope, scorer.vector(text), strict=True))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns as they are.

    Null and empty texts are scored as texts without hits. Columns may have any names: the prediction has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_pieces()
        scorer = Scorer(shared.value["weights"])  # a task's own
        *slope, base = shared.value["step"]
        for texts in batches:
            yield pd.Series([base + sum(a * b for a, b in zip(slope, scorer.vector(t), strict=True)) >= 0 for t in texts], dtype=bool)

    return docs.filter(~toxic(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from ``labels`` and scores every row of ``docs``."""
    return score(docs, fit(docs, labels))
