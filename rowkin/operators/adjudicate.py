"""Adjudication of the grey band by an outside model: requests, a response cache, validation and effect, as joins and columns.

The model is a function from a prompt to an answer; only prompts that the cache lacks reach it, in ``mapInPandas``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rowkin.sources.tables import absent
from rowkin.storage import staged

TOP = 3
ANSWER = "decision string, provider_id string, confidence double, evidence_cited array<string>, reasoning string"
DECISIONS = ("MATCH", "NO_CONFIDENT_MATCH", "AMBIGUOUS")
MOST_EVIDENCE = 24
LONGEST_REASONING = 1200


def requests(routed: DataFrame, ranked: DataFrame, top: int = TOP) -> DataFrame:
    """One prompt a record of the grey band: ranks, levels and weights of its best candidates, and no text of the record.

    ``ranked`` has record_id, provider_id, rank, levels (map field to level), match_weight, confidence.
    """
    grey = routed.filter("reason = 'GREY_BAND'").select("record_id")
    shown = F.struct("rank", "provider_id", F.array_sort(F.map_entries("levels")).alias("levels"), F.round("match_weight", 4).alias("match_weight"), F.round("confidence", 6).alias("confidence"))
    best = ranked.filter(F.col("rank") <= top).join(grey, "record_id", "left_semi").groupBy("record_id").agg(F.array_sort(F.collect_list(shown)).alias("candidates"))
    cites = F.flatten(F.transform("candidates", lambda c: F.transform(c["levels"], lambda f: F.concat(c["provider_id"], F.lit("."), f["key"]))))
    handle = F.concat(F.lit("R-"), F.left(F.sha2(F.col("record_id").cast("string"), 256), F.lit(12)))
    return best.select("record_id", F.transform("candidates", lambda c: c["provider_id"]).alias("allowed"), cites.alias("evidence"), F.to_json(F.struct(handle.alias("record"), "candidates")).alias("prompt"))


def cache_key(provider: str, model: str, version: str, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(provider), F.lit(model), F.lit(version), prompt), 256)


def answered(asked: DataFrame, cache: DataFrame, ask: Callable[[str], str], provider: str, model: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Requests with answers, and the rows (cache_key, answer) to append to the cache. Equal prompts are asked once."""
    keyed = asked.withColumn("cache_key", cache_key(provider, model, version, F.col("prompt")))
    misses = absent(keyed.select("cache_key", "prompt"), cache, ["cache_key"])

    def call(batches):
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "answer": [ask(p) for p in batch["prompt"]]})

    fresh = misses.mapInPandas(call, "cache_key string, answer string")
    return keyed.join(cache.select("cache_key", "answer").unionByName(fresh), "cache_key", "left"), fresh


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first JSON object of an answer that may have words or a fence around it."""

    def read(answer):
        at = (answer or "").find("{")
        while at >= 0:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(answer, at)[0])
            except ValueError:
                at = answer.find("{", at + 1)
        return None

    return text.map(read)


def validated(df: DataFrame) -> DataFrame:
    """Each answer as columns, and the first ``rejection`` that holds; a rejected answer changes nothing."""
    got = df.withColumn("_json", first_object("answer")).withColumn("_a", F.from_json("_json", ANSWER))
    a = F.col("_a")
    unknown = a["provider_id"].isNotNull() & ~F.array_contains("allowed", a["provider_id"])
    invented = F.size(F.array_except(F.coalesce(a["evidence_cited"], F.array().cast("array<string>")), "evidence")) > 0
    rejection = (
        F.when(F.col("_json").isNull(), "no_json_found")
        .when(a["decision"].isNull() | ~a["decision"].isin(*DECISIONS) | a["confidence"].isNull() | a["evidence_cited"].isNull() | (F.size(a["evidence_cited"]) > MOST_EVIDENCE) | a["reasoning"].isNull() | (F.length(a["reasoning"]) > LONGEST_REASONING), "schema_validation_failed")
        .when(~a["confidence"].between(0, 1), "confidence_out_of_range")
        .when((a["decision"] == "MATCH") & (F.coalesce(a["provider_id"], F.lit("")) == ""), "decision_match_without_provider_id")
        .when(unknown, "provider_id_not_in_candidate_set")
        .when(invented, "cited_evidence_not_supplied")
    )
    return got.select(*df.columns, rejection.alias("rejection"), *(a[c].alias(f"answer_{c}") for c in ("decision", "provider_id", "confidence")))


def repair_prompt(prompt: Column, answer: Column, rejection: Column) -> Column:
    """The prompt again, the answer that was refused, and why."""
    return F.to_json(F.struct(prompt.alias("prompt"), answer.alias("refused_answer"), rejection.alias("refused_because"), F.lit("Answer once more, with one JSON object that keeps to the rules.").alias("ask")))


def _asked(keyed: DataFrame, cache: DataFrame, ask: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """Requests with ``answer`` or ``error``, and the written rows (cache_key, answer, error) of the calls that were made. A call that raises fails for its prompt alone."""
    misses = absent(keyed.select("cache_key", "prompt"), cache, ["cache_key"])

    def call(batches):
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["cache_key"], batch["prompt"], strict=True):
                try:
                    rows.append((key, ask(prompt), None))
                except Exception as e:  # whatever the model's client raises: the record stays where it was
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["cache_key", "answer", "error"], dtype=object)

    fresh = staged(misses.mapInPandas(call, "cache_key string, answer string, error string"), "answers")
    known = cache.select("cache_key", "answer", F.lit(None).cast("string").alias("error")).unionByName(fresh)
    return keyed.join(known, "cache_key", "left"), fresh


def adjudicated(asked: DataFrame, cache: DataFrame, ask: Callable[[str], str], provider: str, model: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(answers, rows to append to the cache). Refused answers are asked for once more, once.

    asked: ``requests``. answers: record_id, rejection, answer_decision, answer_provider_id, answer_confidence,
    repaired (the second answer was taken) and error. A call that fails leaves its record with the rejection
    ``call_failed`` (or, if it was the second one, with the first answer's rejection), is not cached, and touches no
    other record. Prompts that are equal are asked once, and answers are written before they are used, so no call is
    made twice.
    """
    key = lambda df: df.withColumn("cache_key", cache_key(provider, model, version, F.col("prompt")))
    refused = lambda df: df.withColumn("rejection", F.when(F.col("error").isNotNull(), "call_failed").otherwise(F.col("rejection")))
    told = ["rejection", "answer_decision", "answer_provider_id", "answer_confidence", "error"]
    first, fresh = _asked(key(asked), cache, ask)
    one = staged(refused(validated(first)), "first_answers")
    again = one.where("rejection is not null and error is null")
    again = again.withColumn("prompt", repair_prompt(F.col("prompt"), F.coalesce("answer", F.lit("")), F.col("rejection"))).select(*asked.columns)
    second, more = _asked(key(again), cache, ask)
    two = refused(validated(second)).where("error is null").select("record_id", F.struct(*told).alias("_two"))
    both = one.select("record_id", *told).join(two, "record_id", "left")
    answers = both.select("record_id", *(F.when(F.col("_two").isNotNull(), F.col(f"_two.{c}")).otherwise(F.col(c)).alias(c) for c in told), F.col("_two").isNotNull().alias("repaired"))
    return answers, fresh.unionByName(more).where("error is null").select("cache_key", "answer")


def nobody(asked: DataFrame) -> DataFrame:
    """Answers where no model is there: every record abstains and stays where the engine left it."""
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    return asked.select("record_id", F.lit("adjudicator_unavailable").alias("rejection"), null("answer_decision", "string"), null("answer_provider_id", "string"), null("answer_confidence", "double"), null("error", "string"), F.lit(False).alias("repaired"))


def adjudication_counts(answers: DataFrame) -> DataFrame:
    """One row: calls, taken, matched, second rounds, abstentions, and a map of rejections."""
    per = answers.groupBy("rejection").agg(F.count("*").alias("n"), F.count_if("repaired").alias("again"), F.count_if(F.col("rejection").isNull() & (F.col("answer_decision") == "MATCH")).alias("hits"))
    of = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    good = F.col("rejection").isNull()
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(~good, F.struct("rejection", "n")))))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), of(good, "n").alias("adjudicated"), F.coalesce(F.sum("hits"), F.lit(0)).alias("matched"), F.coalesce(F.sum("again"), F.lit(0)).alias("repairs"), of(~good, "n").alias("abstentions"), reasons.alias("rejections"))


def applied(routed: DataFrame, answers: DataFrame) -> DataFrame:
    """Decisions of the grey band after the answers: a valid MATCH decides; every other answer leaves the record to a reviewer."""
    good = answers.filter("rejection is null and answer_decision = 'MATCH'").select("record_id", "answer_provider_id", "answer_confidence")
    df = routed.join(good, "record_id", "left")
    said = F.col("answer_provider_id").isNotNull()
    return df.select(
        *(c for c in routed.columns if c not in ("decision", "provider_id", "confidence")),
        F.when(said, "MATCH").otherwise(F.col("decision")).alias("decision"),
        F.coalesce("answer_provider_id", F.col("provider_id").cast("string")).alias("provider_id"),
        F.when(said, F.col("answer_confidence")).otherwise(F.col("confidence")).alias("confidence"),
    )


def cost(model: Column, prompt_tokens: Column, completion_tokens: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price of a call; prices are dollars a million prompt and completion tokens, and unknown models cost nothing."""
    total = F.lit(0.0)
    for name, (of_prompt, of_completion) in prices.items():
        total = F.when(model == name, (prompt_tokens * of_prompt + completion_tokens * of_completion) / 1_000_000).otherwise(total)
    return total
