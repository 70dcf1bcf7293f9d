"""Dashboard aggregates and listings: histograms with empty bins, volumes, zero-filled counts, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin from 1, n) of equal bins, empty ones too; the top edge is in the last bin."""
    width = (high - low) * (1 + 1e-9)
    got = df.withColumn("bin", F.width_bucket(F.col(column), F.lit(low), F.lit(low + width), F.lit(bins)).cast("int")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(df: DataFrame, column: str, missing: str = "??") -> DataFrame:
    """(value, n), most first."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def with_other(counts: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of a distribution and the rest as 'other'. The window sees a row a value."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value"))
    return counts.withColumn("value", F.when(rank <= top, F.col("value")).otherwise("other")).groupBy("value").agg(F.sum("n").alias("n"))


def volume(df: DataFrame, ts: str, unit: str, **sums: Column) -> DataFrame:
    """Rows and sums by day, week or month."""
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("period")).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def zero_filled(df: DataFrame, column: Column, values: list[str]) -> DataFrame:
    """Counts of all values of a closed list."""
    got = df.groupBy(column.alias("value")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return every.join(got, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of 1 to 500 rows in an order."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def queue_filter(
    decision: str | None = None,
    status: str | None = None,
    least: float | None = None,
    most: float | None = None,
    state: str | None = None,
    since: str | None = None,
    until: str | None = None,
    kind: str | None = None,
    reason: str | None = None,
    run: str | None = None,
    authority: str | None = None,
    text: str | None = None,
) -> Column:
    """What a review queue asks for; ``until`` includes its day, ``text`` is looked for in names, whatever the case."""
    out = F.lit(True)
    for column, value in (("decision", decision), ("review_status", status), ("state", state), ("kind", kind), ("reason", reason), ("run_id", run), ("source_authority", authority)):
        out = out & (F.col(column) == value) if value is not None else out
    if least is not None:
        out = out & (F.col("confidence") >= least)
    if most is not None:
        out = out & (F.col("confidence") <= most)
    if since:
        out = out & (F.col("created_at") >= F.to_timestamp(F.lit(since)))
    if until:
        out = out & (F.col("created_at") < F.date_add(F.to_date(F.lit(until)), 1))
    if text:
        out = out & F.contains(F.lower("subject_name"), F.lit(text.lower()))
    return out


def conflict_members(results: DataFrame) -> DataFrame:
    """Current results whose provider other records claim too: all columns, and how many records claim it. results: record_id, provider_id, decision, superseded_by."""
    now = results.filter("superseded_by is null and decision = 'MATCH' and provider_id is not null")
    many = now.groupBy("provider_id").agg(F.count_distinct("record_id").alias("claims")).filter("claims > 1")
    return now.join(many, "provider_id")


def in_conflict(results: DataFrame, cases: DataFrame, involved: bool = True, id_col: str = "result_id") -> DataFrame:
    """Results that a live conflict is about (the one an active, flagged case was opened on, or the one that disagrees with it), or all others.

    cases: result_id, conflict_result_id, status, conflict_flag. Ids that are null name no result, so they take none
    out of the others either. Two id sets are one semi join or anti join.
    """
    live = cases.filter("status = 'ACTIVE' and conflict_flag")
    ids = live.select(F.explode(F.array("result_id", "conflict_result_id")).alias(id_col)).filter(F.col(id_col).isNotNull())
    return results.join(ids, id_col, "left_semi" if involved else "left_anti")


def queue(results: DataFrame, records: DataFrame, cases: DataFrame, sanction_type: str | None = None, is_organization: bool | None = None, state: str | None = None, conflict: bool | None = None, audit: bool | None = None, superseded: bool = False, **asked) -> DataFrame:
    """The review queue: results beside the record they decide (record_id), filtered; what is None is not asked for.

    Superseded results only if asked for. ``state`` is looked for in capitals. Further filters: see ``queue_filter``.
    Filters on results run before the join.
    """
    own = results if superseded else results.filter("superseded_by is null")
    if audit is not None:
        own = own.filter(F.col("audit_sampled") == audit)
    own = own.filter(queue_filter(**asked))
    if conflict is not None:
        own = in_conflict(own, cases, conflict)
    met = records
    for column, value in (("state", state.upper() if state else None), ("sanction_type", sanction_type), ("is_organization", is_organization)):
        met = met.filter(F.col(column) == value) if value is not None else met
    return own.join(met, "record_id")


def queue_order(by: str = "confidence", descending: bool = True, id_col: str = "result_id") -> list[Column]:
    """A total order of the queue: nulls count as the lowest either way, ids break ties."""
    key = "created_at" if by == "date" else "confidence"
    return [F.desc_nulls_last(key) if descending else F.asc_nulls_first(key), F.asc(id_col)]


def kpi_tiles(providers: DataFrame, records: DataFrame, results: DataFrame, cases: DataFrame, today: Column) -> DataFrame:
    """One row of fourteen counts: the tables, decisions of current results, their reviews, phases of cases, live conflicts.

    Reviews count what waits for a person: current results other than NO_MATCH. An active case that has not begun is
    pending. Four aggregations of a row each.
    """
    now, c = F.col("superseded_by").isNull(), F.col
    asked = now & (c("decision") != "NO_MATCH")
    phase = F.when((c("status") == "ACTIVE") & (c("start_date") > today), "PENDING").otherwise(c("status"))
    decided = results.agg(
        *(F.count_if(now & (c("decision") == d)).alias(n) for d, n in (("MATCH", "matched"), ("AMBIGUOUS", "ambiguous"), ("NO_MATCH", "no_match"))),
        *(F.count_if(asked & (c("review_status") == r)).alias(n) for r, n in (("PENDING", "pending_review"), ("ESCALATED", "escalated"), ("APPROVED", "approved"), ("REJECTED", "rejected"))),
    )
    opened = cases.agg(*(F.count_if(phase == p).alias(f"cases_{p.lower()}") for p in ("PENDING", "ACTIVE", "EXPIRED", "CLOSED")), F.count_if(c("conflict_flag") & (c("status") == "ACTIVE")).alias("conflicts"))
    return providers.agg(F.count("*").alias("providers")).join(records.agg(F.count_if("is_current").alias("sanction_records"))).join(decided).join(opened)  # one row each


def counted_page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page with ``total``, the rows of all pages; the count is an aggregate that is joined to the page."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, offset, limit).join(F.broadcast(total))  # one row


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass; null and empty values are not listed."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")
    return df.select(pairs).filter("f.value <> ''").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def match_detail(results: DataFrame, candidates: DataFrame, records: DataFrame, providers: DataFrame) -> DataFrame:
    """Each result with its record, and its candidates by rank, each with its provider. Candidates of a result are bounded by the cap of blocking."""
    whole = lambda df, name: F.struct(*(df[c] for c in df.columns)).alias(name)
    named = candidates.join(providers.select("provider_id", whole(providers, "provider")), "provider_id", "left")
    listed = named.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", "provider_id", "confidence", "provider"))).alias("candidates"))
    return results.join(records.select("record_id", whole(records, "record")), "record_id").join(listed, "record_id", "left")


def with_context(details: DataFrame, cases: DataFrame, runs: DataFrame, configs: DataFrame, calls: DataFrame) -> DataFrame:
    """Match details with what a reviewer sees beside them: cases, conflicting_cases, band, call.

    cases (case_id, result_id, conflict_result_id, status, created_at) opened on the result, and live ones that it
    contradicts, newest first; the band is the cuts of the config that decided it (runs: run_id, config_id; configs:
    config_id, version, t_accept, t_reject), not of the one in use; the call (calls: call_key, model, prompt_version,
    response) is that of the model, if one decided. A result has few cases: one a provider at a time.
    """
    def listed(on: str, rows: DataFrame, name: str) -> DataFrame:
        # arrays sort upwards, so the place from the newest is counted down
        told = F.struct(F.col("created_at"), F.col("case_id"), F.col("status"))
        newest = F.array_sort(F.collect_list(told), lambda a, b: F.when(a["created_at"] != b["created_at"], F.when(a["created_at"] > b["created_at"], -1).otherwise(1)).when(a["case_id"] < b["case_id"], -1).when(a["case_id"] > b["case_id"], 1).otherwise(0))
        return rows.filter(F.col(on).isNotNull()).groupBy(F.col(on).alias("result_id")).agg(newest.alias(name))

    band = runs.select("run_id", "config_id").join(configs.select("config_id", F.struct("config_id", "version", "t_accept", "t_reject").alias("band")), "config_id").drop("config_id")
    called = calls.select("call_key", F.struct("model", "prompt_version", "response").alias("call"))
    out = details.join(listed("result_id", cases, "cases"), "result_id", "left").join(listed("conflict_result_id", cases.filter("status = 'ACTIVE'"), "conflicting_cases"), "result_id", "left")
    empty = F.array().cast(out.schema["cases"].dataType)
    out = out.withColumn("cases", F.coalesce("cases", empty)).withColumn("conflicting_cases", F.coalesce("conflicting_cases", empty))
    return out.join(band, "run_id", "left").join(called, "call_key", "left")


def standing(master: DataFrame, cases: DataFrame, open_results: DataFrame, key: str) -> DataFrame:
    """Each master row with EXCLUDED (an active case), UNDER_REVIEW (an open ambiguous result) or CLEAR."""
    marks = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    df = master.join(marks(cases, "_case"), key, "left").join(marks(open_results, "_open"), key, "left")
    return df.withColumn("standing", F.when(F.col("_case"), "EXCLUDED").when(F.col("_open"), "UNDER_REVIEW").otherwise("CLEAR")).drop("_case", "_open")
