"""Runs and versions: snapshot hashes, differences of runs, replay, superseding, versioned ingestion, review and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(column: str, kind: str) -> Column:
    """A value as text: null, '' and NaN are the same; dates and timestamps at midnight are the same."""
    c = F.col(column)
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c), "").otherwise(c.cast("string"))
    if kind == "timestamp":
        return F.coalesce(F.when(c == F.date_trunc("day", c), F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("\x1f", *(canonical(c, kinds[c]) for c in columns)), 256)


#: Digests that a bucket of a snapshot hash holds on average, at most.
BUCKET = 1 << 16


def snapshot_hash(df: DataFrame, columns: list[str], bucket: int = BUCKET) -> DataFrame:
    """One row (n, digest) that does not depend on row order.

    Digests are sorted and hashed within buckets of their first digits, three at least, and as many more as keep a
    bucket at about ``bucket`` digests; buckets of one prefix are then hashed together, digit by digit, so the last step
    has 4,096 rows at most.
    """
    own = df.select(row_digest(df, columns).alias("d"))
    digits = 3
    n = own.count()
    while n / 16**digits > bucket:
        digits += 1
    parts = own.groupBy(F.left("d", F.lit(digits)).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256)
    for k in range(digits - 1, 2, -1):
        parts = parts.groupBy(F.left("b", F.lit(k)).alias("b")).agg(F.sum("n").alias("n"), joined.alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined.alias("digest"))


def diff(a: DataFrame, b: DataFrame, least: float = 0.01) -> DataFrame:
    """(record_id, change) between two result tables (record_id, decision, provider_id, confidence)."""
    x, y = (df.select("record_id", *(F.col(c).alias(f"{c}_{n}") for c in ("decision", "provider_id", "confidence")), F.lit(True).alias(f"in_{n}")) for df, n in ((a, "a"), (b, "b")))
    both = x.join(y, "record_id", "full_outer")
    decided = ~(F.col("decision_a").eqNullSafe(F.col("decision_b")) & F.col("provider_id_a").eqNullSafe(F.col("provider_id_b")))
    moved = F.coalesce(F.abs(F.col("confidence_a") - F.col("confidence_b")) > least, F.lit(False))
    change = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "removed").when(decided, "decision").when(moved, "confidence").otherwise("unchanged")
    return both.withColumn("change", change)


def replayed(stored: DataFrame, again: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(record_id, verdict): same, drifted, missing or unexpected."""
    return diff(stored, again, tolerance).select("record_id", F.when(F.col("change") == "new", "unexpected").when(F.col("change") == "removed", "missing").when(F.col("change") == "unchanged", "same").otherwise("drifted").alias("verdict"))


def supersede(current: DataFrame, new: DataFrame, key: str = "record_id", id_col: str = "result_id") -> DataFrame:
    """All rows of ``current`` with superseded_by set where a new result of the same record replaces an open one."""
    link = new.select(key, F.col(id_col).alias("_new"))
    joined = current.join(link, key, "left")
    return joined.withColumn("superseded_by", F.when(F.col("superseded_by").isNull(), F.col("_new")).otherwise(F.col("superseded_by"))).drop("_new")


def conflicting(current: DataFrame, new: DataFrame, cases: DataFrame, key: str = "record_id") -> DataFrame:
    """Records with an active case whose new decision or provider differs from the open one."""
    a, b = current.filter("superseded_by is null").select(key, "decision", "provider_id"), new.select(key, F.col("decision").alias("_d"), F.col("provider_id").alias("_p"))
    differs = ~(F.col("decision").eqNullSafe(F.col("_d")) & F.col("provider_id").eqNullSafe(F.col("_p")))
    return a.join(b, key).filter(differs).join(cases.filter("status = 'ACTIVE'").select(key), key, "left_semi")


def merge_versions(current: DataFrame, incoming: DataFrame, key: list[str], content: list[str], version: Column) -> DataFrame:
    """Slowly changing rows: unchanged current rows stay, changed ones are retired and replaced, unknown ones are added.

    ``current`` has ``is_current`` and ``version`` besides key and content; rows that are not current pass.
    """
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    live, past = current.filter("is_current"), current.filter("not is_current")
    here = F.lit(True)
    joined = live.withColumn("_o", here).alias("o").join(incoming.withColumn("_n", here).alias("n"), on, "full_outer")
    old = joined.filter("_o").select(*(F.col(f"o.{c}").alias(c) for c in (*key, *content)), (F.col("n._n").isNull() | same).alias("is_current"), F.col("o.version").alias("version"))
    new = joined.filter(F.col("n._n") & (F.col("o._o").isNull() | ~same)).select(*(F.col(f"n.{c}").alias(c) for c in (*key, *content)), F.lit(True).alias("is_current"), version.alias("version"))
    return old.unionByName(new).unionByName(past.select(old.columns))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


#: Review actions: the states each starts from and the one it ends in.
TRANSITIONS = {"approve": (("PENDING", "ESCALATED"), "APPROVED"), "reject": (("PENDING", "ESCALATED"), "REJECTED"), "escalate": (("PENDING",), "ESCALATED")}


def reviewed(results: DataFrame, actions: DataFrame, key: str = "result_id") -> DataFrame:
    """One outcome an action: the new review status, or an error code and the old status."""
    df = actions.join(results.select(key, "review_status"), key, "left")
    moved, known = F.lit(None).cast("string"), F.lit(False)
    for name, (origins, to) in TRANSITIONS.items():
        known = known | (F.col("action") == name)
        moved = F.when((F.col("action") == name) & F.col("review_status").isin(*origins), to).otherwise(moved)
    error = F.when(F.col("review_status").isNull(), "not_found").when(~known, "unknown_action").when(moved.isNull(), "invalid_state")
    return df.withColumn("error", error).withColumn("review_status", F.coalesce(moved, "review_status"))


def case_phase(today: Column) -> Column:
    """Phase of a case with start_date, end_date (may be null) and closed (boolean)."""
    return F.when(F.col("closed"), "CLOSED").when(F.col("start_date") > today, "PENDING").when(F.col("end_date") < today, "EXPIRED").otherwise("ACTIVE")


def case_end(start: Column, months: Column) -> Column:
    """Months later, clamped to the end of the month."""
    return F.add_months(start, months)


def case_numbers(cases: DataFrame, used: DataFrame) -> DataFrame:
    """Sequential case numbers of a year, after those in use (year, last)."""
    place = F.row_number().over(Window.partitionBy("year").orderBy("opened_at", "record_id"))
    return cases.withColumn("_n", place).join(used, "year", "left").withColumn("case_number", F.format_string("CASE-%d-%06d", "year", F.col("_n") + F.coalesce("last", F.lit(0)))).drop("_n", "last")


def expired(cases: DataFrame, today: Column) -> DataFrame:
    """Active cases past their end, as EXPIRED rows."""
    return cases.filter((F.col("status") == "ACTIVE") & (F.col("end_date") < today)).withColumn("status", F.lit("EXPIRED"))


def opened(cases: DataFrame, approvals: DataFrame, used: DataFrame, months: int = 3) -> DataFrame:
    """New cases for approvals (provider_id, record_id, opened_at) that have no active case; a repeated approval opens one."""
    pair = ["provider_id", "record_id"]
    live = cases.filter("status = 'ACTIVE'").select(*pair)
    fresh = approvals.groupBy(*pair).agg(F.min("opened_at").alias("opened_at")).join(live, pair, "left_anti")
    start = F.to_date("opened_at")
    dated = fresh.withColumns({"year": F.year(start), "status": F.lit("ACTIVE"), "start_date": start, "end_date": case_end(start, F.lit(months))})
    return case_numbers(dated, used)


def closed(cases: DataFrame, requests: DataFrame) -> DataFrame:
    """One outcome a request (case_id, reason): closed, or the error that stands against it."""
    df = requests.join(cases.select("case_id", "status"), "case_id", "left")
    error = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "ACTIVE", "case_not_active").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "reason_required")
    return df.withColumn("error", error).withColumn("status", F.when(error.isNull(), "CLOSED").otherwise(F.col("status")))
